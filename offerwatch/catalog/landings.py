"""Whole monitoring runs: landings of the main portal built from `part`, worked off by the periodic job."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch import schemas
from offerwatch.catalog.offers import PER_PAGE, _landed, _query_page
from offerwatch.catalog.tables import EVENTS_SQL, dealt, load, money_sql
from offerwatch.functions.costs import half_even
from offerwatch.plans import monitor
from offerwatch.plans.store import Store
from offerwatch.session import work_dir
from offerwatch.streaming import runs as streaming

LANDINGS = 5
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
URL = "https://main.example/detail/"


def _base_price() -> Column:
    return half_even(F.col("p_retailprice") * 20)


def _seen(k: Column, n: Column) -> Column:
    """Listings that come and go: out for two landings, out for one, new in the third, gone from the fourth on."""
    out = F.when(k % 11 == 5, n.between(1, 2)).when(k % 11 == 6, n == 1).when(k % 11 == 7, n < 2).when(k % 11 == 8, n > 2)
    return ~F.coalesce(out, F.lit(False))


def _search_pages(spark, sf_dir) -> DataFrame:
    """Every landing's result pages; one of the fourth was never answered. `late`: came after the run was first tested."""
    part = load(spark, sf_dir, "part").withColumns({
        "tx": F.when(F.col("p_partkey") % 2 == 0, C.RENT).otherwise(C.SALE),
        "_page": (F.floor(F.col("p_partkey") / (2 * PER_PAGE)) + 1).cast("int"),
    })
    totals = part.groupBy("tx").agg(F.count(F.lit(1)).alias("total"))
    part = dealt(part, "_page")
    k, n = F.col("p_partkey"), F.col("n")
    code = F.when(k % 3 == 0, 2).when(k % 3 == 1, 4).otherwise(9)
    result = F.struct(
        k.alias("id"),
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" m²")).alias("name"),
        (_base_price() + F.floor((k + n) / 5) * 1000).alias("priceCzk"),
        F.struct(code.alias("value"), F.when(k % 3 == 0, "1+kk").otherwise("2+kk").alias("name")).alias("categorySubCb"),
    )
    shown = part.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(LANDINGS - 1)))).where(_seen(k, n))
    # at most PER_PAGE results share a page; there are two totals, too few keys to shuffle the pages by
    pages = shown.groupBy("n", "tx", "_page").agg(
        F.array_sort(F.collect_list(F.struct(k.alias("k"), F.to_json(result).alias("json")))).alias("_results")
    ).join(F.broadcast(totals), "tx")
    data = F.concat(
        F.lit('{"pagination":{"total":'), F.col("total").cast("string"), F.lit(',"offset":'),
        ((F.col("_page") - 1) * PER_PAGE).cast("string"), F.lit(f',"limit":{PER_PAGE}}},"results":['),
        F.array_join(F.transform("_results", lambda r: r["json"]), ","), F.lit("]}"),
    )
    unanswered = (n == 3) & (F.col("tx") == C.RENT) & (F.col("_page") == 2)
    landed = _landed(
        pages, C.MAIN_SOURCE, "search", run_id=F.concat(F.lit("landing-"), n.cast("string")),
        tx=F.col("tx"), page_no=F.col("_page"), status=F.when(unanswered, 500).otherwise(200),
        url=F.concat(F.lit("https://main.example/search?region="), F.url_encode(F.lit(C.DEFAULTS.region))),
        body=F.when(~unanswered, _query_page(C.SEARCH_QUERY, data)),
    )
    return landed.withColumn("late", (F.col("run_id") == "landing-1") & (F.col("tx") == C.SALE) & (F.col("page_no") == 1))


def _watched(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "part").where(F.col("p_partkey") % 40 == 0)


def _watched_pages(spark, sf_dir) -> DataFrame:
    """A page per landing and watched part: unreadable for some in the second landing, gone for some in the third."""
    k, n = F.col("p_partkey"), F.col("n")
    detail = F.struct(
        F.col("p_name").alias("name"), (_base_price() + n * 2000).alias("priceCzk"), F.struct(F.lit(2).alias("value")).alias("categoryTypeCb"),
    )
    status = F.when((n == 1) & (k % 120 == 0), 500).when((n == 2) & (k % 80 == 0), 404).otherwise(200)
    rows = dealt(_watched(spark, sf_dir), "p_partkey").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(LANDINGS - 1))))
    landed = _landed(
        rows, C.MAIN_SOURCE, "watched", run_id=F.concat(F.lit("landing-"), n.cast("string")), listing_key=k, status=status,
        url=F.concat(F.lit(URL), k.cast("string")), body=F.when(status == 200, _query_page(C.DETAIL_QUERY, F.to_json(detail))),
    )
    return landed.withColumn("late", F.lit(False))


def monitor_runs(spark, sf_dir):
    """Five landings through the run queue, all steps of a run included.

    The first call finds the second landing incomplete, so the third waits. A
    page comes late and two more landings arrive: the second and third run are
    committed, the fourth landing is incomplete and the fifth waits. The last
    call gives the fourth up; the fifth takes its number. One row per run of the
    queue, event, watched change, watched state, count, statistic and listing.
    """
    root = work_dir(spark, "monitor-runs")
    store = Store(spark, f"{root}/store")
    found = _search_pages(spark, sf_dir).unionByName(_watched_pages(spark, sf_dir))
    found.write.partitionBy("run_id", "source", "kind", "late").parquet(f"{root}/found")
    found = spark.read.schema(found.schema).parquet(f"{root}/found")
    edits = _watched(spark, sf_dir).select(F.lit("add").alias("op"), F.concat(F.lit(URL), F.col("p_partkey").cast("string")).alias("arg"), F.col("p_partkey").alias("ts"))
    monitor.edit_watchlist(store, edits)

    def call(landings, late):
        if landings:
            arrived = [(f"landing-{n}", None, START + timedelta(hours=8 * n)) for n in landings]
            spark.createDataFrame(arrived, schemas.RUNS).coalesce(1).write.mode("append").parquet(f"{root}/landed")
        pages = found.where(F.col("late") <= late).drop("late")
        streaming.stream_runs(store, pages, f"{root}/landed", f"{root}/_landed", patience=2)

    call([0, 1, 2], late=False)
    call([3, 4], late=True)
    call([], late=True)

    def rows(table: DataFrame, what: str, name, key=None, old=None, new=None, n=None) -> DataFrame:
        given = {"listing_key": (key, "string"), "old_czk": (old, "bigint"), "new_czk": (new, "bigint"), "n": (n, "bigint")}
        return table.select(
            F.col("run_seq"), F.lit(what).alias("what"), (F.col(name) if isinstance(name, str) else name).alias("name"),
            *[(F.lit(None) if value is None else F.col(value)).cast(kind).alias(column) for column, (value, kind) in given.items()],
        )

    queue = streaming.run_queue(store).join(store.runs().select("run_id", "run_seq"), "run_id", "left")
    changes = store.committed("changes", schemas.CHANGES)
    states = store.committed("watched", monitor.WATCH_STATE).withColumn("_total", F.col("payload.total_czk"))
    numbers = "median_czk_per_sqm avg_czk_per_sqm count".split()
    run_stats = store.committed("run_stats", schemas.struct("run_seq bigint, " + ", ".join(f"{t}_{c} bigint" for t in ("rent", "sale") for c in numbers)))
    run_stats = run_stats.unpivot("run_seq", [c for c in run_stats.columns if c != "run_seq"], "name", "n")
    counts = store.committed("mart_counts", schemas.struct("run_seq bigint, what string, name string, n bigint"))
    listed = store.committed("mart_listings", schemas.struct("run_seq bigint, listing_key string, price_czk bigint, change_note string"))
    parts = [
        rows(queue, "run", F.concat_ws(" ", "run_id", "state"), n="tries"),
        rows(changes, "event", "kind", "listing_key", "old_price_czk", "new_price_czk"),
        rows(store.committed("watched_changes", monitor.WATCHED_CHANGES), "watched", F.lit("price_change"), "listing_key", "old_total_czk", "new_total_czk"),
        rows(states, "state", F.when(F.col("active"), "active").otherwise("inactive"), "listing_key", None, "_total"),
        rows(counts, "count", F.concat_ws(" ", "what", "name"), n="n"),
        rows(run_stats, "stat", "name", n="n"),
        rows(listed, "listing", "change_note", "listing_key", None, "price_czk"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


MONITOR_RUNS = f"""
WITH landed(run_seq, n) AS (VALUES (1, 0), (2, 1), (3, 2), (4, 4)),
parts AS (SELECT p_partkey AS k, p_size, CAST(round_even(p_retailprice * 20, 0) AS BIGINT) AS base FROM part),
obs AS (
  SELECT run_seq, CAST(k AS VARCHAR) AS listing_key, base + (k + n) // 5 * 1000 AS price_czk, k, p_size
  FROM parts CROSS JOIN landed
  WHERE k % 3 <> 2 AND NOT CASE k % 11 WHEN 5 THEN n IN (1, 2) WHEN 6 THEN n = 1 WHEN 7 THEN n < 2 WHEN 8 THEN n > 2 ELSE false END),
bounds AS (SELECT max(run_seq) AS n FROM obs),{EVENTS_SQL},
reads AS (
  SELECT k, run_seq, n, base, CASE WHEN k % 120 = 0 THEN 0 ELSE 1 END AS second FROM parts CROSS JOIN landed WHERE k % 40 = 0),
states AS (
  SELECT run_seq, CAST(k AS VARCHAR) AS listing_key, NOT (run_seq = 3 AND k % 80 = 0) AS active,
         base + 1500 + 2000 * CASE WHEN run_seq = 2 OR (run_seq = 3 AND k % 80 = 0) THEN second ELSE n END AS total
  FROM reads),
moved AS (
  SELECT s.run_seq, s.listing_key, b.total AS old_czk, s.total AS new_czk
  FROM states s JOIN states b ON b.listing_key = s.listing_key AND b.run_seq = s.run_seq - 1
  WHERE s.active AND s.total <> b.total),
rates AS (SELECT run_seq, k % 2 = 0 AS rent, round_even(price_czk / CAST(p_size AS DOUBLE), 0) AS rate FROM obs),
stats AS (
  SELECT run_seq, rent, round_even(median(rate), 0) AS mid, round_even(avg(rate), 0) AS mean, count(*) AS n FROM rates GROUP BY ALL),
kinds AS (
  SELECT run_seq, kind, count(*) AS n FROM changes GROUP BY ALL
  UNION ALL
  SELECT o.run_seq + 1, 'pending', count(*) FROM obs o, bounds
  WHERE o.run_seq < n AND NOT EXISTS (SELECT 1 FROM obs a WHERE a.listing_key = o.listing_key AND a.run_seq = o.run_seq + 1)
  GROUP BY 1)
SELECT run_seq, 'run' AS what, name, NULL::VARCHAR AS listing_key, NULL::BIGINT AS old_czk, NULL::BIGINT AS new_czk, n
FROM (VALUES (1, 'landing-0 committed', 1), (2, 'landing-1 committed', 2), (3, 'landing-2 committed', 1), (NULL, 'landing-3 given_up', 2),
             (4, 'landing-4 committed', 1)) v(run_seq, name, n)
UNION ALL SELECT run_seq, 'event', kind, listing_key, old_price_czk, new_price_czk, NULL FROM changes
UNION ALL SELECT run_seq, 'watched', 'price_change', listing_key, old_czk, new_czk, NULL FROM moved
UNION ALL SELECT run_seq, 'state', CASE WHEN active THEN 'active' ELSE 'inactive' END, listing_key, NULL, total, NULL FROM states
UNION ALL SELECT run_seq, 'count', 'events ' || kind, NULL, NULL, NULL, n FROM kinds
UNION ALL SELECT run_seq, 'count', 'listings {C.MAIN_SOURCE}', NULL, NULL, NULL, count(*) FROM obs GROUP BY run_seq
UNION ALL SELECT run_seq, 'stat', CASE WHEN rent THEN 'rent' ELSE 'sale' END || unnest(['_median_czk_per_sqm', '_avg_czk_per_sqm', '_count']),
                 NULL, NULL, NULL, unnest([CAST(mid AS BIGINT), CAST(mean AS BIGINT), n]) FROM stats
UNION ALL
SELECT o.run_seq, 'listing',
       CASE WHEN w.listing_key IS NOT NULL THEN 'Price changed: ' || {money_sql("w.old_czk")} || ' → ' || {money_sql("w.new_czk")}
            WHEN c.kind = 'price_change' THEN 'Price changed: ' || {money_sql("c.old_price_czk")} || ' → ' || {money_sql("c.new_price_czk")}
            WHEN c.kind = 'new' THEN 'New listing since last check' END,
       o.listing_key, NULL, o.price_czk, NULL
FROM obs o LEFT JOIN moved w ON w.listing_key = o.listing_key AND w.run_seq = o.run_seq
LEFT JOIN changes c ON c.kind <> 'removed' AND c.listing_key = o.listing_key AND c.run_seq = o.run_seq"""


QUERIES = {"monitor_runs": monitor_runs}

ORACLES = {"monitor_runs": MONITOR_RUNS}
