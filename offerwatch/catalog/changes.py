"""Runs compared: diff, history, notes, marts, store and stream."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch import schemas
from offerwatch.catalog.tables import CHANGES_SQL, OBS_SQL, load, money_sql, observations
from offerwatch.operators import diff, run_stats, stats
from offerwatch.operators.dedup import keep_last_in_first_place
from offerwatch.plans import marts
from offerwatch.plans.store import Store
from offerwatch.session import work_dir
from offerwatch.streaming import runs as streaming

CHANGE_COLUMNS = [
    "run_seq", "kind", "listing_key", "old_price_czk", "new_price_czk", "first_seen_seq",
    "missing_since_seq", "removed_since_seq", "item_price_czk",
]


def _changes(spark, sf_dir):
    return diff.diff_runs(observations(spark, sf_dir))


def snapshot_diff(spark, sf_dir):
    found = observations(spark, sf_dir).select(
        "run_seq", "listing_key", "price_czk", "total_czk", "electricity_estimated"
    )
    return diff.diff_runs(found).withColumn("item_price_czk", F.col("item.price_czk")).select(*CHANGE_COLUMNS)


def snapshot_diff_pair(spark, sf_dir):
    obs = observations(spark, sf_dir)
    last = obs.agg(F.max("run_seq")).scalar()
    numbered = obs.withColumn("_age", last - F.col("run_seq")).where(F.col("_age") <= 2)
    now, before, earlier = (numbered.where(F.col("_age") == age).drop("_age") for age in (0, 1, 2))
    waiting = earlier.join(before.select("listing_key"), "listing_key", "left_anti")
    changes, pending = diff.diff_pair(before, waiting, now, last)
    names = ["run_seq", "kind", "listing_key", "old_price_czk", "new_price_czk", "missing_since_seq"]
    return changes.select(*names, F.col("item.price_czk").alias("item_price_czk")).unionByName(
        pending.select(
            F.col("missing_since_seq").alias("run_seq"), F.lit("pending").alias("kind"), "listing_key",
            F.lit(None).cast("bigint").alias("old_price_czk"), F.lit(None).cast("bigint").alias("new_price_czk"),
            "missing_since_seq", F.col("price_czk").alias("item_price_czk"),
        )
    )


SNAPSHOT_DIFF_PAIR = f"""
WITH {OBS_SQL},
cur AS (SELECT o.* FROM obs o, bounds WHERE run_seq = n),
prev AS (SELECT o.* FROM obs o, bounds WHERE run_seq = n - 1),
pend AS (SELECT o.* FROM obs o, bounds WHERE run_seq = n - 2 AND listing_key NOT IN (SELECT listing_key FROM prev)),
old AS (SELECT *, false AS was_pending FROM prev UNION ALL SELECT *, true FROM pend)
SELECT n AS run_seq,
       CASE WHEN o.listing_key IS NULL THEN 'new' WHEN c.listing_key IS NOT NULL THEN 'price_change'
            WHEN was_pending THEN 'removed' ELSE 'pending' END AS kind,
       coalesce(c.listing_key, o.listing_key) AS listing_key,
       CASE WHEN c.listing_key IS NOT NULL AND o.listing_key IS NOT NULL THEN o.price_czk END AS old_price_czk,
       CASE WHEN c.listing_key IS NOT NULL AND o.listing_key IS NOT NULL THEN c.price_czk END AS new_price_czk,
       CASE WHEN c.listing_key IS NULL THEN CASE WHEN was_pending THEN n - 1 ELSE n END END AS missing_since_seq,
       coalesce(c.price_czk, o.price_czk) AS item_price_czk
FROM old o FULL JOIN cur c ON o.listing_key = c.listing_key CROSS JOIN bounds
WHERE c.listing_key IS NULL OR o.listing_key IS NULL OR c.price_czk IS DISTINCT FROM o.price_czk"""


def _with_sources(spark, sf_dir):
    """Observations of three sources that each fail in some runs, with detail pages that fail for some listings; and
    the runs in which a source was complete."""
    key = F.col("listing_key").cast("bigint")
    obs = observations(spark, sf_dir)
    failed = (key + F.col("run_seq")) % 6 == 0
    obs = obs.select(
        "run_seq", "listing_key", "price_czk", "electricity_estimated",
        F.concat(F.lit("s"), (key % 3).cast("string")).alias("source"),
        F.when(failed, F.col("price_czk")).otherwise(F.col("price_czk") + 1500).alias("total_czk"),
        F.when(failed, F.lit(True)).alias("enrich_failed"),
    )
    incomplete = (F.col("run_seq") * 7 + F.substring("source", 2, 1).cast("bigint") * 3) % 10 == 0
    return obs, obs.select("source", "run_seq").distinct().where(~incomplete)


def snapshot_diff_strict(spark, sf_dir):
    """Three sources that each fail in some runs, and detail pages that fail for some listings."""
    changes = diff.diff_runs_strict(*_with_sources(spark, sf_dir), with_item=False)
    return changes.select(
        "run_seq", "kind", "listing_key", "old_total_czk", "new_total_czk", "missing_since_seq", "removed_since_seq"
    )


def snapshot_diff_strict_stream(spark, sf_dir):
    """The strict diff computed as the manifest grows, from the stored states of the sources; same result as the batch form."""
    obs, complete = _with_sources(spark, sf_dir)
    store = _stored_runs(spark, sf_dir, "strict-stream", obs=obs)
    store.write_runs("source_states", diff.source_states(complete, store.runs()).coalesce(1))
    streaming.stream_changes(store, store.path("_checkpoint"), runs_per_batch=60, strict=True).awaitTermination()
    schema = schemas.struct(
        "run_seq bigint, kind string, listing_key string, old_total_czk bigint, new_total_czk bigint, "
        "missing_since timestamp, removed_since timestamp"
    )
    hour = lambda c: F.date_format(c, "yyyy-MM-dd HH").alias(c)
    return store.read_or_empty("changes", schema).select(
        "run_seq", "kind", "listing_key", "old_total_czk", "new_total_czk", hour("missing_since"), hour("removed_since")
    )


SNAPSHOT_DIFF_STRICT = f"""
WITH {OBS_SQL},
seen AS (
  SELECT *, CAST(listing_key AS BIGINT) % 3 AS src, (CAST(listing_key AS BIGINT) + run_seq) % 6 = 0 AS failed FROM obs),
calendar AS (
  SELECT src, run_seq, row_number() OVER (PARTITION BY src ORDER BY run_seq) AS seq, count(*) OVER (PARTITION BY src) AS last
  FROM (SELECT DISTINCT src, run_seq FROM seen) WHERE (run_seq * 7 + src * 3) % 10 <> 0),
rows AS (
  SELECT listing_key, src, seq, last, price_czk AS price, failed, price_czk + CASE WHEN failed THEN 0 ELSE 1500 END AS total
  FROM seen JOIN calendar USING (src, run_seq)),
events AS (
  SELECT o.src, o.seq, 'price_change' AS kind, o.listing_key, p.total AS old_total_czk, o.total AS new_total_czk
  FROM rows o JOIN rows p ON p.listing_key = o.listing_key AND (p.seq = o.seq - 1 OR (p.seq = o.seq - 2 AND NOT EXISTS (
    SELECT 1 FROM rows m WHERE m.listing_key = o.listing_key AND m.seq = o.seq - 1)))
  WHERE CASE WHEN o.failed OR p.failed THEN o.price <> p.price ELSE o.total <> p.total END
  UNION ALL
  SELECT src, seq, 'new', listing_key, NULL, NULL FROM rows o WHERE seq > 1 AND NOT EXISTS (
    SELECT 1 FROM rows p WHERE p.listing_key = o.listing_key AND p.seq BETWEEN o.seq - 2 AND o.seq - 1)
  UNION ALL
  SELECT src, seq + 2, 'removed', listing_key, NULL, NULL FROM rows o WHERE seq + 2 <= last AND NOT EXISTS (
    SELECT 1 FROM rows p WHERE p.listing_key = o.listing_key AND p.seq BETWEEN o.seq + 1 AND o.seq + 2))
SELECT c.run_seq, kind, listing_key, old_total_czk, new_total_czk,
       CASE kind WHEN 'removed' THEN m.run_seq END AS missing_since_seq,
       CASE kind WHEN 'removed' THEN c.run_seq END AS removed_since_seq
FROM events e JOIN calendar c ON c.src = e.src AND c.seq = e.seq
LEFT JOIN calendar m ON m.src = e.src AND m.seq = e.seq - 1"""


def pending_removals(spark, sf_dir):
    return diff.pending(observations(spark, sf_dir)).select(
        "listing_key", "price_czk", F.col("run_seq").alias("last_seen_seq"), "missing_since_seq"
    )


def change_history_top(spark, sf_dir):
    newest = marts.newest_events(marts.history_events(_changes(spark, sf_dir)))
    return marts.with_history_lines(newest).select("run_seq", "kind", "listing_key", "line")


CHANGE_HISTORY_TOP = f"""
WITH {CHANGES_SQL}
SELECT run_seq, kind, listing_key,
       CASE kind
         WHEN 'new' THEN 'New: Listing ' || listing_key || ' — ' || {money_sql("item_price_czk", "chr(160)")}
         WHEN 'removed' THEN 'Gone: Listing ' || listing_key || ' — last seen at ' || {money_sql("item_price_czk", "chr(160)")}
         ELSE 'Listing ' || listing_key || ': ' || {money_sql("old_price_czk", "chr(160)")} || ' → ' || {money_sql("new_price_czk", "chr(160)")}
       END AS line
FROM changes
ORDER BY run_seq DESC, CASE kind WHEN 'price_change' THEN 1 WHEN 'new' THEN 2 ELSE 3 END, listing_key
LIMIT 300"""


def events_per_kind(spark, sf_dir):
    obs = observations(spark, sf_dir)
    waiting = diff.pending(obs).select(F.col("missing_since_seq").alias("run_seq"), F.lit("pending").alias("kind"))
    changes = diff.diff_runs(obs, with_item=False).select("run_seq", "kind")
    return stats.events_per_kind(changes.unionByName(waiting))


def rows_per_source(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumnRenamed("event_type", "source")
    return stats.rows_per_source(events, ["source"])


def dedup_last(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("ordinal"))
    return keep_last_in_first_place(events, ["user_id"])


def change_notes(spark, sf_dir):
    obs = observations(spark, sf_dir)
    notes = marts.change_notes(diff.diff_runs(obs, with_item=False))
    return marts.with_change_notes(obs.select("run_seq", "listing_key"), notes)


def changed_flags(spark, sf_dir):
    obs = observations(spark, sf_dir)
    changes = diff.diff_runs(obs, with_item=False)
    return marts.with_changed_flag(obs.select("run_seq", "listing_key", "price_czk"), changes)


def live_or_archived(spark, sf_dir):
    obs = observations(spark, sf_dir)
    now = obs.where(F.col("run_seq") == obs.agg(F.max("run_seq")).scalar())
    events = marts.history_events(diff.diff_runs(obs))
    return marts.live_or_archived(events, now).select(
        "run_seq", "kind", "listing_key", "is_live", F.col("item.run_seq").alias("item_run_seq"),
        F.col("item.price_czk").alias("item_price_czk"),
    )


LIVE_OR_ARCHIVED = f"""
WITH {CHANGES_SQL}
SELECT c.run_seq, kind, c.listing_key, l.listing_key IS NOT NULL AS is_live,
       coalesce(l.run_seq, CASE kind WHEN 'removed' THEN c.run_seq - 2 ELSE c.run_seq END) AS item_run_seq,
       coalesce(l.price_czk, item_price_czk) AS item_price_czk
FROM changes c LEFT JOIN (SELECT o.* FROM obs o, bounds WHERE run_seq = n) l ON l.listing_key = c.listing_key"""


def lookup_priority(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("listing_key"), F.col("c_name").alias("title"), "c_mktsegment"
    )
    watched = customers.where(F.col("c_mktsegment") == "HOUSEHOLD").withColumn("title", F.concat(F.lit("watched "), "title"))
    items = marts.watched_then_listed(watched.drop("c_mktsegment"), customers.drop("c_mktsegment"))
    return marts.preferred_items(items).select("listing_key", "title", "priority")


def listing_mart(spark, sf_dir):
    obs = observations(spark, sf_dir)
    key = F.col("listing_key").cast("bigint")
    listings = schemas.conform(
        obs.select(
            "run_seq", "listing_key", "title", "price_czk", "total_czk", (key % 4 == 0).alias("electricity_estimated"),
            F.when(key % 2 == 0, "pronajem").otherwise("prodej").alias("transaction_type"),
            F.element_at(F.array(*[F.lit(c) for c in C.SOURCE_BADGES]), (key % 3 + 1).cast("int")).alias("source"),
            (key % 5 == 0).alias("fees_missing"),
            F.when(key % 5 == 1, "text").alias("fees_source"),
            F.when(key % 2 == 0, key % 11 * 100).alias("electricity_czk"),
            F.when(key % 5 != 0, key % 7 * 100).alias("fees_czk"),
            F.when(key % 4 == 0, key % 9).alias("floor_number"),
            F.when(key % 8 == 0, F.lit(9)).alias("floors_total"),
            F.when(key % 3 == 0, key % 2 == 0).alias("garage"),
        )
    )
    mart = marts.mart_listings(listings, diff.diff_runs(obs, with_item=False))
    lines = F.transform(
        "cost_lines",
        lambda line: F.concat(
            line["label"], F.lit("="), F.coalesce(line["amount"].cast("string"), F.lit("-")),
            F.coalesce(F.concat(F.lit(" ("), line["note"], F.lit(")")), F.lit(""))),
    )
    return mart.select(
        "run_seq", "listing_key", "change_note", "is_changed", "shown_total", "type_label", "garage_label",
        "floor_label", "source_badge", F.array_join(lines, ";").alias("cost_text"),
    )


LISTING_MART = f"""
WITH {CHANGES_SQL},
typed AS (SELECT *, CAST(listing_key AS BIGINT) AS k FROM obs),
marked AS (
  SELECT t.*, p.old_price_czk, p.new_price_czk, p.listing_key IS NOT NULL AS is_changed, w.listing_key IS NOT NULL AS is_new
  FROM typed t
  LEFT JOIN changes p ON p.kind = 'price_change' AND p.listing_key = t.listing_key AND p.run_seq = t.run_seq
  LEFT JOIN changes w ON w.kind = 'new' AND w.listing_key = t.listing_key AND w.run_seq = t.run_seq)
SELECT run_seq, listing_key,
       CASE WHEN is_changed THEN 'Price changed: ' || {money_sql("old_price_czk")} || ' → ' || {money_sql("new_price_czk")}
            WHEN is_new THEN 'New listing since last check' END AS change_note,
       is_changed,
       {money_sql("price_czk", "chr(160)")} || CASE WHEN k % 10 = 0 THEN '*' ELSE '' END AS shown_total,
       CASE WHEN k % 2 = 0 THEN 'rent' ELSE 'sale' END AS type_label,
       CASE WHEN k % 3 <> 0 THEN 'neuvedeno' WHEN k % 2 = 0 THEN 'Ano' ELSE 'Ne' END AS garage_label,
       CASE WHEN k % 4 = 0 THEN (k % 9) || '/' || CASE WHEN k % 8 = 0 THEN '9' ELSE '?' END ELSE '—' END AS floor_label,
       CASE k % 3 WHEN 0 THEN 'SR' WHEN 1 THEN 'BR' ELSE 'iD' END AS source_badge,
       CASE WHEN k % 2 = 0 THEN 'Nájem (net)=' || price_czk || ';Poplatky / služby=' || CASE k % 5 WHEN 0 THEN '- ({C.FEES_UNSTATED})' ELSE CAST(k % 7 * 100 AS VARCHAR) || CASE k % 5 WHEN 1 THEN ' ({C.FEES_FROM_TEXT})' ELSE '' END END
                 || ';Elektřina=' || k % 11 * 100 || CASE WHEN k % 4 = 0 THEN ' ({C.ESTIMATED})' ELSE ' ({C.ELECTRICITY_STATED})' END
                 || ';Celkem (s elektřinou)=' || price_czk || CASE WHEN k % 5 = 0 THEN ' ({C.FEES_AS_ZERO})' ELSE '' END
            ELSE 'Cena=' || price_czk END AS cost_text
FROM marked"""


def _stored_runs(spark, sf_dir, name, uncommitted=0, obs=None):
    """All runs of the observations written, and all but the last `uncommitted` of them committed."""
    store = Store(spark, work_dir(spark, name))
    store.write_runs("listings", schemas.conform(observations(spark, sf_dir) if obs is None else obs))
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    written = store.read_or_empty("listings", schemas.LISTING).select("run_seq").distinct()
    committed = written.where(F.col("run_seq") <= written.agg(F.max("run_seq")).scalar() - uncommitted)
    manifest = committed.select(
        "run_seq",
        (F.lit(start).cast("timestamp") + F.make_dt_interval(hours=(F.col("run_seq") * 8).cast("int"))).alias("generated_at"),
    ).withColumn("run_id", F.date_format("generated_at", "yyyyMMdd'T'HHmmss'Z'"))
    store.write_runs("runs", manifest.coalesce(1))
    return store


def store_roundtrip(spark, sf_dir):
    """All runs written, the last one not committed: what is visible per run, and the rows of the latest."""
    store = _stored_runs(spark, sf_dir, "roundtrip", uncommitted=1)
    visible = store.committed("listings", schemas.LISTING).groupBy("run_seq").agg(F.count(F.lit(1)).alias("visible"))
    latest = store.latest("listings", schemas.LISTING).select("run_seq", "listing_key", "price_czk")
    return visible.join(store.runs().select("run_seq", "run_id"), "run_seq").join(latest, "run_seq", "left")


STORE_ROUNDTRIP = f"""
WITH {OBS_SQL}
SELECT v.run_seq, v.visible, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(v.run_seq * 8 AS INTEGER)), '%Y%m%dT%H%M%SZ') AS run_id,
       o.listing_key, o.price_czk
FROM (SELECT run_seq, count(*) AS visible FROM obs, bounds WHERE run_seq < n GROUP BY 1) v CROSS JOIN bounds
LEFT JOIN obs o ON o.run_seq = v.run_seq AND v.run_seq = (SELECT max(run_seq) FROM obs, bounds WHERE run_seq < n)"""


def snapshot_diff_stream(spark, sf_dir):
    """The diff computed run by run as the manifest grows; same result as the batch form."""
    store = _stored_runs(spark, sf_dir, "stream")
    query = streaming.stream_changes(store, store.path("_checkpoint"), runs_per_batch=60)
    query.awaitTermination()
    schema = schemas.struct(
        "run_seq bigint, kind string, listing_key string, old_price_czk bigint, new_price_czk bigint, "
        "old_total_czk bigint, new_total_czk bigint, missing_since timestamp, removed_since timestamp"
    )
    return store.read_or_empty("changes", schema).select(
        "run_seq", "kind", "listing_key", "old_price_czk", "new_price_czk",
        F.date_format("missing_since", "yyyy-MM-dd HH").alias("missing_since"),
        F.date_format("removed_since", "yyyy-MM-dd HH").alias("removed_since"),
    )


SNAPSHOT_DIFF_STREAM = f"""
WITH {CHANGES_SQL}
SELECT run_seq, kind, listing_key, old_price_czk, new_price_czk,
       strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(missing_since_seq * 8 AS INTEGER)), '%Y-%m-%d %H') AS missing_since,
       strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(removed_since_seq * 8 AS INTEGER)), '%Y-%m-%d %H') AS removed_since
FROM changes"""


def price_stats_by_run(spark, sf_dir):
    """Statistics of every run from the stored changes of values; a third of the listings have no type."""
    obs = observations(spark, sf_dir)
    key = F.col("listing_key").cast("bigint")
    typed = obs.withColumn("transaction_type", F.when(key % 3 == 0, C.RENT).when(key % 3 == 1, C.SALE))
    last_run = obs.agg(F.max("run_seq")).first()[0] or 0
    path = f"{work_dir(spark, 'value-changes')}/value_changes"
    run_stats.value_changes(typed, ["transaction_type"], "price_czk", last_run).write.parquet(path)
    return run_stats.price_stats_by_run(spark.read.parquet(path), ["transaction_type"], "price_czk", last_run)


QUERIES = {
    "snapshot_diff": snapshot_diff,
    "snapshot_diff_pair": snapshot_diff_pair,
    "snapshot_diff_strict": snapshot_diff_strict,
    "pending_removals": pending_removals,
    "change_history_top": change_history_top,
    "events_per_kind": events_per_kind,
    "rows_per_source": rows_per_source,
    "dedup_last": dedup_last,
    "change_notes": change_notes,
    "changed_flags": changed_flags,
    "live_or_archived": live_or_archived,
    "lookup_priority": lookup_priority,
    "listing_mart": listing_mart,
    "store_roundtrip": store_roundtrip,
    "snapshot_diff_stream": snapshot_diff_stream,
    "snapshot_diff_strict_stream": snapshot_diff_strict_stream,
    "price_stats_by_run": price_stats_by_run,
}

ORACLES = {
    "snapshot_diff": f"WITH {CHANGES_SQL} SELECT * FROM changes",
    "snapshot_diff_pair": SNAPSHOT_DIFF_PAIR,
    "snapshot_diff_strict": SNAPSHOT_DIFF_STRICT,
    "pending_removals": f"""
        WITH {OBS_SQL}
        SELECT listing_key, price_czk, run_seq AS last_seen_seq, n AS missing_since_seq
        FROM obs o, bounds
        WHERE run_seq = n - 1 AND NOT EXISTS (
          SELECT 1 FROM obs c WHERE c.listing_key = o.listing_key AND c.run_seq = n)""",
    "change_history_top": CHANGE_HISTORY_TOP,
    "events_per_kind": f"""
        WITH {CHANGES_SQL}
        SELECT run_seq, kind, count(*) AS events FROM changes GROUP BY ALL
        UNION ALL
        SELECT n, 'pending', count(*) FROM sided WHERE run_seq = n - 1 AND s1 IS NULL GROUP BY n""",
    "rows_per_source": "SELECT event_type AS source, count(*) AS listings FROM events GROUP BY 1",
    "dedup_last": """
        SELECT e.user_id, e.event_type, e.value, m.low AS ordinal
        FROM events e JOIN (SELECT user_id, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY 1) m
          ON e.user_id = m.user_id AND e.event_id = m.high""",
    "change_notes": f"""
        WITH {CHANGES_SQL}
        SELECT o.run_seq, o.listing_key,
               CASE c.kind WHEN 'new' THEN 'New listing since last check'
                 WHEN 'price_change' THEN 'Price changed: ' || {money_sql("c.old_price_czk")} || ' → ' || {money_sql("c.new_price_czk")} END AS change_note
        FROM obs o LEFT JOIN changes c
          ON c.kind <> 'removed' AND c.listing_key = o.listing_key AND c.run_seq = o.run_seq""",
    "changed_flags": f"""
        WITH {CHANGES_SQL}
        SELECT o.run_seq, o.listing_key, o.price_czk, EXISTS (
                 SELECT 1 FROM changes c WHERE c.kind = 'price_change' AND c.listing_key = o.listing_key
                   AND c.run_seq = o.run_seq) AS is_changed
        FROM obs o""",
    "live_or_archived": LIVE_OR_ARCHIVED,
    "lookup_priority": """
        SELECT CAST(c_custkey AS VARCHAR) AS listing_key,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'watched ' || c_name ELSE c_name END AS title,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 0 ELSE 1 END AS priority
        FROM customer""",
    "listing_mart": LISTING_MART,
    "store_roundtrip": STORE_ROUNDTRIP,
    "snapshot_diff_stream": SNAPSHOT_DIFF_STREAM,
    "snapshot_diff_strict_stream": f"""
        SELECT run_seq, kind, listing_key, old_total_czk, new_total_czk,
               strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(missing_since_seq * 8 AS INTEGER)), '%Y-%m-%d %H') AS missing_since,
               strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(removed_since_seq * 8 AS INTEGER)), '%Y-%m-%d %H') AS removed_since
        FROM ({SNAPSHOT_DIFF_STRICT})""",
    "price_stats_by_run": f"""
        WITH {OBS_SQL}
        SELECT run_seq, CASE CAST(listing_key AS BIGINT) % 3 WHEN 0 THEN '{C.RENT}' WHEN 1 THEN '{C.SALE}' END AS transaction_type,
               CAST(round_even(median(price_czk), 0) AS BIGINT) AS median_per_sqm,
               CAST(round_even(avg(price_czk), 0) AS BIGINT) AS avg_per_sqm, count(*) AS n
        FROM obs WHERE price_czk <> 0 GROUP BY ALL""",
}
