"""Watch list and watched states over customers, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerwatch.catalog.tables import CHANGES_SQL, RUN_SQL, load, money_sql, observations, run_number, run_time
from offerwatch.functions.costs import half_even
from offerwatch.operators import diff, watch
from offerwatch.operators.dedup import keep_last
from offerwatch.plans import marts, monitor
from offerwatch.plans.store import Store
from offerwatch.session import work_dir
from offerwatch.streaming import runs as streaming


def watch_add_remove(spark, sf_dir):
    """Customers are listed, page URLs added in page order, customers of little means removed by their ids in between."""
    listed = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("listing_key"), F.col("c_name").alias("url")
    )
    adds = load(spark, sf_dir, "pages").select(F.lit("add").alias("op"), F.col("url").alias("arg"), F.col("page_id").alias("ts"))
    removes = load(spark, sf_dir, "customer").where(F.col("c_acctbal") < 1000).select(
        F.lit("remove").alias("op"), F.col("c_custkey").cast("string").alias("arg"), F.lit(50).cast("bigint").alias("ts")
    )
    usable, rejects = watch.read_edits(adds.unionByName(removes))
    kept = watch.apply_edits(listed, usable).withColumn("outcome", F.lit("listed"))
    return kept.unionByName(
        rejects.select(F.lit(None).cast("string").alias("listing_key"), "url", F.lit("rejected").alias("outcome"))
    )


WATCH_ADD_REMOVE = """
WITH adds AS (
  SELECT url, page_id AS ts, CAST(CAST(nullif(regexp_extract(trim(url), '/(\\d+)/?$', 1), '') AS BIGINT) AS VARCHAR) AS key FROM pages),
removed AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_acctbal < 1000),
old AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS url FROM customer WHERE c_acctbal >= 1000),
fresh AS (SELECT key, arg_min(url, ts) AS url FROM adds
          WHERE key IS NOT NULL AND (ts > 50 OR key NOT IN (SELECT key FROM removed)) GROUP BY key)
SELECT key AS listing_key, url, 'listed' AS outcome FROM old
UNION ALL
SELECT key, url, 'listed' FROM fresh WHERE key NOT IN (SELECT key FROM old)
UNION ALL
SELECT NULL, url, 'rejected' FROM adds WHERE key IS NULL"""


def _reads(spark, sf_dir):
    """Events as watched reads: an error is unreadable, a signup means gone."""
    events = load(spark, sf_dir, "events").select(
        run_number(F.col("ts")).alias("run_seq"), F.col("user_id").cast("string").alias("listing_key"),
        "event_type", "value", "ts", "event_id",
    )
    last = keep_last(events, ["run_seq", "listing_key"], ["ts", "event_id"])
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "unreadable").when(kind == "signup", "gone").otherwise("ok")
    total = half_even(F.col("value"))
    payload = F.struct(
        F.concat(F.lit("Listing "), F.col("listing_key")).alias("title"),
        total.alias("rent_czk"), total.alias("total_czk"), F.lit(True).alias("electricity_estimated"),
    )
    return last.select(
        "run_seq",
        "listing_key",
        outcome.alias("outcome"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"),
        F.when(outcome != "ok", F.concat(kind, F.lit(" "), F.col("event_id").cast("string"))).alias("error"),
        F.when(outcome == "ok", payload).alias("payload"),
    )


READS_SQL = f"""
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS listing_key, {RUN_SQL.format(ts="ts")} AS run_seq, event_type, value, ts, event_id FROM events),
reads AS (
  SELECT listing_key, run_seq,
         CASE event_type WHEN 'error' THEN 'unreadable' WHEN 'signup' THEN 'gone' ELSE 'ok' END AS outcome,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS fetched_at,
         CASE WHEN event_type IN ('error', 'signup') THEN event_type || ' ' || event_id END AS error,
         CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(round_even(value, 0) AS BIGINT) END AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY listing_key, run_seq ORDER BY ts DESC, event_id DESC) AS rn FROM raw)
  WHERE rn = 1)"""

# Everything that follows from one read per run and listing.
RULES_SQL = """
islands AS (
  SELECT *, run_seq - row_number() OVER (PARTITION BY listing_key ORDER BY run_seq) AS island FROM reads),
marked AS (
  SELECT *, max(CASE WHEN outcome = 'ok' THEN run_seq END) OVER w AS ok_run,
         max(CASE WHEN outcome <> 'unreadable' THEN run_seq END) OVER w AS read_run,
         min(run_seq) OVER (PARTITION BY listing_key, island) AS first_run
  FROM islands WINDOW w AS (PARTITION BY listing_key, island ORDER BY run_seq)),
states AS (
  SELECT m.run_seq, m.listing_key, m.outcome, coalesce(r.outcome = 'ok', false) AS active,
         coalesce(r.fetched_at, f.fetched_at) AS fetched_at,
         CASE WHEN r.run_seq IS NULL THEN f.error ELSE r.error END AS error,
         CASE WHEN r.outcome = 'gone' THEN k.fetched_at END AS last_active_at,
         CASE WHEN f.outcome = 'unreadable' AND k.run_seq IS NULL THEN true END AS unavailable,
         CASE WHEN m.outcome = 'unreadable' AND m.run_seq > m.first_run THEN m.error END AS fetch_error,
         CASE WHEN m.outcome = 'unreadable' AND m.run_seq > m.first_run THEN m.fetched_at END AS fetch_error_at,
         k.total AS total_czk
  FROM marked m
  LEFT JOIN reads r ON r.listing_key = m.listing_key AND r.run_seq = m.read_run
  LEFT JOIN reads k ON k.listing_key = m.listing_key AND k.run_seq = m.ok_run
  JOIN reads f ON f.listing_key = m.listing_key AND f.run_seq = m.first_run),
moved AS (
  SELECT n.run_seq, n.listing_key, p.total_czk AS old_total_czk, n.total_czk AS new_total_czk
  FROM states n JOIN states p ON p.listing_key = n.listing_key AND p.run_seq = n.run_seq - 1
  WHERE n.active AND n.total_czk IS DISTINCT FROM p.total_czk)"""

STATE_SQL = f"{READS_SQL},{RULES_SQL}"

_STATE = [c for c in watch.STATE_COLUMNS if c != "payload"]


def watch_carry_forward(spark, sf_dir):
    states = watch.carry_forward(_reads(spark, sf_dir))
    return states.select(*_STATE, F.col("payload.total_czk").alias("total_czk"))


def watch_carry_forward_stream(spark, sf_dir):
    """The states of all runs computed as the manifest grows; same result as the batch form."""
    store = Store(spark, work_dir(spark, "watch"))
    reads = _reads(spark, sf_dir)
    store.write_runs("watched_reads", reads)
    written = store.read_or_empty("watched_reads", reads.schema)
    manifest = written.select("run_seq").distinct().select(
        "run_seq", F.lit(None).cast("timestamp").alias("generated_at"), F.col("run_seq").cast("string").alias("run_id")
    )
    store.write_runs("runs", manifest.coalesce(1))
    state_schema = watch.carry_forward(reads).schema
    query = streaming.stream_watch_states(
        store, store.path("_checkpoint"), reads_schema=reads.schema, state_schema=state_schema
    )
    query.awaitTermination()
    states = store.read_or_empty("watched_states", state_schema)
    return states.select(*_STATE, F.col("payload.total_czk").alias("total_czk"))


def watch_changes(spark, sf_dir):
    return watch.watched_changes(watch.carry_forward(_reads(spark, sf_dir)))


def watched_mart(spark, sf_dir):
    reads = _reads(spark, sf_dir)
    states = watch.carry_forward(reads)
    names = ["title", "rent_czk", "total_czk", "electricity_estimated"]
    p = F.col("payload")
    wide = {
        "transaction_type": "string", "disposition": "string", "fees_czk": "bigint", "fees_missing": "boolean",
        "fees_source": "string", "electricity_czk": "bigint", "garage": "boolean", "parking": "boolean",
        "floor_area_sqm": "double", "price_czk_per_sqm": "bigint", "floor_number": "int", "floors_total": "int",
        "locality": "string", "city_part": "string", "street": "string", "description": "string",
        "seller_name": "string", "thumb": "string", "lat": "double", "lon": "double", "images": "array<string>",
    }
    full = F.struct(*[p[n].alias(n) for n in names], *[F.lit(None).cast(t).alias(n) for n, t in wide.items()])
    states = states.withColumn("payload", full).withColumn("last_active_at", F.concat("last_active_at", F.lit("+00:00")).cast("timestamp"))
    watchlist = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("listing_key"), F.col("c_name").alias("url"))
    moved = watch.watched_changes(states)
    notes = marts.change_notes(moved.select("run_seq", "listing_key", F.lit("new").alias("kind"), "old_total_czk", "new_total_czk"), moved)
    items = marts.watched_items(states, watchlist, notes)
    return items.select("run_seq", "listing_key", "title", "transaction_type", "price_czk", "active", "url", "change_note")


WATCHED_MART = f"""
WITH {STATE_SQL}
SELECT s.run_seq, s.listing_key, CASE WHEN s.total_czk IS NOT NULL THEN 'Listing ' || s.listing_key END AS title,
       'pronajem' AS transaction_type, s.total_czk AS price_czk, s.active, c_name AS url,
       CASE WHEN m.listing_key IS NOT NULL THEN 'Price changed: ' || {money_sql("m.old_total_czk")} || ' → ' || {money_sql("m.new_total_czk")}
            WHEN NOT s.active AND s.last_active_at IS NOT NULL
            THEN 'No longer listed — showing last known details from ' || replace(s.last_active_at, ' ', 'T') || 'Z' END AS change_note
FROM states s LEFT JOIN moved m ON m.run_seq = s.run_seq AND m.listing_key = s.listing_key
LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = s.listing_key"""


def watchlist_run(spark, sf_dir):
    """Customers as the list, events as what landed for them; the list is edited before runs 31 and 61.

    First the customers of little means leave, then those in debt come back
    under a new URL. Each edit makes a version of the stored list, and every run
    gives each listing of its version a state.
    """
    store = Store(spark, work_dir(spark, "watchlist"))
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name", "c_acctbal")
    store.write_watchlist(customers.select(F.col("key").alias("listing_key"), F.col("c_name").alias("url")))
    leaving = customers.where("c_acctbal < 1000").select(
        F.lit("remove").alias("op"), F.col("key").alias("arg"), F.lit(1).alias("ts")
    )
    back = customers.where("c_acctbal < 0").select(
        F.lit("add").alias("op"), F.concat(F.lit("https://main/detail/"), "key", F.lit("/")).alias("arg"), F.lit(2).alias("ts")
    )
    landed = _reads(spark, sf_dir)
    last = load(spark, sf_dir, "events").agg(F.max(run_number(F.col("ts")))).scalar()
    spans = [(F.lit(1), F.least(F.lit(30), last)), (F.lit(31), F.least(F.lit(60), last)), (F.lit(61), last)]
    listed = None
    for edits, (low, high) in zip([None, leaving, back], spans, strict=True):
        if edits is not None:
            monitor.edit_watchlist(store, edits)
        runs = F.when(low <= high, F.sequence(low.cast("bigint"), high.cast("bigint")))
        version = store.watchlist().select(F.explode(runs).alias("run_seq"), "listing_key", "url")
        listed = version if listed is None else listed.unionByName(version)
    listed = listed.withColumn("fetched_at", F.date_format(run_time(F.col("run_seq")), "yyyy-MM-dd HH:mm:ss"))
    reads = watch.reads_of_list(listed, landed)
    states = watch.carry_forward(reads, along=("url",))
    return states.select(*_STATE, "url", F.col("payload.total_czk").alias("total_czk"))


WATCHLIST_RUN = f"""
WITH {READS_SQL.replace("reads AS (", "landed AS (")},
listed AS (
  SELECT CAST(c_custkey AS VARCHAR) AS listing_key, r.run_seq,
         CASE WHEN r.run_seq > 60 AND c_acctbal < 0 THEN 'https://main/detail/' || c_custkey || '/' ELSE c_name END AS url
  FROM customer, (SELECT unnest(range(1, max(run_seq) + 1)) AS run_seq FROM landed) r
  WHERE r.run_seq <= 30 OR c_acctbal >= 1000 OR (r.run_seq > 60 AND c_acctbal < 0)),
reads AS (
  SELECT listing_key, run_seq, l.url, coalesce(d.outcome, 'unreadable') AS outcome,
         coalesce(d.fetched_at, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST((run_seq - 1) * 8 AS INTEGER)), '%Y-%m-%d %H:%M:%S')) AS fetched_at,
         CASE WHEN d.outcome IS NULL THEN l.url || ': no answer' ELSE d.error END AS error, d.total
  FROM listed l LEFT JOIN landed d USING (listing_key, run_seq)),
{RULES_SQL}
SELECT s.*, r.url FROM states s JOIN reads r USING (run_seq, listing_key)"""


def history_mart(spark, sf_dir):
    """The whole history as served: changes of listings and of watched ones, dated, with the item as it is now."""
    states = watch.carry_forward(_reads(spark, sf_dir))
    obs = observations(spark, sf_dir)
    found = marts.history_events(diff.diff_runs(obs), watch.watched_changes(states))
    lines = marts.with_history_lines(found.withColumn("at", run_time(F.col("run_seq"))))
    last = obs.agg(F.max("run_seq")).scalar()
    now = states.where(F.col("run_seq") == last).select(
        "run_seq", "listing_key", F.col("payload.title").alias("title"), F.col("payload.total_czk").alias("price_czk")
    )
    items = marts.watched_then_listed(now, obs.where(F.col("run_seq") == last))
    shown = marts.live_or_archived(lines, marts.preferred_items(items))
    return shown.select(
        "run_seq", F.date_format("at", "yyyy-MM-dd HH").alias("at"), "kind", "is_watched", "listing_key", "line", "is_live",
        F.col("item.run_seq").alias("item_run_seq"), F.col("item.price_czk").alias("item_price_czk"),
    )


HISTORY_MART = f"""
WITH {CHANGES_SQL}, {STATE_SQL},
last_run AS (SELECT listing_key, total_czk FROM states, bounds WHERE run_seq = n),
events AS (
  SELECT run_seq, kind, false AS is_watched, listing_key, 'Listing ' || listing_key AS title, old_price_czk AS old, new_price_czk AS new,
         CASE kind WHEN 'removed' THEN run_seq - 2 ELSE run_seq END AS item_run_seq, item_price_czk
  FROM changes
  UNION ALL
  SELECT run_seq, 'price_change', true, listing_key, '#' || listing_key, old_total_czk, new_total_czk, NULL, NULL FROM moved)
SELECT e.run_seq, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST((e.run_seq - 1) * 8 AS INTEGER)), '%Y-%m-%d %H') AS "at",
       kind, is_watched, listing_key,
       CASE kind
         WHEN 'new' THEN 'New: ' || title || ' — ' || {money_sql("item_price_czk", "chr(160)")}
         WHEN 'removed' THEN 'Gone: ' || title || ' — last seen at ' || {money_sql("item_price_czk", "chr(160)")}
         ELSE title || ': ' || {money_sql("old", "chr(160)")} || ' → ' || {money_sql("new", "chr(160)")} END AS line,
       l.listing_key IS NOT NULL AS is_live,
       CASE WHEN l.listing_key IS NULL THEN e.item_run_seq ELSE n END AS item_run_seq,
       CASE WHEN l.listing_key IS NULL THEN e.item_price_czk ELSE l.total_czk END AS item_price_czk
FROM events e CROSS JOIN bounds LEFT JOIN last_run l USING (listing_key)"""


QUERIES = {
    "watch_add_remove": watch_add_remove,
    "watch_carry_forward": watch_carry_forward,
    "watch_carry_forward_stream": watch_carry_forward_stream,
    "watch_changes": watch_changes,
    "watched_mart": watched_mart,
    "watchlist_run": watchlist_run,
    "history_mart": history_mart,
}

ORACLES = {
    "watch_add_remove": WATCH_ADD_REMOVE,
    "watch_carry_forward": f"WITH {STATE_SQL} SELECT * FROM states",
    "watch_carry_forward_stream": f"WITH {STATE_SQL} SELECT * FROM states",
    "watch_changes": f"WITH {STATE_SQL} SELECT * FROM moved",
    "watched_mart": WATCHED_MART,
    "watchlist_run": WATCHLIST_RUN,
    "history_mart": HISTORY_MART,
}
