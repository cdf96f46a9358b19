"""Driver tables mapped onto the library's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwatch.functions.costs import half_even
from offerwatch.operators.dedup import keep_last


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a driver table that one task turns into pages.
ROWS_PER_TASK = 10_000


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows dealt out by a column, to as many tasks as there are rows for.

    Pages are a hundred times as wide as the rows they are made from. Whoever
    reads a small file in one scan task would make and sort all pages there.
    """
    return df.repartition(-(-df.count() // ROWS_PER_TASK) or 1, by)


def run_number(ts: Column) -> Column:
    """Eight-hour runs, counted from the start of 2024."""
    day = F.date_diff(ts.cast("date"), F.lit("2024-01-01").cast("date"))
    return (day * 3 + F.floor(F.hour(ts) / 8) + 1).cast("bigint")


def run_time(run_seq: Column) -> Column:
    """When such a run starts."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return start + F.make_dt_interval(hours=((run_seq - 1) * 8).cast("int"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings: a user is a listing, its last value in a run the price."""
    events = load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("listing_key"),
        run_number(F.col("ts")).alias("run_seq"),
        half_even(F.col("value")).alias("price_czk"),
        "ts",
        "event_id",
    )
    last = keep_last(events, ["listing_key", "run_seq"], ["ts", "event_id"])
    return last.select(
        "run_seq",
        "listing_key",
        "price_czk",
        F.col("price_czk").alias("total_czk"),
        F.lit(True).alias("electricity_estimated"),
        F.concat(F.lit("Listing "), F.col("listing_key")).alias("title"),
    )


# The same mapping in SQL.
RUN_SQL = "(date_diff('day', DATE '2024-01-01', CAST({ts} AS DATE)) * 3 + hour({ts}) // 8 + 1)"

OBS_SQL = f"""
numbered AS (
  SELECT CAST(user_id AS VARCHAR) AS listing_key, {RUN_SQL.format(ts="ts")} AS run_seq,
         CAST(round_even(value, 0) AS BIGINT) AS price_czk, ts, event_id
  FROM events),
obs AS (
  SELECT listing_key, run_seq, price_czk
  FROM (SELECT *, row_number() OVER (PARTITION BY listing_key, run_seq ORDER BY ts DESC, event_id DESC) AS rn
        FROM numbered)
  WHERE rn = 1),
bounds AS (SELECT max(run_seq) AS n FROM obs)"""

# Events of the whole history by looking one and two runs back and ahead, given `obs` and `bounds`.
EVENTS_SQL = """
sided AS (
  SELECT o.*, n, b1.run_seq AS r1, b2.run_seq AS r2,
         CASE WHEN b1.run_seq IS NOT NULL THEN b1.price_czk ELSE b2.price_czk END AS old_price,
         a1.run_seq AS s1, a2.run_seq AS s2
  FROM obs o CROSS JOIN bounds
  LEFT JOIN obs b1 ON b1.listing_key = o.listing_key AND b1.run_seq = o.run_seq - 1
  LEFT JOIN obs b2 ON b2.listing_key = o.listing_key AND b2.run_seq = o.run_seq - 2
  LEFT JOIN obs a1 ON a1.listing_key = o.listing_key AND a1.run_seq = o.run_seq + 1
  LEFT JOIN obs a2 ON a2.listing_key = o.listing_key AND a2.run_seq = o.run_seq + 2),
changes AS (
  SELECT run_seq, 'new' AS kind, listing_key, NULL::BIGINT AS old_price_czk, NULL::BIGINT AS new_price_czk,
         run_seq AS first_seen_seq, NULL::BIGINT AS missing_since_seq, NULL::BIGINT AS removed_since_seq,
         price_czk AS item_price_czk
  FROM sided WHERE r1 IS NULL AND r2 IS NULL AND run_seq > 1
  UNION ALL
  SELECT run_seq, 'price_change', listing_key, old_price, price_czk, NULL, NULL, NULL, price_czk
  FROM sided WHERE (r1 IS NOT NULL OR r2 IS NOT NULL) AND old_price IS DISTINCT FROM price_czk
  UNION ALL
  SELECT run_seq + 2, 'removed', listing_key, NULL, NULL, NULL, run_seq + 1, run_seq + 2, price_czk
  FROM sided WHERE s1 IS NULL AND s2 IS NULL AND run_seq + 2 <= n)"""

CHANGES_SQL = f"{OBS_SQL},{EVENTS_SQL}"


def money_sql(value: str, group: str = "' '") -> str:
    return f"(CASE WHEN {value} IS NULL THEN '—' ELSE replace(format('{{:,}}', CAST({value} AS BIGINT)), ',', {group}) || ' Kč' END)"
