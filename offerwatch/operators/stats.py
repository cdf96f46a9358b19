"""Price statistics and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.functions.costs import half_even

# Consecutive values per coarse bucket. A bucket holds at most this many distinct
# values, and values below BUCKET squared make at most this many buckets.
BUCKET = 1 << 20


def price_stats(df: DataFrame, by: list[str], value: str, levels: list[list[str]] | None = None) -> DataFrame:
    """Exact median, mean and count of a positive bigint per group, rounded half to even.

    The built-in exact median gathers a group's distinct values in one place.
    Here equal values are counted first, then a coarse histogram finds the
    bucket the middle ranks fall into, and only that bucket's distinct values are
    ranked; a group of any size costs one task a bounded number of rows.

    `levels` lists subsets of `by` to report as well, as in grouping sets; a
    `grain` column then counts the columns a row is grouped by.
    """
    v = F.col(value)
    counted = (
        df.where(v.isNotNull() & (v != 0)).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    group = list(by)
    if levels:
        types = dict(counted.dtypes)
        sets = F.array(
            *[
                F.struct(
                    *[(F.col(c) if c in level else F.lit(None).cast(types[c])).alias(c) for c in by],
                    F.lit(len(level)).cast("bigint").alias("grain"),
                )
                for level in levels
            ]
        )
        counted = (
            counted.select(F.explode(sets).alias("_g"), "_v", "_c")
            .select("_g.*", "_v", "_c")
            .groupBy(*by, "grain", "_v")
            .agg(F.sum("_c").alias("_c"))
        )
        group.append("grain")
    counted = counted.withColumn("_b", F.floor(F.col("_v") / BUCKET))

    coarse = counted.groupBy(*group, "_b").agg(
        F.sum("_c").alias("_c"), F.sum(F.col("_v").cast("decimal(20,0)") * F.col("_c")).alias("_s")
    )
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    middle = (
        coarse.select(
            *group,
            "_b",
            (F.sum("_c").over(upto) - F.col("_c")).alias("_below"),
            F.col("_c").alias("_here"),
            F.sum("_c").over(whole).alias("n"),
            F.sum("_s").over(whole).alias("_total"),
        )
        .withColumn("_lo", F.expr("(n - 1) div 2"))
        .withColumn("_hi", F.expr("n div 2"))
        .where((F.col("_below") <= F.col("_hi")) & (F.col("_below") + F.col("_here") > F.col("_lo")))
        .drop("_here")
    )
    fine, mid = counted.alias("fine"), middle.alias("mid")
    same = F.lit(True)
    for c in [*group, "_b"]:
        same = same & F.col(f"fine.{c}").eqNullSafe(F.col(f"mid.{c}"))
    near = fine.join(mid, same).select("fine.*", "_below", "n", "_total", "_lo", "_hi")
    ranks = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("_rank", F.col("_below") + F.sum("_c").over(ranks))
    out = ranked.groupBy(*group).agg(
        F.min(F.when(F.col("_rank") > F.col("_lo"), F.col("_v"))).alias("_low"),
        F.min(F.when(F.col("_rank") > F.col("_hi"), F.col("_v"))).alias("_high"),
        F.first("_total").alias("_total"),
        F.first("n").alias("n"),
    )
    return out.select(
        *group,
        half_even((F.col("_low") + F.col("_high")) / 2).alias("median_per_sqm"),
        half_even(F.col("_total").cast("double") / F.col("n")).alias("avg_per_sqm"),
        F.col("n").alias("n"),
    )


def wide_stats(
    stats: DataFrame, by: list[str], tx: str = "transaction_type", names: dict[str, str] | None = None
) -> DataFrame:
    """One row per `by` (or one in all) with median, mean and count of each type side by side.
    A type without values has nulls and a zero count."""
    names = names or {C.RENT: "rent", C.SALE: "sale"}
    columns = []
    for value, name in names.items():
        def pick(column, value=value):
            return F.max(F.when(F.col(tx) == value, F.col(column)))

        columns += [
            pick("median_per_sqm").alias(f"{name}_median_czk_per_sqm"),
            pick("avg_per_sqm").alias(f"{name}_avg_czk_per_sqm"),
            F.coalesce(pick("n"), F.lit(0)).alias(f"{name}_count"),
        ]
    return stats.groupBy(*by).agg(*columns) if by else stats.agg(*columns)


def events_per_kind(changes: DataFrame) -> DataFrame:
    return changes.groupBy("run_seq", "kind").agg(F.count(F.lit(1)).alias("events"))


def rows_per_source(listings: DataFrame, by: list[str]) -> DataFrame:
    return listings.groupBy(*by).agg(F.count(F.lit(1)).alias("listings"))
