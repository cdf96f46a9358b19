"""Price statistics of every run, from what changed between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerwatch.functions.costs import half_even

#: A value is found by its digits, the highest first; so many bits make a digit.
DIGIT = 8


def value_changes(sightings: DataFrame, by: list[str], value: str, last_run: int) -> DataFrame:
    """run_seq, by, value, d: how many listings of a group took a value in a run, less those that left it.

    `sightings` has one row per run and listing; runs are numbered without gaps.
    A listing counts from the run it is seen in to the next one; where it keeps
    its value both cancel, so only changes are left. Null and zero are no values.
    """
    seen = sightings.where(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy("run_seq", *by, value).agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(
        F.struct(F.col("run_seq").alias("run_seq"), F.col("n").alias("d")),
        F.struct((F.col("run_seq") + 1).alias("run_seq"), (-F.col("n")).alias("d")),
    )
    moved = seen.select(*by, value, F.explode(steps).alias("_s")).select("_s.run_seq", *by, value, "_s.d")
    summed = moved.where(F.col("run_seq") <= last_run).groupBy("run_seq", *by, value).agg(F.sum("d").alias("d"))
    return summed.where(F.col("d") != 0)


def price_stats_by_run(changes: DataFrame, by: list[str], value: str, last_run: int) -> DataFrame:
    """Exact median, mean and count per run and group, rounded half to even; groups without a value have no row.

    The middle ranks of a run are followed digit by digit: the changes summed
    along the runs give the counts of the next digit, of those values only that
    share the digits found so far. So a run costs at most 2^DIGIT counts a digit
    and rank, however many listings it has, and a task holds at most the runs of
    one such count.
    """
    low, high = changes.agg(F.min(value), F.max(value)).first()
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    rows = changes.select(group.alias("_g"), "run_seq", "d", F.col(value).cast("decimal(20,0)").alias("_v"), (F.col(value) - F.lit(low or 0)).alias("_u"))

    # all runs of a group, those without a change as well
    along = Window.partitionBy("_g").orderBy("run_seq")
    per_run = rows.groupBy("_g", "run_seq").agg(F.sum("d").alias("_d"), F.sum(F.col("_v") * F.col("d")).alias("_s"))
    until = F.coalesce(F.lead("run_seq").over(along) - 1, F.lit(last_run))
    totals = (
        per_run.select("_g", "run_seq", F.sum("_d").over(along).alias("n"), F.sum("_s").over(along).alias("_total"), until.alias("_until"))
        .where(F.col("n") > 0)
        .select("_g", F.explode(F.sequence("run_seq", "_until")).alias("run_seq"), "n", "_total")
    )
    ranks = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    found = totals.select("_g", "run_seq", F.lit(0).cast("bigint").alias("_p"), ranks.alias("_ranks"))

    digits = max(1, -(-int((high or 0) - (low or 0)).bit_length() // DIGIT))
    for digit in reversed(range(digits)):
        found = _next_digit(rows, found, DIGIT * digit)
    middle = found.groupBy("_g", "run_seq").agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"))
    both = totals.join(middle, ["_g", "run_seq"])
    median = (F.col("_low") + F.col("_high")) / 2 + F.lit(low or 0)
    return both.select(
        "run_seq", *[F.col(f"_g.{c}").alias(c) for c in by], half_even(median).alias("median_per_sqm"),
        half_even(F.col("_total").cast("double") / F.col("n")).alias("avg_per_sqm"), "n",
    )


def _next_digit(rows: DataFrame, found: DataFrame, shift: int) -> DataFrame:
    """The prefixes `_p` of the wanted ranks, one digit longer; ranks count within the prefix."""
    child = F.shiftright("_u", shift)
    changed = rows.groupBy("_g", child.alias("_c"), "run_seq").agg(F.sum("d").alias("d")).where(F.col("d") != 0)
    children = changed.select("_g", F.shiftright("_c", DIGIT).alias("_p"), "_c").distinct()
    asked = found.join(children, ["_g", "_p"]).select("_g", "_c", "run_seq", F.lit(0).cast("bigint").alias("d"), "_ranks")
    both = asked.unionByName(changed, allowMissingColumns=True)
    # rows of one run are peers: a question sees the changes of its own run
    here = F.sum("d").over(Window.partitionBy("_g", "_c").orderBy("run_seq"))
    counted = both.withColumn("_n", here).where(F.col("_ranks").isNotNull())
    siblings = Window.partitionBy("_g", "run_seq", F.shiftright("_c", DIGIT)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_below", F.coalesce(F.sum("_n").over(siblings), F.lit(0)))

    def within(rank: Column) -> Column:
        return (rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_n"))

    left = F.transform(F.filter("_ranks", within), lambda rank: rank - F.col("_below"))
    return placed.select("_g", "run_seq", F.col("_c").alias("_p"), left.alias("_ranks")).where(F.size("_ranks") > 0)
