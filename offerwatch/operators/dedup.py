"""One row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest `order` per key.

    An aggregate rather than a numbered window: each task keeps one row per key
    before the shuffle, so a key with any number of copies costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return last.select(*keys, "_row.*").select(*df.columns)


def keep_last_in_first_place(df: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Like keep_last, but the row takes the ordinal at which its key first came up."""
    rest = [c for c in df.columns if c not in keys and c != ordinal]
    last = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(ordinal)).alias("_row"), F.min(ordinal).alias(ordinal)
    )
    return last.select(*keys, "_row.*", ordinal).select(*df.columns)


def union_preferring(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed union in which a row of `second` replaces the row of `first` with its key."""
    both = first.withColumn("_side", F.lit(0)).unionByName(
        second.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    return keep_last(both, keys, ["_side"]).drop("_side")
