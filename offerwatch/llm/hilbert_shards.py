"""Shards cut from a Hilbert curve over metadata.

Every row is quantised in several metadata columns, the cells are numbered
along a Hilbert curve and the rows, sorted along it, are cut into runs of equal
weight. A shard then spans a small box in every dimension, so its minima and
maxima let readers skip it on a filter on any of them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerwatch.llm.common import save

#: Blocks that the rows of one cell are dealt over, so that a cell may hold most of the table.
SALTS = 256


def text_as_number(text: Column, skip: int) -> Column:
    """Seven bytes after the first `skip`, as a number in the order of the texts."""
    head = F.substring(F.to_binary(F.hex(F.encode(text, "UTF-8")), F.lit("hex")), skip + 1, 7)
    return F.conv(F.rpad(F.hex(head), 14, "0"), 16, 10).cast("bigint")


def common_prefix(low: str | None, high: str | None) -> int:
    """Bytes that the smallest and the largest value, and so all between, begin with."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def cells(df: DataFrame, dims: list[str], bits: int) -> dict[str, Column]:
    """For each dimension its cell, 0 to 2^bits - 1: how many of its quantiles are at or below the value.

    Two passes over the metadata alone: ends of the text columns, then quantiles.
    Null lies in cell 0.
    """
    is_text = {d: isinstance(df.schema[d].dataType, T.StringType) for d in dims}
    ends = df.agg(F.count(F.lit(1)), *[f(d).alias(f"{f.__name__}_{d}") for d in dims if is_text[d] for f in (F.min, F.max)]).first()
    number = {
        d: text_as_number(F.col(d), common_prefix(ends[f"min_{d}"], ends[f"max_{d}"])) if is_text[d] else F.col(d).cast("double")
        for d in dims
    }
    shares = [i / 2**bits for i in range(1, 2**bits)]
    quantiles = df.agg(*[F.percentile_approx(number[d], shares, 10000).alias(d) for d in dims]).first()

    def cell(value: Column, bounds: list | None) -> Column:
        if not bounds:
            return F.lit(0)
        below = F.size(F.filter(F.array(*[F.lit(q) for q in bounds]), lambda q: q <= value))
        return F.when(value.isNull(), F.lit(0)).otherwise(below)

    return {d: cell(number[d], quantiles[d]) for d in dims}


def curve_index(cell: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point of `bits` bits in each dimension.

    From the highest bit down, the point's corner of the current cube is looked
    up along the curve's course through the cube, which is described by the
    corner it enters by (e) and the direction it leaves in (d).
    """
    n = len(cell)
    mask = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    place = [gray.index(i) for i in range(1 << n)]
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(1 << n)]
    trailing = [next(j for j in range(n + 1) if not (i >> j) & 1) for i in range(1 << n)]
    turn = [0 if i == 0 else trailing[i - 1] % n if i % 2 == 0 else trailing[i] % n for i in range(1 << n)]
    table = {name: F.array(*[F.lit(x) for x in xs]) for name, xs in (("place", place), ("entry", entry), ("turn", turn))}

    def rotated(x: Column, by: Column, left: bool) -> Column:
        """`x`, n bits wide, turned by a column of places."""
        turned = x
        for k in range(1, n):
            moved = (F.shiftleft(x, k).bitwiseOR(F.shiftright(x, n - k)) if left else F.shiftright(x, k).bitwiseOR(F.shiftleft(x, n - k)))
            turned = F.when(by == k, moved.bitwiseAND(F.lit(mask))).otherwise(turned)
        return turned

    def bound(value: Column, use) -> Column:
        """`use` of a value that is worked out once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def corner(level: Column) -> Column:
        """One bit of every dimension, the first the lowest."""
        bits_ = [F.call_function("shiftright", c.cast("int"), level).bitwiseAND(F.lit(1)) * (1 << i) for i, c in enumerate(cell)]
        return functools.reduce(lambda a, b: a + b, bits_)

    def step(state: Column, level: Column) -> Column:
        by = (state["d"] + 1) % n
        local = rotated(corner(level).bitwiseXOR(state["e"]), by, left=False)
        return bound(
            F.element_at(table["place"], local + 1),
            lambda w: F.struct(
                (state["h"] * (1 << n) + w).alias("h"),
                state["e"].bitwiseXOR(rotated(F.element_at(table["entry"], w + 1), by, left=True)).alias("e"),
                ((state["d"] + F.element_at(table["turn"], w + 1) + 1) % n).alias("d"),
            ),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    levels = F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)])
    return F.aggregate(levels, start, step, lambda state: state["h"])


def shards(df: DataFrame, id_col: str, dims: list[str], count: int, weight: str | None = None, bits: int = 4, salts: int = SALTS) -> DataFrame:
    """`df` with curve (place on the curve), shard (0 to count - 1) and slot (0, 1, ... in the shard).

    Cuts by rows, so that shards differ by one row at most, or by the column
    `weight` (non-negative whole numbers), so that a shard's sum is off by one
    row's weight at most. Rows on the same cell follow in the order of a hash
    of the id, then of the id.

    The exact place of a row in the whole table needs no global sort: weights
    are summed for each cell and salt, the sums are summed up along the curve,
    and within a cell and salt the rows are numbered. So no task holds more
    than a 1/salts part of a cell; the one list along the curve has at most
    2^(bits * len(dims)) entries.

    Null ids and null metadata are ordinary values (cell 0); an empty table has
    no shards; repeated rows each get a slot. Columns of `df` named curve, shard
    or slot are replaced. All columns of `df` are carried along, so give it the
    id and the metadata and join texts to the result where they are wanted.
    """
    cell = cells(df, dims, bits)
    weighed = F.lit(1).cast("bigint") if weight is None else F.coalesce(F.col(weight), F.lit(0)).cast("bigint")
    names = [c for c in df.columns if c not in ("curve", "shard", "slot")]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row_"),  # so that their names clash with none below
        F.col(id_col).alias("_id"),
        curve_index([cell[d] for d in dims], bits).alias("curve"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("_salt"),
        F.xxhash64(F.col(id_col)).alias("_hash"),
        weighed.alias("_weight"),
    )
    rows = save(rows, "curve")  # read three times below
    sums = rows.groupBy("curve", "_salt").agg(F.sum("_weight").alias("_w"), F.count(F.lit(1)).alias("_n"))
    by_cell = sums.groupBy("curve").agg(F.sum("_w").alias("_cell_w"), F.sum("_n").alias("_cell_n"))
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.select(
        F.col("curve"),
        F.coalesce(F.sum("_cell_w").over(along), F.lit(0)).alias("_cell_w"),
        F.coalesce(F.sum("_cell_n").over(along), F.lit(0)).alias("_cell_n"),
        F.sum("_cell_w").over(Window.partitionBy()).alias("_total"),
    )
    in_cell = Window.partitionBy("curve").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.join(starts, "curve").select(
        "curve",
        "_salt",
        (F.col("_cell_w") + F.coalesce(F.sum("_w").over(in_cell), F.lit(0))).alias("_before_w"),
        (F.col("_cell_n") + F.coalesce(F.sum("_n").over(in_cell), F.lit(0))).alias("_before_n"),
        "_total",
    )
    in_block = Window.partitionBy("curve", "_salt").orderBy("_hash", "_id")
    placed = (
        rows.withColumn("_row", F.row_number().over(in_block) - 1)
        .withColumn("_sum", F.sum("_weight").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_weight"))
        .join(blocks, ["curve", "_salt"])
    )
    share = (F.col("_before_w") + F.col("_sum")).cast("decimal(38,0)") * count / F.greatest(F.col("_total"), F.lit(1)).cast("decimal(19,0)")
    placed = placed.withColumn("shard", F.least(F.floor(share).cast("int"), F.lit(count - 1))).withColumn(
        "_place", F.col("_before_n") + F.col("_row")
    )
    placed = save(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(first, "shard").select(
        *[F.col("_row_")[c].alias(c) for c in names],
        "curve",
        "shard",
        (F.col("_place") - F.col("_first")).alias("slot"),
    )


def ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """What readers prune by: rows and the ends of each dimension of every shard."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    )


def write(sharded: DataFrame, path: str) -> None:
    """One folder per shard with its rows in curve order; a shard's rows go to as few files as Spark's sizes allow."""
    (
        sharded.hint("rebalance", F.col("shard"))
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite").partitionBy("shard").parquet(path)
    )
