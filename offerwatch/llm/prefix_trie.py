"""The trie of conversations that start alike, from sorted rows and range minima.

Turns become digests, so texts are not moved. A conversation is cut into levels
of `WIDTH` turns; a level's row holds its turns' digests and, as its top, a hash
of all turns before. Rows sorted by level, top and digests put the members of
every node side by side. Each row is compared with the one before: the common
start of the two (LCP) is all that is needed further on.

Sorted rows are handled in blocks. Over a block's LCPs lies a sparse table of
range minima, in which each prefix finds its first and its last member by two
binary searches of its own. What a node reports is a sum over its rows of
numbers that each row has by its LCP alone, so it is a difference of prefix
sums; nodes that touch the end of a block are added up over blocks by their key.
Neither a long conversation nor a node with many members is ever in one place,
but for the digest of its members' ids, which is taken over a sorted stream.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerwatch.llm.common import save, stream_map

#: Turns in a level.
WIDTH = 32
#: Levels whose running values are taken in one window.
RUN = 1024
DIGEST = 16
NOTHING = hashlib.sha256(b"").hexdigest()
ORDER = ["level", "top1", "top2", "body", "continues", "conv"]


def numbered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, pos (0, 1, ... by turn, nulls first, then by digest), digest, chars.

    Rows are dealt by ranges of (conversation, turn) and numbered within a
    range; what a conversation has in ranges before is added.
    """
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.unhex(F.left(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256), F.lit(2 * DIGEST)))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"),
        F.length(said).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("tie"),
    )
    keys = ["conv", "turn", "digest", "tie"]
    dealt = save(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("conv", "part", before.alias("before")).where("before > 0")  # at most one for each range
    at = F.row_number().over(Window.partitionBy("part", "conv").orderBy(*keys[1:])) - 1
    within = dealt.withColumn("at", at).join(before, ["conv", "part"], "left")
    return within.select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).cast("bigint").alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, total) and their turns (conv, pos, digest, chars, total) after each took the first
    h = crc32(conv) % most turns of conversation conv - conv % family in place of its own first h."""
    turns = save(turns, "numbered")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    heads = turns.where((F.col("conv") % family == 0) & (F.col("pos") < most - 1))
    heads = heads.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("h").cast("int"))
    convs = own.join(heads, "base", "left").withColumn("head", taken)
    convs = convs.withColumn("total", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("base")
    convs = save(convs, "conversations")
    first = convs.select("conv", "total", F.inline("head")).select("conv", "pos", "digest", "chars", "total")
    rest = turns.join(convs.select("conv", "h", "total", F.size("head").alias("taken")), "conv").where("pos >= h")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars", "total")
    return convs.select("conv", "total"), first.unionByName(rest)


def running(rows: DataFrame, values: dict[str, tuple], down: bool = False) -> DataFrame:
    """conv, level and for each value the aggregate over the levels before (`down`: after), zero where there are none.

    In two steps, so that a window has at most `RUN` levels or one row for each
    `RUN` levels of a conversation.
    """
    order = (lambda c: F.col(c).desc()) if down else F.col
    rows = rows.withColumn("run", F.floor(F.col("level") / RUN))
    runs = rows.groupBy("conv", "run").agg(*[of(c).alias(name) for name, (of, c, _) in values.items()])
    along = Window.partitionBy("conv").orderBy(order("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "run", *[F.coalesce(of(name).over(along), F.lit(0)).alias(f"{name}_run") for name, (of, _, _) in values.items()])
    inside = Window.partitionBy("conv", "run").orderBy(order("level")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv", "run", "level", *[F.coalesce(of(c).over(inside), F.lit(0)).alias(name) for name, (of, c, _) in values.items()])
    return rows.join(runs, ["conv", "run"]).select("conv", "level", *[both(F.col(name), F.col(f"{name}_run")).alias(name) for name, (_, _, both) in values.items()])


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def plus(a: Column, b: Column) -> Column:
    return a + b


def levels(convs: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """One row per conversation and level with turns, and level 0 of those without: level, top1, top2 (hash of
    the turns before), body (digests), continues, conv, chars, next1, next2 (top of the level below)."""
    grouped = turns.groupBy("conv", F.floor(F.col("pos") / width).cast("bigint").alias("level")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("list"), F.first("total").alias("total")
    )
    rows = grouped.select(
        "conv", "level", F.aggregate("list", F.lit(b""), lambda a, x: F.concat(a, x["digest"])).alias("body"),
        F.transform("list", lambda x: x["chars"]).alias("chars"), (F.col("total") > (F.col("level") + 1) * width).alias("continues"),
    )
    rows = rows.withColumns({"x1": F.xxhash64("level", "body"), "x2": F.xxhash64("body", "level", F.lit(1))})
    rows = save(rows, "levels")
    zero = F.lit(0).cast("bigint")
    long = rows.where("continues OR level > 0")
    tops = running(long, {"top1": (F.bit_xor, "x1", xor), "top2": (F.bit_xor, "x2", xor)})
    names = ["level", "top1", "top2", "body", "continues", "conv", "chars"]
    below = [F.when(F.col("continues"), xor(F.col(f"x{i}"), F.col(f"top{i}"))).alias(f"next{i}") for i in (1, 2)]
    short = rows.where("NOT (continues OR level > 0)").withColumns({"top1": zero, "top2": zero})
    silent = convs.where("total = 0").select(
        zero.alias("level"), zero.alias("top1"), zero.alias("top2"), F.lit(b"").alias("body"), F.lit(False).alias("continues"), "conv",
        F.array().cast("array<bigint>").alias("chars"), F.lit(None).cast("bigint").alias("next1"), F.lit(None).cast("bigint").alias("next2"),
    )
    return long.join(tops, ["conv", "level"]).select(*names, *below).unionByName(short.select(*names, *below)).unionByName(silent)


class Ranges:
    """Sparse table of range minima."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first..last]."""
        out = np.empty(len(first), self.rows[0].dtype)
        power = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k, row in enumerate(self.rows):
            at = np.flatnonzero(power == k)
            out[at] = np.minimum(row[first[at]], row[last[at] + 1 - (1 << k)])
        return out

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place up to which all values behind `at` are `depth` or more."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            start = at + 1
            inside = start < len(row)
            inside[inside] = row[start[inside]] >= depth[inside]
            at[inside] += 1 << k
        return at

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place down to which all values behind it, up to `at`, are `depth` or more."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            start = at + 1 - (1 << k)
            inside = start > 0
            inside[inside] = row[start[inside]] >= depth[inside]
            at[inside] -= 1 << k
        return at


class Block:
    """Neighbouring rows of the sorted table, and the row before them."""

    def __init__(self, batch: pa.RecordBatch, before: dict | None):
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.conv, self.level, self.top1, self.top2 = (column(c) for c in ("conv", "level", "top1", "top2"))
        self.continues = column("continues").astype(bool)
        self.body = batch.column("body").to_pylist()
        m = len(self.body)
        self.size = np.array([len(b) // DIGEST for b in self.body], np.int64)
        width = max(int(self.size.max()), 1)
        words = np.frombuffer(b"".join([b.ljust(width * DIGEST, b"\0") for b in self.body]), np.uint64).reshape(m, width, 2)
        same = (words[1:] == words[:-1]).all(2) & (np.arange(width) < np.minimum(self.size[1:], self.size[:-1])[:, None])
        common = np.minimum.accumulate(same, 1).sum(1)
        apart = (self.level[1:] != self.level[:-1]) | (self.top1[1:] != self.top1[:-1]) | (self.top2[1:] != self.top2[:-1])
        first, before_size, before_ends = -1, -1, False
        if before and (before["level"], before["top1"], before["top2"]) == (self.level[0], self.top1[0], self.top2[0]):
            here, there = self.body[0], before["body"]
            first = next((i for i in range(min(len(here), len(there)) // DIGEST) if here[i * DIGEST : (i + 1) * DIGEST] != there[i * DIGEST : (i + 1) * DIGEST]), min(len(here), len(there)) // DIGEST)
            before_size, before_ends = len(there) // DIGEST, not before["continues"]
        #: Turns shared with the row before; -1 where the level or the top is another.
        self.lcp = np.append(first, np.where(apart, -1, common)).astype(np.int64)
        chars = np.zeros((m, width + 1), np.int64)
        lists = batch.column("chars")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        chars[np.repeat(np.arange(m), self.size), 1 + np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = flat
        self.chars = np.cumsum(chars, 1)
        #: Code points of turns that the row before has as well.
        self.shared = self.chars[np.arange(m), np.maximum(self.lcp, 0)]
        #: 1 where the row before ends in a node that this row is in, too.
        ends = np.append(before_ends, ~self.continues[:-1])
        self.takes = ((self.lcp >= 0) & (self.lcp == np.append(before_size, self.size[:-1])) & ends).astype(np.int64)

    def last(self) -> dict:
        return {"level": self.level[-1], "top1": self.top1[-1], "top2": self.top2[-1], "body": self.body[-1], "continues": self.continues[-1]}


def blocks(batches):
    """(part, number in the part, block, batch) for the blocks of a partition sorted by part; a part's first row
    may be the last one of the part before, marked so."""
    part, number, before = None, 0, None
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
        for start, stop in zip(cuts, [*cuts[1:], len(parts)], strict=True):
            rows = batch.slice(start, stop - start)
            if part != parts[start]:
                part, number, before = parts[start], 0, None
                if not rows.column("real")[0].as_py():
                    before = {c: rows.column(c)[0].as_py() for c in ("level", "top1", "top2", "body", "continues")}
                    rows = rows.slice(1)
                    if not rows.num_rows:
                        continue
            block = Block(rows, before)
            before = block.last()
            yield int(part), number, block, rows
            number += 1


def _row_values(batches):
    """Per row: what it adds to the shared code points and the leaves of nodes of the levels above."""
    for _, _, block, _ in blocks(batches):
        ends = (~block.continues).astype(np.int64) - block.takes
        shared = np.where(block.lcp >= 0, block.shared, 0)
        yield pa.RecordBatch.from_arrays([pa.array(block.conv), pa.array(block.level), pa.array(shared), pa.array(ends)], ["conv", "level", "shared", "leaves"])


NODE = {
    "part": pa.int64(), "block": pa.int64(), "open": pa.bool_(), "level": pa.int64(), "j": pa.int64(), "conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "ends": pa.binary(),
    "key": pa.binary(), "parent_key": pa.binary(), "parent_conv_id": pa.int64(),
    "top1": pa.int64(), "top2": pa.int64(), "next1": pa.int64(), "next2": pa.int64(),
}


def block_nodes(part: int, number: int, b: Block, rows: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """The nodes of a block: first member, extents and sums of each prefix that is new in its row."""
    m = len(b.conv)
    spans = Ranges(b.lcp)
    start = b.lcp + 1  # the least new depth of a row
    start[0] = 0  # prefixes that go on from the block before count as well
    many = b.size - start + 1
    offset = np.cumsum(many) - many
    row = np.repeat(np.arange(m), many)
    depth = np.arange(len(row)) - offset[row] + start[row]
    left, right = spans.left(row, depth), spans.right(row, depth)
    goes_on = (left == 0) & (b.lcp[0] >= depth)
    open_ = goes_on | (right == m - 1)
    inner = np.where(goes_on, left, left + 1)  # rows that follow one of the same node

    def over(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[right + 1] - sums[first]

    later = lambda c: rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    saved = over(b.shared, inner) - (right + 1 - inner) * b.chars[row, np.maximum(depth - 1, 0)] + over(later("later_shared"), left)
    leaves = over((~b.continues).astype(np.int64), left) + over(later("later_leaves"), left) - over(b.takes, inner)
    # A row's first new prefix hangs on the common start with the row before, which began where the left search ends.
    parent = np.arange(len(row)) - 1
    heads = offset[1:]
    roots = spans.left(np.arange(1, m), b.lcp[1:])
    known = (b.lcp[1:] >= 0) & (many[1:] > 0)
    parent[heads[known]] = offset[roots[known]] + b.lcp[1:][known] - start[roots[known]]
    parent[depth == 0] = -1
    new = (parent >= 0) & ~goes_on
    children = np.bincount(parent[new], minlength=len(row))
    lowest = Ranges(b.conv).least(left, right)
    # Members that end in a node are its first rows, all in one run of equal rows.
    change = np.append(True, (b.lcp[1:] != b.size[1:]) | (b.size[1:] != b.size[:-1]) | (b.continues[1:] != b.continues[:-1]))
    run_end = np.append(np.flatnonzero(change)[1:], m)[np.cumsum(change) - 1]
    digests, ends, keys = np.full(len(row), NOTHING, object), np.full(len(row), None, object), np.full(len(row), None, object)
    for c in np.flatnonzero((depth == b.size[row]) & ~b.continues[row]).tolist():
        i = int(row[c])
        listed = ",".join(map(str, b.conv[i : run_end[i]].tolist())).encode()
        if open_[c]:
            ends[c] = listed
        else:
            digests[c] = hashlib.sha256(listed).hexdigest()
    for c in np.flatnonzero(open_).tolist():
        i = int(row[c])
        prefix = struct.pack("<qqq", b.level[i], b.top1[i], b.top2[i]) + b.body[i][: depth[c] * DIGEST]
        keys[c] = hashlib.sha256(prefix).digest()
    digests[open_] = None
    parent_keys = np.where(parent >= 0, keys[parent], None)
    closed = (parent >= 0) & ~open_[parent]
    parent_convs = pa.array(np.where(closed, lowest[parent], 0), mask=~closed)
    outer = (b.level[row] > 0) & (depth < 2)
    closes = depth == width
    values = {
        "part": np.full(len(row), part), "block": np.full(len(row), number), "open": open_, "level": b.level[row], "j": depth, "conv_id": lowest,
        "n_convs": right - left + 1, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": digests, "ends": ends,
        "key": keys, "parent_key": parent_keys, "parent_conv_id": parent_convs,
        "top1": pa.array(b.top1[row], mask=~outer), "top2": pa.array(b.top2[row], mask=~outer),
    }
    # The rows of a node at the end of a level that go on stand last among its members.
    at = pa.array(right, mask=~closes)
    for c in ("next1", "next2"):
        values[c] = rows.column(c).take(at)
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values.values(), NODE.values(), strict=True)], list(NODE))


def stitched(nodes: DataFrame) -> DataFrame:
    """The nodes that touch an end of their block, added up over blocks, with parent_conv_id."""
    pieces = nodes.where("open")
    whole = pieces.groupBy("key").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("level", "j", "parent_key", "top1", "top2", "next1", "next2")],
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )

    def digests(batches):
        key, state = None, None
        out: tuple[list, list] = ([], [])
        for batch in batches:
            for k, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out[0].append(key)
                        out[1].append(state.hexdigest())
                    key, state = k, hashlib.sha256(listed)
                else:
                    state.update(b"," + listed)
        if key is not None:
            out[0].append(key)
            out[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["key", "ends_sha256"])

    lists = pieces.where("ends IS NOT NULL").select("key", "ends", "part", "block").repartition("key").sortWithinPartitions("key", "part", "block")
    ends = stream_map(lists.select("key", "ends"), digests, "key binary, ends_sha256 string")
    return save(whole.join(ends, "key", "left").fillna({"ends_sha256": NOTHING}), "stitched")


def trie(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = 100, most: int = 6, width: int = WIDTH
) -> DataFrame:
    """Every distinct start of a conversation, from the empty one, as a node.

    Turns are ordered by `turn`, nulls first, equal ones by the digest of role
    and text; each conversation c takes the first crc32(c) % `most` turns of
    conversation c - c % `family` in place of its own. Columns: conv_id (least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256, all for the conversations that start with the node's turns.

    Null role and text are empty; rows without a conversation id belong to none
    and are left out; repeated rows are turns of their own; an empty table has
    no nodes, not even a root; other columns are not read.
    """
    convs, turns = rebuilt(numbered(df, conv, turn, role, text), family, most)
    rows = levels(convs, turns, width)
    rows = save(rows.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id().cast("bigint")), "sorted")
    # One row for each range: the last one of the range before, which stands first in the next.
    ends = rows.groupBy("part").agg(F.max(F.struct(*ORDER)).alias("end"))
    follows = F.lead("part").over(Window.orderBy("part"))
    before = save(ends.select(follows.alias("part"), "end.*").where("part IS NOT NULL").withColumn("real", F.lit(False)), "ends")

    def laid(frame: DataFrame) -> DataFrame:
        both = frame.withColumn("real", F.lit(True)).unionByName(before, allowMissingColumns=True)
        return both.repartition("part").sortWithinPartitions("part", "real", *ORDER)

    deeper = stream_map(laid(rows.where("level > 0").drop("next1", "next2")), _row_values, "conv bigint, level bigint, shared bigint, leaves bigint")
    later = save(deeper, "deeper")
    top = rows.where("level = 0 AND continues").select("conv", "level", F.lit(0).cast("bigint").alias("shared"), F.lit(0).cast("bigint").alias("leaves"))
    later = running(later.unionByName(top), {"later_shared": (F.sum, "shared", plus), "later_leaves": (F.sum, "leaves", plus)}, down=True)
    ending = rows.where("NOT continues").withColumns({c: F.lit(0).cast("bigint") for c in ("later_shared", "later_leaves")})
    weighed = ending.unionByName(rows.where("continues").join(later, ["conv", "level"]))

    def nodes_of(batches):
        for part, number, block, batch in blocks(batches):
            yield block_nodes(part, number, block, batch, width)

    schema = ", ".join(f"{c} {'boolean' if t == pa.bool_() else 'string' if t == pa.string() else 'binary' if t == pa.binary() else 'bigint'}" for c, t in NODE.items())
    nodes = save(stream_map(laid(weighed), nodes_of, schema), "nodes")
    whole = stitched(nodes)
    names = ["level", "j", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id", "top1", "top2", "next1", "next2"]
    owners = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    # Other parents that touch an end of the block are looked up by block, so a node with any number of children is spread.
    resolved = nodes.where("open").select("part", "block", F.col("key").alias("parent_key")).join(owners, "parent_key")
    closed = nodes.where("NOT open")
    first = F.lit(convs.agg(F.min("conv")).first()[0]).cast("bigint")  # least member of the root
    full = closed.where("parent_key IS NULL").select(*names)
    full = full.unionByName(closed.where("parent_key IS NOT NULL AND level = 0 AND j = 1").withColumn("parent_conv_id", first).select(*names))
    hanging = closed.where("parent_key IS NOT NULL AND NOT (level = 0 AND j = 1)").drop("parent_conv_id")
    full = full.unionByName(hanging.join(resolved, ["part", "block", "parent_key"], "left").select(*names))
    full = full.unionByName(whole.join(owners, "parent_key", "left").select(*names))
    # Where a level begins, the parent is the node in which the level above ends, and its children are counted here.
    at_end, at_start = f"(j = {width} AND next1 IS NOT NULL)", "(level > 0 AND j < 2)"
    edges = save(full.where(f"{at_start} OR {at_end}"), "edges")
    upper, lower = edges.where(at_end), edges.where(at_start)
    counted = lower.where("j = 0").select((F.col("level") - 1).alias("level"), F.col("top1").alias("next1"), F.col("top2").alias("next2"), F.col("n_children").alias("below"))
    parents = upper.select((F.col("level") + 1).alias("level"), F.col("next1").alias("top1"), F.col("next2").alias("top2"), F.col("conv_id").alias("parent_conv_id"))
    done = full.where(f"NOT ({at_start} OR {at_end})").select(*names)
    done = done.unionByName(upper.join(counted, ["level", "next1", "next2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("below", F.lit(0))).select(*names))
    done = done.unionByName(lower.where("j = 1").drop("parent_conv_id").join(parents, ["level", "top1", "top2"], "left").select(*names))
    depth = (F.col("level") * width + F.col("j")).alias("depth")
    return done.select("conv_id", depth, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
