"""Token sequences packed along a space-filling curve.

A document's words are hashed into a vector that is projected to a few
dimensions; documents sorted along the Hilbert curve through these lie beside
documents like them. Laid end to end in this order they are cut every `length`
tokens, so every sequence but the last is full.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offerwatch.llm.common import arrow_map, save, slices, stream_map, tool

LENGTH = 4096
END = 2
#: Remembered pieces of text of a worker before it forgets those not asked for lately, and the longest such piece.
MEMO = 200_000
MEMO_CHARS = 64
BUCKETS = 1024
DIMS = 3
BITS = 10


class Recent(dict):
    """Ids of the pieces asked for lately, as bytes of 32-bit numbers: what was not asked for while `MEMO` / 2 others were is forgotten."""

    def __init__(self, ids: Callable[[str], list[int]]):
        super().__init__()
        self.ids, self.old = ids, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            ids = self.ids(piece)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


def gathered(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces one after the other, and how many each has."""
    return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) >> 2


def chosen(pool: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `pool` (of `sizes`, one after the other) that `picks` names, one after the other, and how many items are before each and in all."""
    starts, lengths = np.cumsum(sizes) - sizes, sizes[picks]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    kind = np.int32 if max(len(pool), ends[-1]) < 1 << 31 else np.int64
    place = np.repeat((starts[picks] - ends[:-1]).astype(kind), lengths)
    place += np.arange(len(place), dtype=kind)
    return pool[place], ends


class Words:
    """Ids of texts by the stretches between spaces and line ends.

    The tokenizer drops white space and looks at each such stretch by itself.
    Stretches of Latin letters and ASCII are split here as its pattern does, so
    that its model, asked for a single word, need not make its offsets; all
    others go through the whole tokenizer, and so do those with an added token in
    them, which the tokenizer finds before all else.

    Texts are taken many at a time: each different stretch is split once, and
    each different part of them looked up once.
    """

    PLAIN = r"^[!-~À-ÖØ-öø-ÿ]+$"
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(any(c.isspace() for c in token) for token in added):
            raise ValueError("an added token reaches over white space, so stretches cannot be encoded by themselves")
        self.added = "|".join(map(re.escape, added))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.letter = [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]
        self.parts, self.others = Recent(self.of_part), Recent(self.of_other)

    def of_part(self, part: str) -> list[int]:
        written = part if part.isascii() else "".join([self.letter[b] for b in part.encode()])
        return [t.id for t in self.tokenize(written)]

    def of_other(self, stretch: str) -> list[int]:
        return self.tokenizer.encode(stretch, add_special_tokens=False).ids

    def of_stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches one after the other, and how many each has."""
        plain = pc.match_substring_regex(stretches, self.PLAIN)
        if self.added:
            plain = pc.and_not(plain, pc.match_substring_regex(stretches, self.added))
        # a space after each part makes an empty part at the end, which has no ids
        split = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(stretches.filter(plain)), self.PARTS, r"\0 "), " ")
        parts = split.flatten().dictionary_encode()
        ids, ends = chosen(*gathered([self.parts[p] for p in parts.dictionary.to_pylist()]), parts.indices.to_numpy())
        other_ids, other_sizes = gathered([self.others[s] for s in stretches.filter(pc.invert(plain)).to_pylist()])
        plain = plain.to_numpy(zero_copy_only=False)
        sizes = np.empty(len(plain), np.int64)
        sizes[plain] = np.diff(ends[split.offsets.to_numpy()])
        sizes[~plain] = other_sizes
        merged = np.empty(len(ids) + len(other_ids), "<u4")
        of_plain = np.repeat(plain, sizes)
        merged[of_plain], merged[~of_plain] = ids, other_ids
        return merged, sizes

    def ids(self, text: str) -> np.ndarray:
        return self.of_texts(pa.array([text]))[0]

    def of_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null one has none."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        stretches = split.flatten().dictionary_encode()
        ids, ends = chosen(*self.of_stretches(stretches.dictionary), stretches.indices.to_numpy())
        bounds = ends[split.offsets.to_numpy()]
        return [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def words(path: str) -> Words:
    return tool(("words", path), lambda: Words(path))


@functools.cache
def projection() -> np.ndarray:
    return np.random.default_rng(11).normal(0, 1, (BUCKETS, DIMS))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of whole numbers below 2^bits."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, -1, -1):
        bit, below = np.int64(1 << level), np.int64((1 << level) - 1)
        for i in range(n):
            here = (x[i] & bit) != 0
            swap = np.where(here, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(here, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def cell(ids: np.ndarray) -> np.ndarray:
    """Projected direction of the counts of hashed ids, each coordinate as a place in its normal distribution."""
    counts = np.bincount(ids % BUCKETS, minlength=BUCKETS)
    size = np.sqrt(float((counts.astype(np.float64) ** 2).sum()))
    spot = counts @ projection() / max(size, 1.0)
    share = 1 / (1 + np.exp(-1.702 * spot))  # close to the normal distribution's
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def tokenised(df: DataFrame, id_col: str, text_col: str, path: str, end: int) -> DataFrame:
    """One row per document: row (its number), id, key (place on the curve), n and ids (16 bits each where they fit)."""

    def function(batches):
        own = words(path)
        row = TaskContext.get().partitionId() << 33
        small = own.tokenizer.get_vocab_size() <= 1 << 16
        for batch in (some for batch in batches for some in slices(batch)):
            texts = batch.column(1)
            points, counts, data = np.zeros((len(texts), DIMS), np.int64), [], []
            for i, ids in enumerate(own.of_texts(texts)):
                points[i] = cell(ids)
                counts.append(len(ids) + 1)
                data.append(np.append(ids, np.uint32(end)).astype("<u2" if small else "<u4").tobytes())
            numbers = np.arange(row, row + len(texts), dtype=np.int64)
            row += len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers), batch.column(0), pa.array(hilbert_keys(points)), pa.array(counts, pa.int64()), pa.array([small] * len(texts)), pa.array(data, pa.binary())],
                ["row", "id", "key", "n", "small", "ids"],
            )

    schema = f"row bigint, id {df.schema[id_col].dataType.simpleString()}, key bigint, n bigint, small boolean, ids binary"
    return stream_map(df.select(F.col(id_col).alias("id"), text_col), function, schema)


def starts(rows: DataFrame) -> DataFrame:
    """row, start: tokens before a document along the curve.

    Range partitions hold neighbouring runs of the curve (ties by row, so a key
    that many documents share is split); the sums of the partitions before one
    are added to the running sum within it. The ordered rows are written down
    first, since a range partitioning is not the same when it is run again.
    """
    parts = save(rows.select("key", "row", "n").repartitionByRange("key", "row").withColumn("part", F.spark_partition_id()), "curve")
    sums = parts.groupBy("part").agg(F.sum("n").alias("sum"))
    before = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return parts.withColumn("within", within).join(before, "part").select("row", (F.col("before") + F.col("within")).alias("start"))


def pack(df: DataFrame, id_col: str, text_col: str, path: str, length: int = LENGTH, end: int = END, digest: bool = False) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens.

    Columns: id_col, start (the document's ids before the piece), length, ids
    (array<int>; with `digest` ids_crc32 instead, of 32-bit little-endian ids),
    doc_tokens (with the closing `end`), sequence_id, offset (place in the
    sequence). Every sequence but the last is full, so padding is below one
    sequence in all. Null and empty texts are the closing id alone; repeated
    rows are documents of their own; an empty table has no pieces.

    Texts are read and tokenised once; ids are shuffled once, to meet their
    places. No group is gathered: a document is cut by its own start.
    """
    rows = save(tokenised(df, id_col, text_col, path, end), "tokens")

    def function(batch):
        ids_, starts_, lengths, data, totals, sequences, offsets = [], [], [], [], [], [], []
        for id_, small, raw, at in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            ids = np.frombuffer(raw, "<u2" if small else "<u4").astype("<u4")
            begin = 0
            while begin < len(ids):
                offset = (at + begin) % length
                stop = min(len(ids), begin + length - offset)
                ids_.append(id_)
                starts_.append(begin)
                lengths.append(stop - begin)
                data.append(zlib.crc32(ids[begin:stop].tobytes()) if digest else ids[begin:stop].astype(np.int32))
                totals.append(len(ids))
                sequences.append((at + begin) // length)
                offsets.append(offset)
                begin = stop
        long = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids_, batch.schema.field(0).type), pa.array(starts_, long), pa.array(lengths, long), pa.array(data, long if digest else pa.list_(pa.int32())),
             pa.array(totals, long), pa.array(sequences, long), pa.array(offsets, long)],
            ["id", "start", "length", "data", "doc_tokens", "sequence_id", "offset"],
        )

    name = df.schema[id_col].dataType.simpleString()
    placed = rows.select("row", "id", "small", "ids").join(starts(rows), "row").select("id", "small", "ids", "start")
    schema = f"id {name}, start bigint, length bigint, data {'bigint' if digest else 'array<int>'}, doc_tokens bigint, sequence_id bigint, offset bigint"
    return arrow_map(placed, function, schema).withColumnRenamed("id", id_col).withColumnRenamed("data", "ids_crc32" if digest else "ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: each sequence put together, at most `length` ids each."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
