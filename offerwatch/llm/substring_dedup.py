"""Passages that stand more than once in a corpus, by FM-indexes of its shards.

A window is `WINDOW` consecutive words of one document. Of the grams (`GRAM`
words) of a window the one with the least hash is its anchor. Windows that are
equal have equal anchors, so the windows of a document fall into segments of
neighbouring windows with one anchor, and segments whose anchor stands nowhere
else hold nothing that repeats. The others are dealt by their anchor: a shard
gets all segments that can share a window. Equal segments are folded into one
that counts as many times as it stands.

Each shard is indexed by a wavelet-matrix FM-index and its segments are run
through backward search, which gives for each end of a window the longest
stretch before it that stands twice; stretches of a window or more are reported.

An anchor with very many different segments around it (a line that a large
part of all documents has, each time between other words) is not indexed: its
segments are cut into single windows, and equal ones are counted by digest.
Counts are folded before the shuffle and joined back to the segments, so
neither an anchor nor a window has to fit in one task.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerwatch.llm import fm_index
from offerwatch.llm.common import arrow_map, drop_saved, grouped, hashed, save, saved, stream_map

WINDOW = 35
GRAM = 8  # a mask of WINDOW - GRAM + 1 windows has to fit in 64 bits
#: Different segments of one anchor above which it is dealt by windows.
HOT = 4096
#: A segment that is more than one in so many of all is looked up in its place instead of joined.
SHARE = 10_000
#: Segments that make a shard; the last key is taken whole.
SHARD = 16384


def split(text: str | None) -> list[bytes]:
    """Words: what stands between spaces and the characters 9 to 13."""
    return (text or "").encode().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64


@functools.lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return run(BASE), run(pow(BASE, -1, 1 << 64))


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Of a document's word hashes, for each segment: anchor, digest, first window, windows, place of the anchor in it."""
    n = len(h)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    rng = np.random.default_rng(gram)
    grams = np.zeros(n - gram + 1, np.uint64)
    for j, factor in enumerate(rng.integers(0, 1 << 63, gram, np.uint64) * np.uint64(2) + np.uint64(1)):
        grams += h[j : j + len(grams)] * factor
    grams = mixed(grams)
    width = window - gram + 1
    least = np.arange(len(grams))
    size = 1
    while size < width:  # the place of the least of `size` grams, doubled; the leftmost of equal ones
        step = min(size, width - size)
        left, right = least[:-step], least[step:]
        least = np.where(grams[left] <= grams[right], left, right)
        size += step
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(least)) - 1
    place = least[first]
    power, inverse = powers(1 << max(12, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=sums[1:])
    digest = mixed((sums[last + window] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    return grams[place].view(np.int64), digest.view(np.int64), first, last - first + 1, place - first


def _outline(batch, window: int, gram: int):
    """Per document: key, words, digest of all words, and its segments."""
    counts, digests, parts = [], [], []
    for text in batch.column(3).to_pylist():
        words = split(text)
        counts.append(len(words))
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        parts.append(segments(hashed(words), window, gram))
    bounds = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32)
    joined = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5)]
    fields = [pa.array(joined[0]), pa.array(joined[1]), pa.array(joined[2].astype(np.int32)), pa.array(joined[3].astype(np.int32)), pa.array(joined[4].astype(np.int32))]
    nested = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, ["anchor", "digest", "start", "windows", "place"]))
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests), nested],
        ["id", "k1", "k2", "n_words", "digest", "segments"],
    )


def _cut(batch, window: int):
    """The words of the segments that are to be indexed, as hashes."""
    out = {c: [] for c in ("anchor", "digest", "n", "words")}
    for text, reps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        h = hashed(split(text))
        for s in reps:
            words = h[s["start"] : s["start"] + s["windows"] + window - 1]
            for c, v in zip(out, (s["anchor"], s["digest"], s["n"], words.tobytes()), strict=True):
                out[c].append(v)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))


def _windows(batch, window: int):
    """The single windows of hot segments, by digest, with their place in the segment."""
    out = {c: [] for c in ("anchor", "digest", "n", "base", "window")}
    for text, reps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        h = hashed(split(text))
        for s in reps:
            for i in range(s["windows"]):
                words = h[s["start"] + i : s["start"] + i + window]
                for c, v in zip(out, (s["anchor"], s["digest"], s["n"], i, xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)), strict=True):
                    out[c].append(v)
    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))


def counted(windows: DataFrame) -> DataFrame:
    """anchor, digest, mask of the segments of `windows` (anchor, digest, n, base, window): the windows that stand twice or more."""
    twice = windows.groupBy("anchor", "window").agg(F.sum("n").alias("_n")).where("_n > 1").select("anchor", "window")
    found = windows.join(save(twice, "twice"), ["anchor", "window"])
    return found.select("anchor", "digest", F.expr("shiftleft(1L, cast(base AS int))").alias("mask"))


def repeated(passages: list[np.ndarray], weights: np.ndarray, window: int) -> np.ndarray:
    """For each passage, a bit for each of its windows that stands twice or more, passages weighed."""
    lengths = np.array([len(p) for p in passages])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    known, text = np.unique(np.concatenate(passages), return_inverse=True)
    index = fm_index.Index(text, starts, weights, len(known))
    masks = np.zeros(len(passages), np.uint64)

    def mark(passage, first, last):  # windows first..last, counted in the passage
        some = last >= first
        p, f, n = passage[some], first[some].astype(np.uint64), (last - first + 1)[some].astype(np.uint64)
        np.bitwise_or.at(masks, p, ((np.uint64(1) << n) - np.uint64(1)) << f)

    ends = starts + lengths - 1
    reached = fm_index.matches(index, text, ends, starts)
    who = np.arange(len(passages))
    mark(who, reached - starts, lengths - window)
    rest = np.flatnonzero(reached > starts)  # the other ends of passages that do not stand elsewhere as a whole
    more = lengths[rest] - window
    who = np.repeat(rest, more)
    ends = np.arange(len(who)) - np.repeat(np.cumsum(more) - more, more) + starts[who] + window - 1
    reached = fm_index.matches(index, text, ends, starts[who])
    mark(who, reached - starts[who], ends - starts[who] - window + 1)
    return masks


def _search(batches, window: int):
    for table in grouped(batches, ["anchor"], SHARD):
        words = table.column("words").to_pylist()
        passages = [np.frombuffer(w, np.uint64) for w in words]
        masks = repeated(passages, table.column("n").to_numpy(), window)
        found = np.flatnonzero(masks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(table.column("anchor").to_numpy()[found]), pa.array(table.column("digest").to_numpy()[found]), pa.array(masks[found].view(np.int64))],
            ["anchor", "digest", "mask"],
        )


def covered(n: int, hits: list[dict] | None, window: int) -> np.ndarray:
    """Words under the windows that the masks name."""
    change = np.zeros(n + 1, np.int32)
    for hit in hits or []:
        mask = hit["mask"] & (2**64 - 1)
        first = hit["start"]
        while mask:
            skip = (mask & -mask).bit_length() - 1
            mask >>= skip
            first += skip
            run = (~mask & (mask + 1)).bit_length() - 1
            change[first] += 1
            change[first + run + window - 1] -= 1
            mask >>= run
            first += run
    return np.cumsum(change[:-1]) > 0


def without(words: list[bytes], hits: list[dict] | None, window: int) -> tuple[bytes, int]:
    """The kept words joined by spaces, and how many went."""
    if not hits:
        return b" ".join(words), 0
    gone = covered(len(words), hits, window)
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), int(gone.sum())


def _kept(batch, window: int, heavy: dict[tuple[int, int], int]):
    counts, removed, digests = [], [], []
    for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        words = split(text)
        left, gone = without(words, named(hits, heavy), window)
        counts.append(len(words))
        removed.append(gone)
        digests.append(hashlib.sha256(left).hexdigest())
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], ["id", "n_words", "n_removed", "kept_sha256"])


def digest_in(digests: list[int]) -> Column:
    return F.expr(f"digest IN ({', '.join(f'bigint({d})' for d in digests)})")


def heavy_masks(folded: DataFrame, masks: DataFrame, share: int) -> dict[tuple[int, int], int]:
    """Masks of the segments that are more than one in `share` of all; by that there are fewer than `share` of them."""
    total = folded.agg(F.sum("n")).first()[0] or 0
    heavy = [r["digest"] for r in folded.where(F.col("n") * share > total).select("digest").distinct().collect()]
    if not heavy:
        return {}
    return {(r["anchor"], r["digest"]): r["mask"] for r in masks.where(digest_in(heavy)).collect()}


def placed(known: DataFrame, masks: DataFrame, heavy: dict[tuple[int, int], int]) -> DataFrame:
    """k1, k2, start, mask of the segments with windows that repeat. A heavy segment stands in a large part of all
    documents: it is named by anchor and digest here and its mask looked up by `named` where its document is; only
    the others are joined."""
    light = known.select("k1", "k2", "anchor", "digest", "start")
    is_heavy = digest_in(sorted({digest for _, digest in heavy})) if heavy else F.lit(False)
    joined = light.where(~is_heavy).join(masks, ["anchor", "digest"]).select("k1", "k2", "start", "mask")
    return joined.unionByName(light.where(is_heavy), allowMissingColumns=True)


def named(hits: list[dict] | None, heavy: dict[tuple[int, int], int]) -> list[dict]:
    """Hits with the masks of heavy segments."""
    out = []
    for hit in hits or []:
        if hit["mask"] is not None:
            out.append(hit)
        elif (mask := heavy.get((hit["anchor"], hit["digest"]))) is not None:
            out.append({"start": hit["start"], "mask": mask})
    return out


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, share: int = SHARE) -> tuple[DataFrame, DataFrame, DataFrame, dict[tuple[int, int], int]]:
    """For `docs` (id, k1, k2, text): outline of each row; the rows with an anchor that stands elsewhere; for each
    key the windows that repeat, as lists of (start, mask of the windows from there); and the masks of heavy segments.

    Rows with one key have one text. The segments of one of them stand for all, counted as often as the key comes.
    """
    name = docs.schema["id"].dataType.simpleString()
    parts = "array<struct<anchor:bigint,digest:bigint,start:int,windows:int,place:int>>"
    all_ = arrow_map(docs.select("id", "k1", "k2", "text"), lambda b: _outline(b, window, gram), f"id {name}, k1 bigint, k2 bigint, n_words bigint, digest string, segments {parts}")
    all_ = save(all_.withColumn("row", F.monotonically_increasing_id()), "outline")
    first = saved()[-1:]
    # Small sides are written down before they are joined: a join on top of their aggregate could not split a hot key.
    copies = save(all_.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("first")).where("copies > 1"), "copies")
    single = all_.join(copies, ["k1", "k2"], "left").where("first IS NULL OR first = row")
    each = single.select("k1", "k2", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"), F.inline("segments"))
    shared = save(each.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"), "anchors")
    known = save(each.join(shared, "anchor", "left_semi"), "segments")
    outline = save(all_.drop("segments", "row"), "texts")
    drop_saved(docs.sparkSession, first)
    folded = known.groupBy("anchor", "digest").agg(
        F.sum("copies").alias("n"), F.min("k2").alias("k2"), F.min_by("k1", "k2").alias("k1"), F.min_by("start", "k2").alias("start"), F.min("windows").alias("windows")
    )
    folded = save(folded, "folded")
    many = folded.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor", F.lit(True).alias("hot"))
    many = save(many, "hot")
    marked = folded.join(many, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    reps = marked.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "digest", "n", "start", "windows", "hot")).alias("reps"))
    keys = known.groupBy("k1", "k2").agg(F.max("copies").alias("copies")).join(reps, ["k1", "k2"], "left")
    texts = docs.select("id", "k1", "k2", "text").join(keys, ["k1", "k2"]).withColumn("row", F.monotonically_increasing_id())
    texts = save(texts, "candidates")
    # Of rows with one key, one is cut.
    cut_once = texts.where("copies > 1 AND size(reps) > 0").groupBy("k1", "k2").agg(F.min("row").alias("row")).select("row")
    once = texts.where("copies = 1").unionByName(texts.where("copies > 1").join(save(cut_once, "cut-once"), "row", "left_semi").select(*texts.columns))
    chosen = lambda of: once.select("text", F.filter("reps", of).alias("reps")).where("size(reps) > 0")
    cut = arrow_map(chosen(lambda s: ~s["hot"]), lambda b: _cut(b, window), "anchor bigint, digest bigint, n bigint, words binary")
    dealt = cut.repartition("anchor").sortWithinPartitions("anchor", "digest")
    masks = stream_map(dealt, lambda b: _search(b, window), "anchor bigint, digest bigint, mask bigint")
    if not many.isEmpty():
        cut_up = arrow_map(chosen(lambda s: s["hot"]), lambda b: _windows(b, window), "anchor bigint, digest bigint, n bigint, base bigint, window bigint")
        masks = masks.unionByName(counted(save(cut_up, "windows")))
    masks = save(masks.groupBy("anchor", "digest").agg(F.bit_or("mask").alias("mask")), "masks")
    heavy = heavy_masks(folded, masks, share)
    hits = placed(known, masks, heavy).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "mask", "anchor", "digest")).alias("hits"))
    return outline, texts.select("id", "k1", "k2", "text"), hits, heavy


def key_of(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """k1, k2: rows with one key hold the same text."""
    id_ = F.col(id_col)
    first = F.coalesce(id_.cast("bigint"), F.lit(0)) if isinstance(df.schema[id_col].dataType, T.IntegralType) else F.xxhash64(id_)
    return [first.alias("k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2")]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), *key_of(df, id_col, text_col), F.col(text_col).alias("text"))


def deduplicate(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """Every text without the words of windows that stand anywhere else.

    id_col, n_words, n_removed, kept_sha256 (of the kept words joined by
    spaces). One row per row of `df`, with a null id too. Null and empty texts
    have no words; texts shorter than a window lose nothing; all of a text that
    another row repeats goes, in both. Rows equal in id and text cost one row's
    segments, however many they are. An empty table gives none. Other columns
    are not read.
    """
    docs = keyed(df, id_col, text_col)
    outline, texts, hits, heavy = repeats(docs, window, hot=hot, share=share)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string"
    done = arrow_map(texts.join(hits, ["k1", "k2"], "left").select("id", "text", "hits"), lambda b: _kept(b, window, heavy), schema)
    rest = outline.join(texts.select("k1", "k2"), ["k1", "k2"], "left_anti").select(
        "id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("digest").alias("kept_sha256")
    )
    return done.unionByName(rest).withColumnRenamed("id", id_col)


def rewrite(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """`df` with its texts cut as in `deduplicate`: the kept words joined by spaces where words went, else the text as it is."""
    docs = keyed(df, id_col, text_col)
    _, _, hits, heavy = repeats(docs, window, hot=hot)
    names, place = df.columns, df.columns.index(text_col)
    whole = df.select(F.struct(*df.columns).alias("row"), *key_of(df, id_col, text_col))

    def function(batch):
        row = batch.column(0)
        texts = []
        for text, hit in zip(row.field(place).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = named(hit, heavy)
            texts.append(without(split(text), found, window)[0].decode() if found else text)
        columns = [pa.array(texts, pa.string()) if i == place else row.field(i) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(whole.join(hits, ["k1", "k2"], "left").select("row", "hits"), function, df.schema)
