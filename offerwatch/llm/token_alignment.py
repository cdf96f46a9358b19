"""How the tokens of two tokenizers lie over each other in the same text.

Both tokenizers cover the same bytes, so their tokens are two sorted lists of
ends. Merging them is cut on diagonals: by a binary search for each diagonal one
finds how many ends of either list stand before it, which gives pieces of equal
work that need nothing of each other. A piece reports the ends that both lists
have (there the texts' tokens are cut into groups, and the two tokens that end
there are linked); an end that falls on both sides of a cut is found when the
pieces are stitched.

How often a pair of ids is linked in the corpus is counted on Spark. Of two
tokens that end together one is the end of the other's bytes, so the pairs that
can occur are given by the two vocabularies: a token has as many ends as bytes,
so there are at most (bytes of all tokens of both) times the ids that share the
same bytes. That bound, which no corpus can exceed, is checked before the table
is broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offerwatch.llm.common import arrow_map, save, tool

#: Ends that a piece of a merge takes in.
PIECE = 4096
#: Characters of texts that are merged in one go.
BATCH_CHARS = 1 << 18
#: Possible pairs up to which their table may be broadcast (24 bytes each).
BROADCAST_PAIRS = 4_000_000


@functools.cache
def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A: a byte-level BPE of the tokenizers library. Special tokens in a text are plain text.

    Where its merges stand in the order of their ids and it only splits by its
    byte level's pattern, the ids are ranks; with that pattern given, tiktoken
    finds the same ids from them in a fifth of the time.
    """

    def __init__(self, path: str, pattern: str | None = None):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        letters = byte_of_letter()
        special = {t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*model["vocab"].values(), *special]) + 1)
        for token, i in [*model["vocab"].items(), *[(t["content"], t["id"]) for t in spec["added_tokens"]]]:
            self.bytes[i] = token.encode() if i in special else bytes([letters[c] for c in token])
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ranked = (
            pattern is not None and model["type"] == "BPE" and made == sorted(made) and spec["normalizer"] is None and split["type"] == "ByteLevel"
            and split["use_regex"] and not split["add_prefix_space"] and not model.get("dropout") and not model.get("ignore_merges")
        )
        if ranked:
            ranks = {token: i for i, token in enumerate(self.bytes) if i not in special}
            self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        else:
            self.ranked = None
            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            self.model.no_truncation()
            self.model.no_padding()

    def ids(self, text: str) -> list[int]:
        return self.ranked.encode_ordinary(text) if self.ranked else self.model.encode(text, add_special_tokens=False).ids


class PieceLevel:
    """Tokenizer B: a sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.bytes = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(size)
        ]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Both:
    """The two tokenizers with what a worker needs of their vocabularies."""

    def __init__(self, a_path: str, b_path: str, pattern: str | None = None):
        self.a, self.b = ByteLevel(a_path, pattern), PieceLevel(b_path)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        # ids as text, with what may follow: another of the same side, the other side, another group
        self.a_text, self.b_text = ([np.array([f"{i}{end}" for i in range(len(x.bytes))], object) for end in ends] for x, ends in ((self.a, ",|"), (self.b, ",;")))

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none if there is no text or the tokens' bytes are not those of the text with a space before it."""
        a_bytes, b_bytes = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        a_ids, b_ids = [], []
        for text, b in zip(texts, self.b.ids([t or "" for t in texts]), strict=True):
            a = self.a.ids(f" {text}") if text else []
            whole = f" {text}".encode() if text else b""
            same = bool(text) and b"".join(map(a_bytes, a)) == whole and b"".join(map(b_bytes, b)) == whole
            a_ids.append(a if same else [])
            b_ids.append(b if same else [])
        return a_ids, b_ids


def both(a_path: str, b_path: str, pattern: str | None = None) -> Both:
    return tool(("both", a_path, b_path, pattern), lambda: Both(a_path, b_path, pattern))


@functools.lru_cache(maxsize=2)
def possible_pairs(a_path: str, b_path: str) -> int:
    """How many id pairs can ever be linked: tokens of which one's bytes end the other's."""
    own = Both(a_path, b_path)
    total = 0
    for short, long in ((own.a, own.b), (own.b, own.a)):
        of: dict[bytes, int] = {}
        for token in short.bytes:
            of[token] = of.get(token, 0) + 1
        total += sum(of.get(token[i:], 0) for token in long.bytes for i in range(len(token) + 1))
    return total


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of `a` and of `b` stand before each cut of their merge; of equal values that of `a` comes first."""
    total = len(a) + len(b)
    cut = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(cut - len(b), 0), np.minimum(cut, len(a))
    while (low < high).any():  # all diagonals at once, each by its own halving
        open_ = low < high
        middle = (low + high) // 2
        # on the diagonal, take more of a where its next value is not above the last one taken of b
        more = np.zeros(len(cut), bool)
        more[open_] = a[middle[open_]] <= b[cut[open_] - middle[open_] - 1]
        low = np.where(open_ & more, middle + 1, low)
        high = np.where(open_ & ~more, middle, high)
    return low, cut - low


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
    """Places in `a` of the ends a piece has from both lists."""
    mine, other = a[i0:i1], b[j0:j1]
    if not len(mine) or not len(other):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
    return np.flatnonzero(other[at] == mine) + i0


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Places in `a` of the values that `b` has as well; both strictly rising."""
    i, j = diagonals(a, b, piece)
    found = [overlaps(a, b, *bounds) for bounds in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    # A value on both sides of a cut stands last in a before it and first in b behind it.
    inner = (i > 0) & (j < len(b))
    split = np.flatnonzero(inner)[a[i[inner] - 1] == b[j[inner]]]
    return np.unique(np.concatenate([*found, i[split] - 1])) if len(a) and len(b) else np.zeros(0, np.int64)


class Aligned:
    """The tokens of a list of texts laid end to end and cut into groups, which end with each text at the latest."""

    def __init__(self, own: Both, a_ids: list[list[int]], b_ids: list[list[int]], piece: int = PIECE):
        self.a, self.b = (np.fromiter(itertools.chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (a_ids, b_ids))
        a_ends, b_ends = np.cumsum(own.a_sizes[self.a]), np.cumsum(own.b_sizes[self.b])
        #: Last token of each group, of either side.
        self.a_last = common_ends(a_ends, b_ends, piece)
        self.b_last = np.searchsorted(b_ends, a_ends[self.a_last])
        #: Tokens and groups up to the end of each text.
        self.a_text, self.b_text = (np.cumsum([len(i) for i in x], dtype=np.int64) for x in (a_ids, b_ids))
        self.groups = np.searchsorted(self.a_last, self.a_text)
        self.own = own

    def written(self) -> list[str]:
        """The groups of each text: ids of A, ids of B, next group."""
        own, a, b, a_last, b_last = self.own, self.a, self.b, self.a_last, self.b_last
        a_sizes, b_sizes = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        a_at = np.arange(len(a)) + np.repeat(b_last + 1 - b_sizes, a_sizes)
        b_at = np.arange(len(b)) + np.repeat(a_last + 1, b_sizes)
        parts = np.empty(len(a) + len(b), object)
        parts[a_at], parts[b_at] = own.a_text[0][a], own.b_text[0][b]
        parts[a_at[a_last]], parts[b_at[b_last]] = own.a_text[1][a[a_last]], own.b_text[1][b[b_last]]
        listed, ends = parts.tolist(), (self.a_text + self.b_text).tolist()
        return ["".join(listed[start:end])[:-1] for start, end in zip([0, *ends[:-1]], ends, strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs (a * size of B's vocabulary + b) of each text: where a text's begin, pairs, how often each is linked."""
        base = len(self.own.b.bytes)
        span = len(self.own.a.bytes) * base
        which = np.searchsorted(self.groups, np.arange(len(self.a_last)), "right")
        found, times = np.unique(which * span + self.a[self.a_last] * base + self.b[self.b_last], return_counts=True)
        return np.searchsorted(found, np.arange(len(self.groups) + 1) * span), found % span, times


def outlines(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, pattern: str | None, piece: int) -> DataFrame:
    """Per text: id, n_a, n_b, n_groups, groups_sha256, and its linked id pairs with how often each is linked."""

    def function(batch):
        own = both(a_path, b_path, pattern)
        texts = batch.column(1).to_pylist()
        start = 0
        while start < len(texts):  # as many texts as make a batch, one at least
            stop, held = start, 0
            while stop < len(texts) and held < BATCH_CHARS:
                held += len(texts[stop] or "")
                stop += 1
            laid = Aligned(own, *own.tokens(texts[start:stop]), piece)
            bounds, pairs, times = laid.pairs()
            n_a = np.diff(laid.a_text, prepend=0)
            digests = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(laid.written(), n_a.tolist(), strict=True)]
            nested = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, stop - start), pa.array(n_a), pa.array(np.diff(laid.b_text, prepend=0)), pa.array(np.diff(laid.groups, prepend=0)), pa.array(digests, pa.string()), nested],
                ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
            )
            start = stop

    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<struct<pair:bigint,n:bigint>>"
    return arrow_map(df.select(F.col(id_col).alias("id"), text_col), function, schema)


def pair_counts(lines: DataFrame, base: int) -> DataFrame:
    """pair, count (links of the corpus that hold it), best (no id of A is linked to this id of B more often)."""
    counts = lines.select(F.inline("links")).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = save(counts, "pairs")
    highest = counts.groupBy((F.col("pair") % base).alias("b")).agg(F.max("count").alias("highest"))
    return save(counts.withColumn("b", F.col("pair") % base).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "best")


def align(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, pattern: str | None = None, piece: int = PIECE) -> DataFrame:
    """Groups and links of the tokens of every whole text under two tokenizers.

    Columns: id_col, n_a, n_b, n_groups, n_links, n_best (links whose pair is
    the one that its id of B has most often in the corpus, ties included),
    count_sum (over links, how often their pair is linked in the corpus),
    groups_sha256. A is a byte-level .json and sees the text behind a space, B
    a sentencepiece .model; `pattern`, by which A's byte level splits texts, only
    saves time. Null and empty texts, and texts whose tokens do not
    give back their bytes, have zeros and an empty groups_sha256. Every row
    gives one row, repeated or not, with a null id too, and repeated rows count
    as often as they come; an empty table gives none; other columns are not read.

    Texts are read once. Links go from the written table to the counts folded
    per document and then per task, and the counts come back to them without a
    shuffle of links where the vocabularies bound the table (see above), else
    by a join that Spark lays out.
    """
    base = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    lines = outlines(df, id_col, text_col, a_path, b_path, pattern, piece).withColumn("row", F.monotonically_increasing_id())
    lines = save(lines, "alignment")
    table = pair_counts(lines, base)
    if possible_pairs(a_path, b_path) <= BROADCAST_PAIRS:
        table = F.broadcast(table)
    zero = F.lit(0).cast("bigint")
    links = lines.select("row", F.inline("links")).join(table, "pair")
    sums = links.groupBy("row").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(zero)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    joined = lines.drop("links").join(sums, "row", "left")
    return joined.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", *[F.coalesce(c, zero).alias(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256"
    )
