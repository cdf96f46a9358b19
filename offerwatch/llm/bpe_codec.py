"""Byte-level BPE without running merges.

All tokens stand in an Aho-Corasick automaton over bytes mapped to Latin-1. A
piece is covered by longest matches, looked up only where a token is to start; a token may follow another only if the
merges would leave the two apart, which is looked up in a memo of adjacent
tokens, and where no token may follow, the last one is shortened. Tokens that
are pairwise compatible are what the merges produce, and every position is
given up at most once, so the time is linear in the text. The different short
pieces of a run of texts that are not known yet take these steps together, as
columns; what is known of pieces is kept in Arrow arrays and taken from there.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwatch.llm.common import arrow_map, tool

#: Pieces and pairs remembered by a worker before it forgets them.
MEMO = 300_000
#: Pieces that are walked together at most, bytes of the longest of them, and how many are left to be walked alone.
RUN, SHORT, FEW = 50_000, 64, 64
#: Stands between matches that are walked together; in no token, as those are Latin-1.
SEPARATOR = "\u0100"
#: Above every rank.
NONE = 1 << 60


class Codec:
    def __init__(self, path: str, pattern: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as ranks:
            for line in ranks:
                if fields := line.split():
                    self.rank[base64.b64decode(fields[0])] = int(fields[1])
        self.token = {rank: token for token, rank in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.width = max(self.token, default=0) + 1
        self.size = np.zeros(self.width, np.int64)
        self.shorter = np.full(self.width, -1)  # the longest token that is a proper prefix
        for token, rank in self.rank.items():
            self.size[rank] = len(token)
            self.shorter[rank] = next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), -1)
        self.decimal = [b"%d " % rank for rank in range(self.width)]
        self.digits = np.fromiter(map(len, self.decimal), np.int64, self.width)
        self.apart = Apart(self)
        self.pieces = Pieces(self)

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves, for two tokens' worth of bytes."""
        rank = self.rank.get
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]  # of each part with the next; a merge changes two
        while ranks and (least := min(ranks)) < NONE:
            best = ranks.index(least)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
            del ranks[best]
            if best:
                ranks[best - 1] = rank(parts[best - 1] + parts[best], NONE)
            if best < len(ranks):
                ranks[best] = rank(parts[best] + parts[best + 1], NONE)
        return [self.rank[part] for part in parts]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if not data:
            return []
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        text, longest, apart, width, bytes_of = data.decode("latin-1"), self.automaton.iter_long, self.apart, self.width, self.token
        shut: set[int] = set()
        out: list[int] = []
        at = 0
        matches = longest(text)  # the first from a place on is the longest that starts there, as every byte is a token
        _, token = next(matches)
        while True:
            end = at + len(bytes_of[token])
            if end not in shut and (not out or apart[out[-1] * width + token]):
                out.append(token)
                at = end
                if at == len(data):
                    return out
                if matches is None:
                    matches = longest(text, at)
                _, token = next(matches)
                continue
            matches = None
            token = int(self.shorter[token])
            while token < 0:  # nothing may stand here: the token before has to give way
                shut.add(at)
                last = out.pop()
                at -= len(bytes_of[last])
                token = int(self.shorter[last])

    def fit(self, left, right):
        """Of each token, whether it may follow the one on its left; anything may follow none (below 0)."""
        fits = left < 0
        both = np.flatnonzero(~fits)
        fits[both] = self.apart.of(left[both] * self.width + right[both])
        return fits

    def together(self, data: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """Of matches what `Pieces` keeps, found as `piece` finds it.

        Short matches are walked as one text. Of each, the tokens up to the first that may not follow are laid, that one is
        shortened or those before it give way, and what is behind it is walked in the next round. `piece` does the rest.
        """
        whole = SEPARATOR.join([d.decode("latin-1") for d in data])
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        stop = np.cumsum(sizes + 1) - 1
        begin = stop - sizes
        laid = np.full(len(whole) + 1, -1)  # the token whose last byte is at a place
        shut = np.zeros(len(whole) + 1, bool)
        short = (sizes > 0) & (sizes <= SHORT)
        of = np.flatnonzero(short)  # matches that are not done
        at = begin[of]  # how far they are
        while len(of) > FEW:
            rest = SEPARATOR.join([whole[a:b] for a, b in zip(at.tolist(), stop[of].tolist(), strict=True)])
            walked = np.fromiter(itertools.chain.from_iterable(self.automaton.iter_long(rest)), np.int64).reshape(-1, 2)
            end, token = walked[:, 0] + 1, walked[:, 1]
            span = stop[of] - at
            head = np.cumsum(span + 1) - span - 1  # of each match, in `rest`
            which = np.repeat(np.arange(len(of)), np.diff(np.searchsorted(end, head, "right"), append=len(end)))
            first = end - self.size[token] == head[which]
            left = np.concatenate([[-1], token[:-1]])
            left[first] = np.where(at > begin[of], laid[at - 1], -1)
            end += (at - head)[which]
            bad = np.flatnonzero(~self.fit(left, token) | shut[end])
            some, one = np.unique(which[bad], return_index=True)
            bad = bad[one]
            upto = np.full(len(of), len(token))
            upto[some] = bad
            good = np.arange(len(token)) < upto[which]
            laid[end[good] - 1] = token[good]
            of, token, at = of[some], token[bad], end[bad] - self.size[token[bad]]
            wrong = np.arange(len(of))
            while len(wrong):
                token[wrong] = self.shorter[token[wrong]]
                none = wrong[token[wrong] < 0]
                while len(none):  # nothing may stand here: the token before has to give way
                    shut[at[none]] = True
                    last = laid[at[none] - 1]
                    laid[at[none] - 1] = -1
                    at[none] -= self.size[last]
                    token[none] = self.shorter[last]
                    none = none[token[none] < 0]
                left = np.where(at[wrong] > begin[of[wrong]], laid[at[wrong] - 1], -1)
                wrong = wrong[~self.fit(left, token[wrong]) | shut[at[wrong] + self.size[token[wrong]]]]
            at += self.size[token]
            laid[at - 1] = token
        for i in [*of.tolist(), *np.flatnonzero(~short).tolist()]:
            token = np.array(self.piece(data[i]), np.int64)
            laid[begin[i] : stop[i]] = -1
            laid[begin[i] + np.cumsum(self.size[token]) - 1] = token
        filled = laid >= 0
        rows, ends = laid[filled], np.cumsum(filled)[stop]  # a separator's place is never filled
        ids = rows.tolist()
        return (
            binary(b"".join([self.decimal[i] for i in ids]), self.digits[rows], ends),
            binary(self.decode(ids), self.size[rows], ends),
        )

    def parts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text its ids, as decimal text joined by spaces, and the bytes that they decode to."""
        found = [self.pattern.findall(text) for text in texts]
        flat = pa.array(itertools.chain.from_iterable(found), pa.large_string()).dictionary_encode()
        bounds = np.cumsum([0, *map(len, found)])
        del found
        ids, decoded = (strung(kept.take(flat.indices), bounds) for kept in self.pieces.of(flat.dictionary))
        for (start, stop), of in zip(ids[1], decoded[1], strict=True):
            yield bytes(ids[0][start : max(start, stop - 1)]), bytes(decoded[0][slice(*of)])

    def encode(self, text: str) -> list[int]:
        return list(map(int, next(self.parts([text]))[0].split()))

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])


def binary(data: bytes, sizes, ends) -> pa.Array:
    """`data`, which is made of parts of those sizes, as one value up to each of the `ends` (numbers of parts)."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def strung(values: pa.Array, bounds) -> tuple[memoryview, list[tuple[int, int]]]:
    """The values' bytes, one after another, and where those between each two bounds (numbers of values) stand."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[bounds + values.offset] if len(values) else bounds
    return memoryview(data or b""), list(itertools.pairwise(at.tolist()))


class Apart(dict):
    """Of two tokens, left * width + right: whether the merges leave them as they stand, side by side; worked out when first asked for."""

    def __init__(self, own: Codec):
        self.own = own
        self.late = np.full(1 << 20, -1)  # pairs asked for of late, twice their number plus the answer, each in its slot

    def __missing__(self, pair: int) -> bool:
        left, right = divmod(pair, self.own.width)
        if len(self) >= MEMO:
            self.clear()
        found = self[pair] = self.own.merged(self.own.token[left] + self.own.token[right]) == [left, right]
        return found

    def of(self, pairs):
        """The answers for many pairs."""
        slot = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)
        late = self.late[slot]
        new = np.flatnonzero(late >> 1 != pairs)
        asked, back = np.unique(pairs[new], return_inverse=True)
        answers = np.fromiter(map(self.__getitem__, asked.tolist()), bool, len(asked))
        late[new] = (asked * 2 + answers)[back]
        self.late[slot[new]] = late[new]
        return late & 1 == 1


class Pieces:
    """Of matches that were asked for before: their ids as decimal text, a space behind each, and the bytes that they decode to."""

    def __init__(self, own: Codec):
        self.own = own
        self.matches = pa.array([], pa.large_string())
        self.ids = self.decoded = pa.array([], pa.large_binary())

    def of(self, asked: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The ids and bytes of different matches. Where there is no room for the new ones, all that are not asked for are forgotten."""
        known = pc.index_in(asked, value_set=self.matches)
        new = asked.filter(known.is_null())
        at = known.fill_null(-1).to_numpy().copy()
        if len(self.matches) + len(new) > MEMO or self.matches.nbytes > MEMO * SHORT:
            kept = known.drop_null()
            self.matches, self.ids, self.decoded = self.matches.take(kept), self.ids.take(kept), self.decoded.take(kept)
            at[at >= 0] = np.arange(len(kept))
        at[at < 0] = len(self.matches) + np.arange(len(new))
        runs = [self.own.together([m.encode() for m in new.slice(i, RUN).to_pylist()]) for i in range(0, len(new), RUN)]
        self.matches = pa.concat_arrays([self.matches, new])
        self.ids = pa.concat_arrays([self.ids, *[ids for ids, _ in runs]])
        self.decoded = pa.concat_arrays([self.decoded, *[decoded for _, decoded in runs]])
        return self.ids.take(pa.array(at)), self.decoded.take(pa.array(at))


def codec(path: str, pattern: str) -> Codec:
    return tool(("codec", path, pattern), lambda: Codec(path, pattern))


def encode(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """Ids of every whole text: id_col, ids.

    Null is an empty text and has no ids; every row gives one row, repeated or
    not; other columns of `df` are not read.
    """

    def function(batch):
        own = codec(path, pattern)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = [list(map(int, joined.split())) for joined, _ in own.parts(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return arrow_map(df.select(F.col(id_col).alias("id"), text_col), function, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str, pattern: str) -> DataFrame:
    """The bytes that the ids stand for: id_col, decoded. Null ids decode to nothing."""

    def function(batch):
        own = codec(path, pattern)
        ids = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(i or []) for i in ids], pa.binary())], ["id", "decoded"])

    return arrow_map(df.select(F.col(id_col).alias("id"), ids_col), function, f"id {df.schema[id_col].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass and keep only the digests: id_col, n_tokens,
    ids_sha256 (decimal ids joined by spaces), decoded_sha256 (bytes decoded from the ids).

    The round trip of `encode` and `decode` without sending the ids to the JVM and back.
    """

    def function(batch):
        own = codec(path, pattern)
        counts, ids, decoded = [], [], []
        for joined, back in own.parts([t or "" for t in batch.column(1).to_pylist()]):
            counts.append(joined.count(b" ") + 1 if joined else 0)
            ids.append(hashlib.sha256(joined).hexdigest())
            decoded.append(hashlib.sha256(back).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return arrow_map(df.select(F.col(id_col).alias("id"), text_col), function, schema).withColumnRenamed("id", id_col)
