"""Text quality by a convolutional network over bytes, in numpy.

Every byte has a learned vector. Filters, eight bytes wide and four apart, run
over the whole document; their strongest answers in each chunk of 512 bytes (a
new chunk starts every 256, so chunks overlap) are the chunk's vector. Mean and
maximum over all chunks give one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch.llm.common import arrow_map

STEP = 4  # bytes between two places of a filter, which is 2 * STEP wide
BLOCK = 256  # bytes; a chunk is two blocks
#: Bounds of what is learned from: labelled rows of each class, and chunks of a row, spread over the whole text.
TRAIN_ROWS = 4096
TRAIN_CHUNKS = 8
SLICE = 1 << 18  # bytes scored at once


@dataclass
class Network:
    vectors: np.ndarray  # (256, d)
    left: np.ndarray  # (STEP * d, filters)
    right: np.ndarray  # (STEP * d, filters)
    bias: np.ndarray  # (filters,)
    out: np.ndarray  # (2 * filters,)
    offset: np.ndarray  # (1,)

    def blocks(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Strongest answer of each filter in each block; `data` is whole blocks and STEP more bytes. Behind a text, whose last place is in `ends`, are zero bytes."""
        groups = self.vectors[data].reshape(-1, STEP * self.vectors.shape[1])
        both = groups @ np.concatenate([self.left, self.right], axis=1)
        filters = self.left.shape[1]
        answers = both[:-1, :filters] + both[1:, filters:]
        answers[ends] = both[ends, :filters] + np.tile(self.vectors[0], STEP) @ self.right
        return answers.reshape(-1, BLOCK // STEP, filters).max(1)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean and maximum over the chunks of each text."""
        counts = [max(1, -(-len(t) // BLOCK)) for t in texts]
        data = np.frombuffer(b"".join([t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, counts, strict=True)]) + bytes(STEP), np.uint8)
        lasts = np.cumsum(counts) * (BLOCK // STEP) - 1
        parts = []
        for at in range(0, len(data) - STEP, SLICE):
            end = min(at + SLICE, len(data) - STEP)
            parts.append(self.blocks(data[at : end + STEP], lasts[(lasts >= at // STEP) & (lasts < end // STEP)] - at // STEP))
        best = np.maximum(np.concatenate(parts) + self.bias, 0)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        chunks = best.copy()
        chunks[:-1] = np.maximum(best[:-1], best[1:])
        ends = np.cumsum(counts) - 1
        chunks[ends] = best[ends]  # a document's last chunk has no block after it
        mean = np.add.reduceat(chunks, starts, axis=0) / np.array(counts, np.float32)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunks, starts, axis=0)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.pooled(texts) @ self.out + self.offset[0], -30, 30).astype(np.float64)))


def spread(data: bytes, most: int = TRAIN_CHUNKS) -> list[bytes]:
    """At most `most` chunks of a text, evenly spread from its start to its end; all of them if there are no more."""
    n = max(1, -(-len(data) // BLOCK))
    picks = range(n) if n <= most else sorted({i * (n - 1) // (most - 1) for i in range(most)})
    return [data[p * BLOCK : (p + 2) * BLOCK + STEP].ljust(2 * BLOCK + STEP, b"\0") for p in picks]


def train(rows: list[tuple[list[bytes], int]], dims: int = 8, filters: int = 32, steps: int = 1500, batch: int = 32, rate: float = 0.01, share: float | None = None) -> Network:
    """Fit on texts, given as chunks, with labels 0 and 1; `share` is the share of label 1 to be assumed.

    Without rows, or with one label only, the score is a constant: 0.5, or near the label.
    """
    rng = np.random.default_rng(7)
    net = Network(
        rng.normal(0, 0.5, (256, dims)).astype(np.float32),
        rng.normal(0, 0.2, (STEP * dims, filters)).astype(np.float32),
        rng.normal(0, 0.2, (STEP * dims, filters)).astype(np.float32),
        np.zeros(filters, np.float32),
        np.zeros(2 * filters, np.float32),
        np.zeros(1, np.float32),
    )
    labels = np.array([y for _, y in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        net.offset[0] = 0 if not rows else (4 if labels[0] else -4)
        return net
    share = labels.mean() if share is None else share
    weights = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean())).astype(np.float32)
    chunks = [np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) for c, _ in rows]
    parameters = [net.vectors, net.left, net.right, net.bias, net.out, net.offset]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-steps * batch // len(rows)))])
    for step in range(1, steps + 1):
        pick = order[(step - 1) * batch : step * batch]
        grads = _gradients(net, [chunks[i] for i in pick], labels[pick], weights[pick])
        pace = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
        for p, g, m, v in zip(parameters, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    counts = np.array([len(t) for t in texts])
    data = np.concatenate(texts)  # (chunks, bytes)
    groups = net.vectors[data].reshape(len(data), -1, STEP * net.vectors.shape[1])
    filters = len(net.bias)
    both = groups @ np.concatenate([net.left, net.right], axis=1)
    answers = np.ascontiguousarray((both[:, :-1, :filters] + both[:, 1:, filters:]).transpose(0, 2, 1))  # (chunks, filters, places)
    place = answers.argmax(2)
    best = np.take_along_axis(answers, place[:, :, None], 2)[:, :, 0] + net.bias
    value = np.maximum(best, 0)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(texts)), counts)
    mean = np.add.reduceat(value, starts, axis=0) / counts[:, None].astype(np.float32)
    top = np.maximum.reduceat(value, starts, axis=0)
    pooled = np.concatenate([mean, top], axis=1)
    chance = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.offset[0], -30, 30)))
    error = ((chance - labels) * weights / len(texts)).astype(np.float32)
    to_pooled = error[:, None] * net.out
    is_top = value == top[owner]
    is_top = is_top / np.maximum(np.add.reduceat(is_top.astype(np.float32), starts, axis=0), 1)[owner]
    to_value = to_pooled[owner, :filters] / counts[owner, None] + to_pooled[owner, filters:] * is_top
    flow = (to_value * (best > 0)).astype(np.float32)  # (chunks, filters)
    rows = np.arange(len(data))[:, None]
    near, far = groups[rows, place], groups[rows, place + 1]  # (chunks, filters, STEP * d)
    left = np.einsum("cf,cfk->kf", flow, near)
    right = np.einsum("cf,cfk->kf", flow, far)
    vectors = np.zeros((net.vectors.shape[1], 256))
    bytes_ = data.reshape(len(data), -1, STEP)
    for side, shift in ((net.left, 0), (net.right, 1)):
        back = (flow[:, :, None] * side.T[None]).reshape(-1, net.vectors.shape[1])
        seen = bytes_[rows, place + shift].reshape(-1)
        for k in range(len(vectors)):
            vectors[k] += np.bincount(seen, back[:, k], 256)
    return [vectors.T.astype(np.float32), left, right, flow.sum(0), pooled.T @ error, np.array([error.sum()], np.float32)]


def held_out(id_: Column) -> Column:
    """A quarter of all ids, never learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> tuple[list[tuple[list[bytes], int]], float | None]:
    """At most `rows` labelled rows of each class that are not held out, by a hash of the id, as chunks; and the share of label 1.

    Bounded: 2 * rows * TRAIN_CHUNKS chunks reach the driver, whatever the size of the tables.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("_label")
    )
    share = known.agg(F.avg(F.col("_label").cast("double"))).first()[0]
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = known.where("_label = 0").orderBy(*order).limit(rows).unionByName(known.where("_label = 1").orderBy(*order).limit(rows))
    # at most 2 * rows pairs of numbers
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").select("_label", "_text")

    def function(batch):
        labels_, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(y) for y in labels_], pa.int32()), pa.array([spread((t or "").encode()) for t in texts_], pa.list_(pa.binary()))],
            ["label", "chunks"],
        )

    # repeated ids could multiply the rows, so the bound is held here as well
    found = arrow_map(texts, function, "label int, chunks array<binary>").orderBy("label", F.xxhash64("chunks"), "chunks")
    rows_ = found.where("label = 0").limit(rows).collect() + found.where("label = 1").limit(rows).collect()
    return [([bytes(c) for c in r["chunks"]], r["label"]) for r in rows_], share


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> Network:
    known, share = sample(docs, labels, id_col, text_col, label_col, rows)
    return train(known, share=share)


def scores(texts: list[str | None], net: Network) -> np.ndarray:
    """Scores of any number of texts, a bounded number of bytes at a time."""
    data = [(t or "").encode() for t in texts]
    found, at = [np.zeros(0)], 0
    while at < len(data):
        end, size = at, 0
        while end < len(data) and (end == at or size + len(data[end]) <= 16 * SLICE):
            size += len(data[end])
            end += 1
        found.append(net.score(data[at:end]))
        at = end
    return np.concatenate(found)


def score(df: DataFrame, id_col: str, text_col: str, net: Network) -> DataFrame:
    """id_col, score: probability of label 1 for every whole text.

    Null and empty texts are one chunk of zero bytes and get that chunk's
    score. One row per row of `df`; other columns are not read.
    """

    def function(batch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1).to_pylist(), net), pa.float64())], ["id", "score"])

    schema = f"id {df.schema[id_col].dataType.simpleString()}, score double"
    return arrow_map(df.select(F.col(id_col).alias("id"), text_col), function, schema).withColumnRenamed("id", id_col)


def accepted(df: DataFrame, text_col: str, net: Network, least: float) -> DataFrame:
    """The rows of `df` whose text scores `least` or more."""
    place = df.columns.index(text_col)

    def function(batch):
        yield batch.filter(pa.array(scores(batch.column(place).to_pylist(), net) >= least))

    return arrow_map(df, function, df.schema)
