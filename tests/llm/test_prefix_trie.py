"""The trie against one built turn by turn in plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerwatch.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, family=100, most=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % most
        base = conv - int(np.fmod(conv, family))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(conv)
        ends[seq].append(conv)
    children, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for node, in_ in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(in_) - 1) * len(node[-1][1]) if node else 0
    return Counter(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def conversations(seed):
    rng = random.Random(seed)
    words = ["", "a", "bé", "ccc", "🙂🙂", None]
    rows = []
    for conv in [*range(0, 230), 1000, 1001, 1002, 1099, -5, -100, -205]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 7, 9])):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(words[:3]) if rng.random() < 0.9 else rng.choice(words)))
    rows += [(400 + c, t, "user", "the same") for c in range(120) for t in range(3)]  # a large group of copies
    rows += [(700 + c, t, "user", "long") for c in range(9) for t in range(23 + c % 3)]  # long ones that share many turns
    rows += [(800, None, "user", "tie")] * 40 + [(801, None, None, None)] * 3  # one conversation of equal rows
    rows += [(None, 0, "user", "no conversation"), rows[0], rows[0], (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "batch"), [(32, 10_000), (2, 7), (5, 16)])
def test_trie_equals_a_plain_one(spark, width, batch):
    rows = conversations(width)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    frame = frame.select("*", *[F.lit("x").alias(c) for c in ("conv", "part", "pos", "digest", "level", "key")])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # a block is a batch
    try:
        got = prefix_trie.trie(frame, width=width)
        assert got.columns == COLUMNS
        found = Counter(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted = plain(rows)
    assert found == wanted, list((found - wanted).items())[:3] + list((wanted - found).items())[:3]


def test_empty_table_has_no_nodes(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(empty).count() == 0


def test_range_minima():
    rng = np.random.default_rng(1)
    values = rng.integers(-1, 6, 300)
    spans = prefix_trie.Ranges(values)
    first = rng.integers(0, 300, 500)
    last = first + rng.integers(0, 300, 500) % (300 - first)
    assert spans.least(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]
    at, depth = rng.integers(0, 300, 500), rng.integers(0, 6, 500)
    found = list(zip(spans.left(at, depth).tolist(), spans.right(at, depth).tolist(), strict=True))
    for i, (a, d) in enumerate(zip(at.tolist(), depth.tolist(), strict=True)):
        right, left = a, a
        while right + 1 < 300 and values[right + 1] >= d:
            right += 1
        while left > 0 and values[left] >= d:
            left -= 1
        assert found[i] == (left, right)
