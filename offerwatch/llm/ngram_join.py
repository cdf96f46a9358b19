"""Near duplicates by the Jaccard similarity of word n-grams: a MinHash LSH forest, then exact counts.

Texts with the same set of n-grams are one class, which has a signature of
TREES labels of DEPTH minima each. A tree of the forest is the sorted list of
one label of all classes; classes that share a prefix are neighbours in it. The
prefix starts at full depth and is shortened, one minimum at a time, until the
target recall is reached: by a sample of classes that is compared with all
others, and by the chance of a pair right at the threshold, of which a sample
may hold few. The comparison notes the deepest common prefix of each pair found,
so one pass over the signatures tells the recall of every depth. Under a
shared prefix the whole signatures are compared, and classes that look alike
become a group. All pairs of a group are then counted exactly on their n-grams.

Pairs are never rows. A prefix or a group with many classes is dealt over
blocks of bounded size, each pair of blocks a task's work of its own, which
gives back links per class and a spanning forest.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwatch.llm.common import arrow_map, components, grouped, hashed, save, stream_map
from offerwatch.llm.substring_dedup import keyed, mixed

GRAM = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.9995  # of the audited pairs, and of pairs right at the threshold
AUDIT = 256  # classes compared with all others
SHORTEST = 2  # minima of a prefix that audited classes share with another class
BLOCK = 512  # classes; a task compares two blocks at once
FOLD = 200_000  # classes; a task folds the links between so many before it gives them on
#: Signatures may fall this much short of the threshold before a pair is given up: five deviations of 128 minima.
SLACK = 5 * (THRESHOLD * (1 - THRESHOLD) / (TREES * DEPTH)) ** 0.5

#: Bytes that are part of a word: ASCII letters and digits and everything beyond ASCII.
WORD = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def expected(depth: int, threshold: float, trees: int = TREES) -> float:
    """The chance that a pair at the threshold shares a prefix of `depth` minima in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(found: list[int], threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix with the recall asked for.

    found[d]: audited pairs whose deepest common prefix has d minima. The walk
    ends at a prefix of one minimum at the latest; without audited pairs the
    chance at the threshold alone decides.
    """
    depth, all_ = len(found) - 1, sum(found)
    while depth > 1 and (sum(found[depth:]) < recall * all_ or expected(depth, threshold) < recall):
        depth -= 1
    return depth


@functools.cache
def factors() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, (2, max(GRAM, TREES * DEPTH)), np.uint64) * np.uint64(2) + np.uint64(1)


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of GRAM words, lower-cased; a shorter text is one run; none has none."""
    words = (text or "").lower().encode().translate(WORD).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashed(words)
    n = min(GRAM, len(h))
    sums = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        sums += h[j : j + len(sums)] * factors()[0, j]
    return np.unique(mixed(sums))


def signature(found: np.ndarray) -> bytes:
    """TREES * DEPTH minima of 32 bits, those of a tree next to each other."""
    best = np.full(TREES * DEPTH, np.uint32(0xFFFFFFFF))
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048]
        rows = (part[:, None] * factors()[1]) >> np.uint64(32)
        best = np.minimum(best, rows.min(0).astype(np.uint32))
    return best.astype("<u4").tobytes()


def _signed(batch):
    keys, signs = [], []
    for text in batch.column(3).to_pylist():
        found = grams(text)
        keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
        signs.append(signature(found) if len(found) else None)
    yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["id", "k1", "k2", "class", "sign"])


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep together what a matrix of links connects."""
    n = len(near)
    fresh = np.ones(n, bool)
    links = []
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        edge = np.array([root])
        while len(edge):
            found = np.flatnonzero(near[edge].any(0) & fresh)
            fresh[found] = False
            links += [(root, int(f)) for f in found]
            edge = found
    return links


def alike(signs: np.ndarray) -> np.ndarray:
    """Share of equal minima of each pair of rows."""
    same = np.zeros((len(signs), len(signs)), np.int16)
    for column in signs.T:
        same += column[:, None] == column[None, :]
    return same / signs.shape[1]


def _deepest(signs: np.ndarray, sample: np.ndarray, threshold: float) -> np.ndarray:
    """Of pairs of a row and a sampled one that look alike at the threshold: how many have each depth as their deepest common prefix."""
    found = np.zeros(DEPTH + 1, np.int64)
    for at in range(0, len(signs), 1024):
        part = signs[at : at + 1024]
        same = np.zeros((len(part), len(sample)), np.uint8)
        for k in range(TREES * DEPTH):
            same += part[:, k, None] == sample[None, :, k]
        rows, columns = np.nonzero(same >= threshold * TREES * DEPTH)
        for first in range(0, len(rows), 65536):
            r, c = rows[first : first + 65536], columns[first : first + 65536]
            equal = (part[r] == sample[c]).reshape(len(r), TREES, DEPTH)
            deepest = np.logical_and.accumulate(equal, 2).sum(2).max(1)
            found += np.bincount(deepest, minlength=DEPTH + 1)
    return found


def prefixes(depth: int):
    """One number for each tree's prefix of a signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring(F.col("sign"), t * (4 * DEPTH) + 1, F.lit(4 * depth))))


def audit(classes: DataFrame, threshold: float = THRESHOLD, most: int = AUDIT) -> list[int]:
    """Links of a sample of classes to all others by their signatures: how many have each depth as their deepest common prefix.

    classes: class, sign. Sampled are at most `most` classes that are the first
    under a prefix of SHORTEST minima which other classes share, so that a large
    group counts little more than a small one. All zeros where no class shares one.
    """
    shared_by = classes.select("class", F.explode(prefixes(SHORTEST)).alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("class").alias("class")
    )
    chosen = shared_by.where("size > 1").select("class").distinct().orderBy(F.xxhash64("class"), "class").limit(most)
    rows = classes.join(F.broadcast(chosen), "class").select("sign").collect()  # at most `most` signatures
    if not rows:
        return [0] * (DEPTH + 1)
    sample = np.frombuffer(b"".join(bytes(r["sign"]) for r in rows), "<u4").reshape(len(rows), -1)

    def compared(batch):
        signs = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(batch.num_rows, -1)
        found = _deepest(signs, sample, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(range(DEPTH + 1), pa.int32()), pa.array(found, pa.int64())], ["depth", "n"])

    counts = arrow_map(classes.select("sign"), compared, "depth int, n bigint").groupBy("depth").agg(F.sum("n").alias("n")).collect()
    found = {r["depth"]: r["n"] for r in counts}
    found[DEPTH] -= len(rows)  # each with itself
    return [found.get(d, 0) for d in range(DEPTH + 1)]


def folded(batches, most: int = FOLD):
    """Links of a task as stars: each node to the smallest of those that it is connected with here, `most` nodes at a time."""
    above: dict[bytes, bytes] = {}

    def top(node):
        while (up := above[node]) != node:
            above[node] = above[up]  # paths halve on the way
            node = up
        return node

    def stars():
        found = [(node, up) for node in above if (up := top(node)) != node]
        above.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            above.setdefault(a, a), above.setdefault(b, b)
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
        if len(above) >= most:
            yield stars()
    if above:
        yield stars()


def _meet(batches, least: float):
    """Under each prefix, links between classes whose signatures are alike."""
    for table in grouped(batches, ["bucket", "i", "j"], 4096):
        keys = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
        change = np.zeros(table.num_rows, bool)
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        classes = table.column("class").to_pylist()
        signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), "<u4").reshape(table.num_rows, -1)
        a, b = [], []
        for start, end in zip(bounds, bounds[1:], strict=False):
            if end - start == 2:
                links = [(0, 1)] if (signs[start] == signs[start + 1]).mean() >= least else []
            else:
                links = forest(alike(signs[start:end]) >= least) if end - start > 2 else []
            a += [classes[start + x] for x, _ in links]
            b += [classes[start + y] for _, y in links]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections.

    Members that always come together are one column of a matrix, weighed by
    how many they are, so near copies of one text make a small matrix.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    marks = np.random.default_rng(3).integers(0, 1 << 63, (2, n), np.uint64)
    pattern = np.zeros((2, len(values)), np.uint64)
    np.add.at(pattern[0], place, marks[0][owner])
    np.add.at(pattern[1], place, marks[1][owner])
    often = np.bincount(place, minlength=len(values)) > 1
    both = np.zeros((n, n))
    both[np.arange(n), np.arange(n)] = sizes
    if not often.any():
        return both
    _, first, column, weight = np.unique(pattern[:, often], axis=1, return_index=True, return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    to_column = np.full(len(values), -1)
    to_column[np.flatnonzero(often)[first]] = np.arange(len(first))
    lead = to_column[place]
    rows, columns = owner[lead >= 0], lead[lead >= 0]
    total = np.zeros((n, n))
    for at in range(0, len(first), 4096):
        here = (columns >= at) & (columns < at + 4096)
        matrix = np.zeros((n, min(4096, len(first) - at)), np.float32)
        matrix[rows[here], columns[here] - at] = 1
        total += (matrix * weight[at : at + 4096].astype(np.float32)) @ matrix.T
    total[np.arange(n), np.arange(n)] = sizes
    return total


def _verify(batches, threshold: float):
    """In each pair of blocks of a group: links of each class, copies weighed, and a spanning forest of them."""
    for table in grouped(batches, ["group", "i", "j"], 256):
        groups = table.column("group").to_pylist()
        blocks = list(zip(groups, table.column("i").to_pylist(), table.column("j").to_pylist(), strict=True))
        bounds = [0, *[x for x in range(1, len(blocks)) if blocks[x] != blocks[x - 1]], len(blocks)]
        classes, copies, own = (table.column(c).to_pylist() for c in ("class", "copies", "block"))
        texts = table.column("grams").to_pylist()
        out = {"a": [], "b": [], "links": []}
        for start, end in zip(bounds, bounds[1:], strict=False):
            places = list({classes[x]: x for x in range(start, end)}.values())
            if len(places) < 2:
                continue
            sets = [np.frombuffer(texts[x], np.uint64) for x in places]
            both = shared(sets) if len(sets) > 2 else None
            if both is None:
                common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                both = np.array([[len(sets[0]), common], [common, len(sets[1])]], float)
            sizes = np.array([len(s) for s in sets], float)
            near = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
            np.fill_diagonal(near, False)
            block = np.array([own[x] for x in places])
            if blocks[start][1] != blocks[start][2]:  # pairs inside a block are counted where the block meets itself
                near &= block[:, None] != block[None, :]
            counts = near @ np.array([copies[x] for x in places], np.int64)
            for x, c in zip(places, counts.tolist(), strict=True):
                if c:
                    out["a"].append(classes[x]), out["b"].append(None), out["links"].append(c)
            for x, y in forest(near):
                out["a"].append(classes[places[x]]), out["b"].append(classes[places[y]]), out["links"].append(0)
        yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.binary()), pa.array(out["b"], pa.binary()), pa.array(out["links"], pa.int64())], list(out))


def blocks(df: DataFrame, key: str, size: str, member: str, most: int = BLOCK) -> DataFrame:
    """Deal the members of each key over blocks (by a hash) and repeat each for every pair of blocks it is in: block, i, j."""
    count = F.ceil(F.col(size) / most).cast("int")
    df = df.withColumn("_blocks", count).withColumn("block", F.pmod(F.xxhash64(member, key), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return df.withColumn("_other", other).withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other")).drop("_other", "_blocks")


def join(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id_col, k1, k2 (row key), class_id, n_links, kept for every row of `df`.

    n_links: other rows with a similarity of `threshold` or more, equal texts
    included. class_id: the smallest id that links lead to, the row's own
    included. kept: one row of each class, the smallest by id and key (rows that
    are the same in id and text are kept or not together).

    Null and empty texts, and texts without a word, have no grams: no links, a
    class of their own. A text of fewer than GRAM words is one gram. Null ids
    come after all others. Other columns are not read.
    """
    docs = keyed(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()
    rows = save(arrow_map(docs, _signed, f"id {id_type}, k1 bigint, k2 bigint, class binary, sign binary"), "signs")
    classes = rows.where("class is not null").groupBy("class").agg(
        F.count(F.lit(1)).alias("copies"), F.min("k2").alias("k2"), F.min_by("k1", "k2").alias("k1"), F.first("sign").alias("sign")
    )
    classes = save(classes, "classes")
    depth = prefix_depth(audit(classes, threshold), threshold, recall)
    trees = classes.select("class", F.explode(prefixes(depth)).alias("bucket"))
    busy = trees.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = blocks(trees.join(busy, "bucket").join(classes.select("class", "sign"), "class"), "bucket", "size", "class")
    dealt = members.select("bucket", "i", "j", "class", "sign").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "sign", "class")
    likely = stream_map(dealt, lambda b: folded(_meet(b, threshold - SLACK)), "a binary, b binary")
    groups = components(likely, "likely").select(F.col("node").alias("class"), F.col("root").alias("group"))
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    wanted = groups.join(sizes, "group").join(classes.select("class", "copies", "k1", "k2"), "class")
    texts = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("class", "group", "size", "copies", "text")

    def found(batch):
        sets = [grams(t).tobytes() for t in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(sets, pa.binary())], ["class", "group", "size", "copies", "grams"])

    sets = arrow_map(texts, found, "class binary, group binary, size bigint, copies bigint, grams binary")
    dealt = blocks(sets, "group", "size", "class").drop("size").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "class")
    linked = save(stream_map(dealt, lambda b: _verify(b, threshold), "a binary, b binary, links bigint"), "links")
    together = components(linked.where("b is not null").select("a", "b"), "classes-linked").select(F.col("node").alias("class"), "root")
    links = linked.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    per_class = (
        classes.select("class", "copies").join(links, "class", "left").join(together, "class", "left")
        .select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root"))
    )
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("k1").alias("k1"), F.col("k2").alias("k2"))
    known = rows.where("class is not null").select("id", "k1", "k2", "class").join(save(per_class, "per-class"), "class")
    first = save(known.groupBy("root").agg(F.min(order).alias("first")), "first")  # written down so that its join can split a hot group
    named = known.join(first, "root").select("id", "k1", "k2", F.col("first.id").alias("class_id"), "n_links", (F.struct("k1", "k2") == F.struct("first.k1", "first.k2")).alias("kept"))
    alone = rows.where("class is null").select("id", "k1", "k2", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept"))
    return named.unionByName(alone).withColumnRenamed("id", id_col)
