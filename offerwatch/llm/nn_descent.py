"""Near duplicates among embeddings by NN-descent.

Every vector keeps a list of its best neighbours so far. Lists start from
random hyperplanes: vectors of one label on the same side of several planes are
compared. Then each vector's neighbours, and those that have it as theirs, are
compared with each other, since neighbours of a neighbour are likely
neighbours, until a round brings no more links. An audit compares a sample of
vectors with all others; while its recall is too low, lists and planes are
doubled. What the links at the threshold connect is a component. A vector whose
whole list is links may have more than its list holds. Within a component all
pairs are compared, in blocks, so its list need not hold these: it is emptied
and filled with the best neighbours outside the component, which links among
them make larger, until no list is full of links.

Vectors of one label and one value are one node that counts as many times.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerwatch.llm.common import arrow_map, components, grouped, save, stream_map
from offerwatch.llm.ngram_join import blocks

THRESHOLD = 0.98
NEIGHBOURS = 8
PLANE_SETS = 6
CROWD = 128  # vectors meant to be on the same side of all planes of a set
BLOCK = 512  # vectors compared at once
AUDIT = 1000  # vectors of the audit, the bound of what is broadcast
RECALL = 0.95


@functools.lru_cache(maxsize=8)
def planes(dims: int, number: int, count: int) -> np.ndarray:
    return np.random.default_rng([dims, number]).normal(0, 1, (count, dims))


def matrix(vectors) -> np.ndarray:
    """Unit vectors of a binary column."""
    rows = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _valid(batch):
    """Per row: whether it can link, what it is compared within, and its class."""
    spaces, classes, data = [], [], []
    for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        raw = None
        if label is not None and vector and None not in vector:
            own = np.array(vector, np.float64)
            if np.isfinite(own).all():
                top = np.abs(own).max()
                if top > 0:
                    raw = (own / top if not 1e-100 < top < 1e100 else own).tobytes()
        spaces.append(None if raw is None else xxhash.xxh3_64_intdigest(f"{len(vector)} {label}") - (1 << 63))
        classes.append(None if raw is None else xxhash.xxh3_128_digest(raw + str(label).encode()))
        data.append(raw)
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spaces, pa.int64()), pa.array(classes, pa.binary()), pa.array(data, pa.binary())], ["id", "space", "class", "vector"])


def _numbered(batches):
    node = TaskContext.get().partitionId() << 33
    for batch in batches:
        numbers = np.arange(node, node + batch.num_rows)
        node += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(numbers), *batch.columns], ["node", *batch.schema.names])


def _sides(batch, first: int, sets: int):
    """For each set of planes, the side a vector is on: more planes where more vectors share its space."""
    out = {c: [] for c in ("bucket", "node", "root", "vector")}
    vectors = batch.column(3).to_pylist()
    sizes, spaces, nodes, roots = (batch.column(i).to_pylist() for i in (2, 1, 0, 4))
    for node, space, size, vector, root in zip(nodes, spaces, sizes, vectors, roots, strict=True):
        own = np.frombuffer(vector, np.float64)
        count = max(0, int(np.ceil(np.log2(max(1, size / CROWD)))))
        for number in range(first, first + sets):
            side = np.packbits(planes(len(own), number, 64)[:count] @ own > 0).tobytes()
            bucket = xxhash.xxh3_64_intdigest(side + space.to_bytes(8, "little", signed=True) + number.to_bytes(4, "little"))
            for c, v in zip(out, (bucket - (1 << 63), node, root, vector), strict=True):
                out[c].append(v)
    yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), pa.array(out["node"], pa.int64()), pa.array(out["root"], pa.int64()), pa.array(out["vector"], pa.binary())], list(out))


def _near(batches, most: int):
    """In each group, the `most` best members of other roots for each member, where better than the worst it already has."""
    for table in grouped(batches, ["bucket", "block"], 4096):
        bucket, block = (table.column(c).to_numpy() for c in ("bucket", "block"))
        change = np.zeros(len(bucket), bool)
        change[1:] = (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])
        bounds = [0, *np.flatnonzero(change).tolist(), len(bucket)]
        nodes = table.column("node").to_numpy()
        floor = table.column("floor").to_numpy()
        roots = table.column("root").to_numpy()
        vectors = table.column("vector").to_pylist()
        a, b, likeness = [], [], []
        for start, end in zip(bounds, bounds[1:], strict=False):
            if end - start < 2:
                continue
            _, single = np.unique(nodes[start:end], return_index=True)
            rows = matrix([vectors[start + x] for x in single])
            own, root = nodes[start:end][single], roots[start:end][single]
            for at in range(0, len(own), BLOCK):
                cos = rows[at : at + BLOCK] @ rows.T
                cos[root[at : at + BLOCK, None] == root[None]] = -2  # itself, and what it is known to be connected with
                k = min(most, len(own) - 1)
                if not k:
                    continue
                best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(cos, best, 1)
                x, y = np.nonzero(value > np.maximum(floor[start:end][single][at : at + BLOCK, None], -2))
                a.append(own[at + x]), b.append(own[best[x, y]]), likeness.append(value[x, y])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays([pa.array(join(a, np.int64)), pa.array(join(b, np.int64)), pa.array(join(likeness, np.float64))], ["a", "b", "cos"])


def compared(members: DataFrame, most: int) -> DataFrame:
    """`_near` over members (bucket, node, root, vector, floor); a crowded bucket is dealt over blocks at random."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("size") / BLOCK)).cast("int"))
    dealt = dealt.select("bucket", "block", "node", "root", "vector", "floor").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    return stream_map(dealt, lambda b: _near(b, most), "a bigint, b bigint, cos double")


def best(pairs: DataFrame, most: int) -> DataFrame:
    """The `most` best neighbours of each node."""
    single = pairs.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    return single.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def saturated(lists: DataFrame, threshold: float, most: int) -> DataFrame:
    """node: those whose lists are full and hold nothing but links."""
    return lists.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("worst")).where((F.col("n") >= most) & (F.col("worst") >= threshold)).select(F.col("a").alias("node"))


def refined(lists: DataFrame, nodes: DataFrame, most: int, near: DataFrame | None = None) -> DataFrame:
    """A round: neighbours of each node, either way, those in `near` as well, compared with each other; lists of the best of old and new."""
    worst = lists.groupBy("a").agg(F.when(F.count(F.lit(1)) >= most, F.min("cos")).otherwise(F.lit(-2.0)).alias("floor"))
    pairs = lists.select("a", "b") if near is None else lists.select("a", "b").unionByName(near)
    around = pairs.select(F.col("a").alias("bucket"), F.col("b").alias("node")).unionByName(pairs.select(F.col("b").alias("bucket"), F.col("a").alias("node"))).distinct()
    known = nodes.select("node", "root", "vector").join(worst.withColumnRenamed("a", "node"), "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    return best(lists.unionByName(compared(around.join(known, "node"), most)), most)


def graph(nodes: DataFrame, threshold: float, neighbours: int, first: int, sets: int, before: DataFrame | None, near: DataFrame | None = None) -> DataFrame:
    """Lists (a, b, cos) of the best neighbours of other roots, refined until a round brings no new link at the threshold."""
    members = arrow_map(nodes.select("node", "space", "size", "vector", "root"), lambda b: _sides(b, first, sets), "bucket bigint, node bigint, root bigint, vector binary")
    found = compared(members.withColumn("floor", F.lit(-2.0)), neighbours // 2 if near is None else neighbours)
    lists = save(best(found if before is None else found.unionByName(before), neighbours), "neighbours")
    links = lists.where(F.col("cos") >= threshold).count()
    while True:  # ends, since links only become more and there are so many at most
        lists = save(refined(lists, nodes, neighbours, near), "neighbours")
        now = lists.where(F.col("cos") >= threshold).count()
        if now <= links:
            return lists
        links = now


def connected(nodes: DataFrame, lists: DataFrame, threshold: float, neighbours: int, sets: int) -> DataFrame:
    """Components of the links: of those in `lists`, and of those that lists full of links had no place for.

    A link that was found is lost only if the lists of both ends are full of
    better ones. So the nodes of such lists look for neighbours outside their
    component, as often as that fills lists again; each time components merge.
    """
    links, last = lists.where(F.col("cos") >= threshold).select("a", "b"), lists
    while True:
        linked = save(components(links, "linked"), "roots")
        full = save(saturated(last, threshold, neighbours), "full")
        if full.isEmpty():
            return linked
        own = nodes.drop("root", "size").join(full, "node").join(linked, "node")
        own = save(own.join(own.groupBy("space").agg(F.count(F.lit(1)).alias("size")), "space"), "open")
        near = links.join(full.withColumnRenamed("node", "a"), "a", "left_semi").join(full.withColumnRenamed("node", "b"), "b", "left_semi")
        last = graph(own, threshold, neighbours, 0, sets, None, save(near.select("a", "b"), "near"))
        links = save(links.unionByName(last.where(F.col("cos") >= threshold).select("a", "b")), "links")


def audited(nodes: DataFrame, linked: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Recall: of the links of at most `queries` nodes, found by comparing them with all, the share of those whose ends are in one component.

    Half of the nodes are drawn from all and half from those that have a link, so links that are rare are looked at as well.
    """
    spark = nodes.sparkSession
    narrow = nodes.select("node", "space", "vector")
    drawn = [part.orderBy(F.xxhash64("node")).limit(queries // 2).collect() for part in (narrow, narrow.join(linked.select("node"), "node", "left_semi"))]
    asked = {row["node"]: row for part in drawn for row in part}.values()
    by_space: dict[tuple[int, int], list] = {}
    for row in asked:
        by_space.setdefault((row["space"], len(row["vector"])), []).append((row["node"], bytes(row["vector"])))
    tables = spark.sparkContext.broadcast({k: (np.array([n for n, _ in v]), matrix([x for _, x in v])) for k, v in by_space.items()})

    def against(batch):
        node, space, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        a, b = [], []
        places: dict[tuple[int, int], list[int]] = {}
        for place, key in enumerate(zip(space, map(len, vectors), strict=True)):
            places.setdefault(key, []).append(place)
        for key, own in places.items():
            if key in tables.value:
                names, rows = tables.value[key]
                x, y = np.nonzero(rows @ matrix([vectors[p] for p in own]).T >= threshold)
                a.append(names[x]), b.append(node[np.array(own)[y]])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(join(a)), pa.array(join(b))], ["a", "b"])

    true = arrow_map(nodes.select("node", "space", "vector"), against, "a bigint, b bigint").where("a != b")
    root = linked.select("node", "root")
    both = true.join(root.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), "a", "left").join(
        root.withColumnRenamed("node", "b").withColumnRenamed("root", "rb"), "b", "left"
    )
    found = both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("ra") == F.col("rb")).cast("int")), F.lit(0)).alias("hit")).first()
    return 1.0 if not found["n"] else found["hit"] / found["n"]


def _links(batches, threshold: float):
    """In each pair of blocks of a component, how many vectors each node links with."""
    for table in grouped(batches, ["root", "i", "j"], 1024):
        keys = [table.column(c).to_numpy() for c in ("root", "i", "j")]
        change = np.zeros(table.num_rows, bool)
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        nodes, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        vectors = table.column("vector").to_pylist()
        a, counts = [], []
        for start, end in zip(bounds, bounds[1:], strict=False):
            rows = matrix(vectors[start:end])
            near = rows @ rows.T >= threshold
            np.fill_diagonal(near, False)
            if keys[1][start] != keys[2][start]:  # pairs inside a block are counted where the block meets itself
                near &= block[start:end, None] != block[None, start:end]
            a.append(nodes[start:end]), counts.append(near @ copies[start:end])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(counts))], ["node", "links"])


def deduplicate(df: DataFrame, id_col: str, label_col: str, vector_col: str, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """id_col, n_links, component_id and kept for every row of `df`.

    Rows link if their labels are equal and not null and the cosine of their
    vectors, in double precision, is `threshold` or more. Vectors that are null,
    empty or zero or hold null or non-finite numbers link with nothing, nor do
    vectors of different lengths. n_links counts rows, equal vectors included;
    component_id is the smallest id that links lead to, the row's own included;
    kept: the id is the component's. Null ids come after all others; rows that
    come twice link with each other; an empty table gives none. Other columns
    are not read. An error is raised if the audit never finds the recall asked for.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = save(arrow_map(df.select(F.col(id_col).alias("id"), label_col, vector_col), _valid, f"id {id_type}, space bigint, class binary, vector binary"), "vectors")
    classes = rows.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.first("space").alias("space"), F.first("vector").alias("vector"))
    sizes = classes.groupBy("space").agg(F.count(F.lit(1)).alias("size"))
    joined = classes.join(sizes, "space").select("class", "copies", "space", "size", "vector")
    nodes = save(stream_map(joined, _numbered, "node bigint, class binary, copies bigint, space bigint, size bigint, vector binary"), "nodes").withColumn("root", F.col("node"))
    lists, done, sets = None, 0, PLANE_SETS
    largest = sizes.agg(F.max("size")).first()[0] or 0
    while True:
        lists = graph(nodes, threshold, neighbours, done, sets, lists)
        linked = connected(nodes, lists, threshold, neighbours, done + sets)
        if (share := audited(nodes, linked, threshold)) >= recall:
            break
        if neighbours >= largest:  # lists as long as that leave nothing out, so something else is wrong; no result is better than this one
            raise RuntimeError(f"links found: {share:.3f} of those of the audit, wanted {recall}")
        done, sets, neighbours = done + sets, 2 * sets, 2 * neighbours
    crowd = linked.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = linked.join(crowd, "root").join(nodes.select("node", "copies", "vector"), "node")
    dealt = blocks(members, "root", "size", "node", BLOCK).select("root", "i", "j", "block", "node", "copies", "vector")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    links = stream_map(dealt, lambda b: _links(b, threshold), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    per_class = (
        nodes.select("node", "class", "copies").join(links, "node", "left").join(linked, "node", "left")
        .select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    known = rows.where("class is not null").select("id", "class").join(save(per_class, "per-class"), "class")
    first = save(known.groupBy("root").agg(F.min("id").alias("component_id")), "first")  # written down so that its join can split a hot group
    named = known.join(first, "root").select("id", "n_links", "component_id")
    alone = rows.where("class is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return named.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
