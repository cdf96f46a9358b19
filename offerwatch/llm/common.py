"""What the operators share: working tables, row keys, Arrow mapping, connected components."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwatch.session import work_dir

_tables: list[str] = []


@functools.cache
def _archive() -> str:
    """The package's sources as one file."""
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="offerwatch-src-"), "offerwatch.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    return path


_tools: dict = {}
_asked: list = []


def tool(key, make: Callable):
    """What a worker keeps from task to task. It keeps one tool at a time, so that the memos of an earlier operator are let go."""
    _asked[:] = [key]
    if key not in _tools:
        _tools.clear()
        _tools[key] = make()
    return _tools[key]


#: Words a worker remembers the hashes of before it forgets them all.
MEMO = 200_000


class Hashes(dict):
    """Words and their 64-bit hashes, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def hashed(words: list[bytes]):
    return np.fromiter(map(tool("hashes", Hashes).__getitem__, words), np.uint64, len(words))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors the package, once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        spark.sparkContext.addPyFile(_archive())


#: Bytes of a record batch that are worked on at once.
SLICE = 1 << 22


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `SLICE` bytes, one row at least."""
    rows = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def let_go(asked: bool) -> None:
    """Give back what a worker holds and does not need for its next task; its tool too, if the last one did without."""
    if not asked:
        _tools.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`function` over a partition. Workers stay for later tasks, and several of them share an executor's memory, so
    each one lets go at the end of a task."""

    def over(batches):
        _asked.clear()
        try:
            yield from function(batches)
        finally:
            let_go(bool(_asked))

    return over


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`function` over runs of rows of each record batch of `df`."""
    ship(df.sparkSession)

    def over(batches):
        for batch in batches:
            for some in slices(batch):
                yield from function(some)

    return df.mapInArrow(lean(over), schema)


def stream_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`function` over the batches of a partition, in their order."""
    ship(df.sparkSession)
    return df.mapInArrow(lean(function), schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where `df` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared working folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved() -> list[str]:
    """Working tables that have not been deleted, in the order they were made."""
    return list(_tables)


def drop_saved(spark: SparkSession, paths: list[str]) -> None:
    """Delete working tables. To be called when nothing that reads them is still to run."""
    for path in paths:
        if path in _tables:
            _tables.remove(path)
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1) -> Iterator[pa.Table]:
    """Cut a partition sorted by `keys` into tables of whole groups, each of at least `rows` rows but the last."""
    kept: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        kept.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(kept)
        last = np.zeros(table.num_rows, bool)
        for key in keys:
            values = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
            last[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(last)
        if len(starts):
            yield table.slice(0, starts[-1])
            table = table.slice(starts[-1])
        kept, count = table.to_batches(), table.num_rows
    if count:
        yield pa.Table.from_batches(kept)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the links (a, b): one row (node, root), root the smallest node.

    Each round hangs a node's other neighbours below its smallest one, and joins
    every link to the smallest neighbour of the node it leads to, so that paths
    halve. No link becomes two, and none is sent both ways. Minima are folded
    before they are shuffled, so a node with any number of links costs one row
    per task; equal links are folded before they meet at the node they lead to.
    A round's links are written down before the next.
    """
    spark = edges.sparkSession
    links = save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == before or now["n"] == 0:
            break
        before = now
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        hung = links.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        above = least.select(F.col("a").alias("b"), F.col("m").alias("above"))
        made = saved()[-1]
        links = save(hung.distinct().join(above, "b", "left").select("a", F.coalesce("above", "b").alias("b")).distinct(), name)
        drop_saved(spark, [made])
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
