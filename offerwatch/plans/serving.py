"""The listings as readers ask for them: sorted once, read in pages, searched by postings.

Rows are range-partitioned by the default order and sorted within, one folder
per range. A table of the ranges' end values says where a page starts, so a page
opens the folders that hold it and sorts nothing else. Postings lead from three
letters to the rows that hold them and to the folders these rows are in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of a posting, and how many of a needle's postings are intersected.
GRAM, RAREST = 3, 3
BUCKETS = 64
#: Fills the end of a text up to a whole posting, so that its last letters start one as well.
FILL = "\0" * (GRAM - 1)


class Serving:
    """A sorted copy of `mart` under `path`.

    `order` names the columns of the default order, whose last ones make it
    total. Null sorts as the smallest value.
    """

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str], key: str = "listing_key"):
        self.spark, self.path, self.order, self.key = spark, path.rstrip("/"), list(order), key

    # ------------------------------------------------------------------ writing

    def write(self, mart: DataFrame, text_columns: Sequence[str] = ("title", "city_part", "locality"), ranges: int | None = None) -> None:
        """Write the rows in order, then the ends of each range, then the postings of the text columns.

        Without `ranges` Spark chooses their number by the size of the data.
        """
        mart.limit(0).write.parquet(f"{self.path}/columns")  # what an empty table has all the same
        order = [F.col(c).asc_nulls_first() for c in self.order]
        ranged = (mart.repartitionByRange(ranges, *order) if ranges else mart.repartitionByRange(*order)).withColumn("part", F.spark_partition_id())
        ranged.sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{self.path}/rows")
        place = F.struct(*self.order)
        ends = self.rows().groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("rows"))
        ends.coalesce(1).sortWithinPartitions("part").write.parquet(f"{self.path}/ends")

        grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col(c)) for c in text_columns])))
        posted = self.rows().select("part", self.key, F.explode(grams).alias("gram"))
        posted = posted.withColumn("bucket", _bucket(F.col("gram")))
        # a gram of many rows is spread over files by its key; rebalancing splits what is still too large
        posted.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        counts = self._postings().groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("rows"))
        counts.coalesce(BUCKETS).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.path}/gram_counts")

    # ------------------------------------------------------------------ reading

    def rows(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(columns.add("part", T.IntegerType())).parquet(f"{self.path}/rows")

    def _postings(self) -> DataFrame:
        kind = self.rows().schema[self.key].dataType
        schema = T.StructType().add("part", T.IntegerType()).add(self.key, kind).add("gram", T.StringType()).add("bucket", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings")

    def _gram_counts(self) -> DataFrame:
        return self.spark.read.schema("gram string, rows bigint, bucket int").parquet(f"{self.path}/gram_counts")

    def page(self, size: int, after: Row | None = None, descending: bool = False, where: Column | None = None) -> DataFrame:
        """The next `size` rows of the order behind the row `after` (the first ones without it), those of `where` only.

        `after` needs the columns of the order. Ranges are opened from the place
        of `after` on, as many as their row counts say; if a filter leaves too
        few of their rows, twice as many are opened, until the page is full or
        nothing is left.
        """
        schema = self.rows().schema
        place = F.struct(*self.order)
        rest, ends = F.lit(True), self.spark.read.parquet(f"{self.path}/ends")
        if after is not None:
            last_seen = F.struct(*[F.lit(after[c]).cast(schema[c].dataType).alias(c) for c in self.order])
            rest = place < last_seen if descending else place > last_seen
            ends = ends.where(F.col("first") < last_seen if descending else F.col("last") > last_seen)
        towards = F.desc if descending else F.asc
        order = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in self.order]

        # no range is empty, so so many hold a page even if the first one holds a single row of it
        wanted, opened = size + 1, None
        while True:
            ahead = ends.orderBy(towards("part")).limit(wanted).select("part", "rows").collect()
            opened = self._enough([r["rows"] for r in ahead], size) if opened is None else wanted
            parts = [r["part"] for r in ahead[:opened]]
            found = self.rows().where(F.col("part").between(min(parts, default=0), max(parts, default=-1)) & rest)
            page = (found if where is None else found.where(where)).drop("part").orderBy(*order).limit(size)
            at_the_end = len(ahead) < wanted and len(ahead) <= opened
            if where is None or at_the_end or page.count() == size:
                return page
            wanted = 2 * opened

    @staticmethod
    def _enough(rows: list[int], size: int) -> int:
        """How many ranges hold a page, if nothing is left of the first but one row."""
        held = 1
        for n, count in enumerate(rows[1:], 1):
            if held >= size:
                return n
            held += count
        return len(rows)

    def search(self, needle: str, text_columns: Sequence[str] = ("title", "city_part", "locality")) -> DataFrame:
        """Rows with `needle` in one of the text columns, whatever the case; an empty needle finds all.

        The rarest postings of the needle are intersected; the rows they leave
        are looked up in their folders and checked. A needle shorter than a
        posting is the start of all postings that are looked at.
        """
        needle = needle.lower()
        if not needle:
            return self.rows().drop("part")
        if len(needle) < GRAM:
            candidates = self._postings().where(F.col("gram").startswith(needle)).select("part", self.key).distinct()
        else:
            grams = self.rarest(needle)
            posted = self._postings().where(F.col("bucket").isin(_buckets(self.spark, grams)) & F.col("gram").isin(grams))
            held = posted.groupBy("part", self.key).agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") == len(grams))
            candidates = held.drop("_held")
        hit = F.lit(False)
        for column in text_columns:
            hit = hit | F.coalesce(F.lower(column).contains(needle), F.lit(False))
        return self.rows().join(candidates, ["part", self.key], "left_semi").where(hit).drop("part")

    def rarest(self, needle: str) -> list[str]:
        """The postings of a needle that fewest rows hold; those that none holds are left out."""
        grams = _pieces(needle.lower())
        counts = self._gram_counts().where(F.col("bucket").isin(_buckets(self.spark, grams)) & F.col("gram").isin(grams))
        return [r["gram"] for r in counts.orderBy("rows", "gram").limit(RAREST).collect()]


def _grams(text: Column) -> Column:
    """All postings of a text, one per letter; none of a null."""
    lower = F.lower(text)
    filled = F.concat(lower, F.lit(FILL))
    each = F.transform(F.sequence(F.lit(1), F.length(lower)), lambda i: F.substring(filled, i, F.lit(GRAM)))
    return F.when(F.length(lower) > 0, each).otherwise(F.array().cast("array<string>"))


def _pieces(needle: str) -> list[str]:
    return sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _buckets(spark: SparkSession, grams: list[str]) -> list[int]:
    """The folders of these postings, as literals so that the others are pruned."""
    return sorted(set(spark.range(1).select(F.array(*[_bucket(F.lit(g)) for g in grams])).first()[0]))
