"""From documents to packed sequences: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's docs. A stage deletes the working
tables of the one before it, whose result is written by then.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwatch.llm import byte_cnn, curve_packing, feistel_pii, ngram_join, substring_dedup
from offerwatch.llm.catalog import ACCEPTED, PII_KEY
from offerwatch.llm.common import drop_saved, saved
from offerwatch.session import work_dir

#: No SQL can state a learned score or hashed tokens; tests hold the operator of each stage against brute force.
ORACLE_SQL = None

_before: list[str] = []


def stage(function):
    """Delete what the stage before left, and remember what this one makes."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_saved(spark, _before)
        known = set(saved())
        out = function(spark, docs, sf_dir)
        _before[:] = [path for path in saved() if path not in known]
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null and empty texts are scored as texts of no bytes; rows equal in their
    text are accepted or not together, and a row that comes twice stays twice;
    an empty table stays empty; all columns are carried along.
    """
    net = byte_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", "quality")
    return byte_cnn.accepted(docs, "text", net, ACCEPTED)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows equal in id and text are one group, of which one stays; a null id
    comes after all others. Null and empty texts, and texts without a word, are
    near to nothing, so all such rows stay. An empty table stays empty; all
    columns are carried along.
    """
    kept = ngram_join.join(docs, "doc_id", "text").where("kept").select("k1", "k2")
    has_word = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))
    rows = docs.select(F.struct(*docs.columns).alias("row"), has_word.alias("has_word"), *substring_dedup.key_of(docs, "doc_id", "text"))
    one = rows.where("has_word").join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return one.unionByName(rows.where("NOT has_word")).select("row.*")


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that stand anywhere else.

    Null texts stay null, texts without such passages as they are; rows that
    come twice lose all their long passages, in both; an empty table stays
    empty; all columns are carried along.
    """
    return counted(substring_dedup.rewrite(docs, "doc_id", "text"))


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms.

    Null and empty texts stay as they are, every row stays, repeated or not; an
    empty table stays empty; all columns are carried along.
    """
    return counted(feistel_pii.rewritten(docs, "text", PII_KEY))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences.

    Null and empty texts are the closing id alone; repeated rows are documents
    of their own; an empty table has no pieces; other columns are not read.
    """
    return curve_packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), digest=True)


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        path = work_dir(spark, f"pipeline-{name}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
