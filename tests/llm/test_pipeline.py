"""The stages one by one and in a row, over documents with all the odd cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "/root/testdata/sf0.001/documents.parquet"
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(DOCS)
    rng = random.Random(1)
    prose = " ".join(rng.choice("alpha beta gamma delta mail word line".split()) for _ in range(80))
    odd = [(None, ""), (None, None), (None, None), (0, ""), (0, ""), (5001, None), (5002, "?!"), (5002, "?!"), (5003, prose), (5003, prose), (None, prose), (5004, f"{prose} a.b@example.com")]
    rows = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("odd").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    both = given.unionByName(rows)
    # columns that stages use themselves
    return both.select("*", *[F.lit(1).alias(c) for c in ("_pieces", "_finds", "_kinds", "_k1", "k1", "k2", "row", "has_word", "hits", "score")]).repartition(4)


@pytest.fixture(scope="module")
def rows(docs):
    return Counter((r["doc_id"], r["text"]) for r in docs.collect())


def test_quality_takes_equal_texts_alike(spark, docs, rows):
    kept = corpus_pipeline.quality(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    found = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    texts = {t for _, t in found}
    assert found == Counter({k: n for k, n in rows.items() if k[1] in texts}) and 0 < len(found) < len(rows)


def test_near_duplicates_keep_every_wordless_row(spark, docs, rows):
    kept = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    found = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    for row in [(None, ""), (None, None), (0, ""), (5001, None), (5002, "?!")]:
        assert found[row] == rows[row], row
    spoken = [t for (_, t), n in found.items() for _ in range(n) if t and any(c.isalnum() for c in t)]
    assert len(spoken) == len(set(spoken)) and set(found) <= set(rows)
    assert sum(n for (_, t), n in found.items() if t and t.startswith(next(t for i, t in rows if i == 5003))) == 1


def test_repeated_passages_and_personal_data_keep_all_rows(spark, docs, rows):
    for stage in (corpus_pipeline.repeated_passages, corpus_pipeline.personal_data):
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        listed = out.collect()
        assert Counter(r["doc_id"] for r in listed) == Counter(i for (i, _), n in rows.items() for _ in range(n))
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in listed)
        if stage is corpus_pipeline.repeated_passages:
            assert all(r["text"] == "" for r in listed if r["doc_id"] == 5003)
        else:
            assert [r["text"][-12:] for r in listed if r["doc_id"] == 5004] == ["@example.com"]
            assert not any("a.b@example.com" in (r["text"] or "") for r in listed)


def test_packing_has_every_document(spark, docs, rows):
    pieces = corpus_pipeline.packing(spark, docs, SF_DIR).collect()
    assert {p["doc_id"] for p in pieces} == {i for i, _ in rows}
    assert sum(p["length"] for p in pieces if p["start"] + p["length"] == p["doc_tokens"]) > 0
    assert sum(1 for p in pieces if p["start"] == 0) == sum(rows.values())


def test_empty_tables_stay_empty(spark, docs):
    none = docs.where("false")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages, corpus_pipeline.personal_data, corpus_pipeline.packing):
        assert stage(spark, none, SF_DIR).count() == 0


def test_run_feeds_each_stage_the_one_before(spark):
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    given = {r["doc_id"] for r in spark.read.parquet(DOCS).collect()}
    found = {p["doc_id"] for p in pieces}
    assert 0 < len(found) < len(given) and found <= given
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)
