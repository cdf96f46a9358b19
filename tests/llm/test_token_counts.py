"""Token counts against the libraries on whole texts."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offerwatch.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(5)
    letters = "abcde fghi  \n\t0123456789.,▁éß漢字🙂\u0000-_"
    texts = [None, "", " ", "  two  spaces ", "<s> </s> <unk> <0x41>", "▁▁ x", "a" * 5000, "漢" * 3000, " " * 4000, "é" * 50, "ﬁ ² Ａ", "﻿x\r\n"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    texts += [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(3000))]
    return [*texts, texts[6], texts[6]]


@pytest.fixture(scope="module")
def model():
    return token_counts.Pieces(MODEL)


def test_parts_add_up_to_the_whole_text(model):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in odd_texts():
        whole = len(library.encode(text or ""))
        for chars in (1, 3, 17, 256, 1 << 16):
            parts = list(model.parts(text or "", chars))
            assert "".join(p for _, p in parts) == (text or "")
            assert sum(model.lengths(parts)) == whole, (text, chars)
    long = "word and word " * 2000
    assert max(len(p) for _, p in model.parts(long, 100)) < 130


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_equal_the_library(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        own = Tokenizer.from_file(path)
        library = lambda t: own.encode(t, add_special_tokens=False).ids
    rows = [*enumerate(odd_texts()), (None, "text without an id"), (None, None), (3, "  two  spaces "), (3, "  two  spaces ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("id", "n_bytes", "n_tokens", "over_limit")])
    got = token_counts.counts(docs.repartition(3), "doc_id", "text", path, limit=100, batch_bytes=2000, part_chars=64)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    wanted = Counter((i, len((t or "").encode()), len(library(t or "")), len(library(t or "")) > 100) for i, t in rows)
    assert Counter(map(tuple, got.collect())) == wanted
    assert token_counts.counts(docs.where("false"), "doc_id", "text", path).count() == 0
