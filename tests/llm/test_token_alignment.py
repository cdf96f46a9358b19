"""Alignment against a plain merge of the two tokenizers' own outputs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from offerwatch.llm import token_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    texts = [None, "", " ", "\n", "a", "  two  spaces ", "<|endoftext|> <s> </s> <0x41>", "▁ under", "漢字 🙂 Ünïcode ﬁ", "x\u0000y", "a" * 9000, "1234567 89.5", "\r\n\ttabs"]
    texts += [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 40, 40, 400, 5000)]
    return [*texts, texts[14], texts[14]]


def plain(rows):
    a_model, b_model = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    letters = token_alignment.byte_of_letter()
    a_bytes = lambda i: bytes([letters[c] for c in a_model.id_to_token(i)])

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    lines = []
    for doc, text in rows:
        a, b = (a_model.encode(f" {text}", add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        whole = f" {text}".encode()
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        groups, links, i, j, left, right = [], [], 0, 0, [], []
        at_a = at_b = 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                left.append(a[i])
                at_a += len(a_bytes(a[i]))
                i += 1
            else:
                right.append(b[j])
                at_b += len(b_bytes(b[j]))
                j += 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
                links.append((left[-1], right[-1]))
                left, right = [], []
        lines.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(link for line in lines for link in line[4])
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return Counter((*line[:4], len(line[4]), sum(counts[x] == highest[x[1]] for x in line[4]), sum(counts[x] for x in line[4]), line[5]) for line in lines)


def test_alignment_equals_a_plain_merge(spark):
    rows = [*enumerate(odd_texts()), (None, "text without an id"), (None, None), (5, "  two  spaces ")]
    wanted = plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("id", "row", "pair", "links", "n", "count")]).repartition(3)
    for piece, pattern in ((3, None), (64, public_tokenizers.PATTERN), (4096, public_tokenizers.PATTERN)):
        got = token_alignment.align(docs, "doc_id", "text", A_PATH, B_PATH, pattern, piece)
        assert got.columns == NAMES
        assert Counter(map(tuple, got.collect())) == wanted, piece
    assert token_alignment.align(docs.where("false"), "doc_id", "text", A_PATH, B_PATH).count() == 0


def test_letters_are_those_of_the_library():
    level, letters = ByteLevel(add_prefix_space=False, use_regex=False), token_alignment.byte_of_letter()
    assert len(letters) == 256 and set(letters) == set(ByteLevel.alphabet())
    for text in ("a é\n", "漢🙂\u0000\u00ad", "".join(map(chr, range(0x100)))):
        assert bytes([letters[c] for c in level.pre_tokenize_str(text)[0][0]]) == text.encode()


@pytest.mark.parametrize("piece", [1, 2, 7, 100])
def test_pieces_of_a_merge(piece):
    rng = np.random.default_rng(piece)
    for size in (0, 1, 5, 60, 300):
        a, b = (np.sort(rng.choice(400, min(400, size + extra), replace=False)).astype(np.int64) for extra in (0, 3))
        i, j = token_alignment.diagonals(a, b, piece)
        assert (i + j).tolist() == [*range(0, len(a) + len(b), piece), len(a) + len(b)]
        merged = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
        assert i.tolist() == [sum(side == 0 for _, side in merged[: n + m]) for n, m in zip(i.tolist(), j.tolist(), strict=True)]
        assert a[token_alignment.common_ends(a, b, piece)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_pairs_are_bounded_by_the_vocabularies():
    own = token_alignment.Both(A_PATH, B_PATH)
    assert token_alignment.possible_pairs(A_PATH, B_PATH) < token_alignment.BROADCAST_PAIRS
    laid = token_alignment.Aligned(own, *own.tokens(odd_texts()))
    for x, y in zip(laid.a[laid.a_last], laid.b[laid.b_last], strict=True):
        short, long = sorted((own.a.bytes[x], own.b.bytes[y]), key=len)
        assert long.endswith(short)


def test_ranks_give_the_ids_of_the_library():
    library, ranked = token_alignment.ByteLevel(A_PATH), token_alignment.ByteLevel(A_PATH, public_tokenizers.PATTERN)
    assert ranked.ranked is not None and library.ranked is None and library.bytes == ranked.bytes
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for c in [*points[:0x3000], *points[0x3000::97]]:
        text = f" a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}b {chr(c)}"
        assert library.ids(text) == ranked.ids(text), hex(c)
    for text in odd_texts():
        assert library.ids(f" {text}") == ranked.ids(f" {text}")
