"""Every operator against a plain version of its rule, over texts with all the odd cases."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offerwatch.llm import (
    bpe_codec,
    byte_cnn,
    common,
    curve_packing,
    feistel_pii,
    fm_index,
    hilbert_shards,
    license_scan,
    ngram_join,
    nn_descent,
    substring_dedup,
    weighted_sampling,
)

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def make_texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéfg") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(60)
    near = base.split()
    texts = [base, base, " ".join([*near[:50], "edit", *near[51:]]), " ".join([*near[:20], "another", *near[21:]])]
    texts += [f"{prose(30)} {passage} {prose(20)}" for _ in range(4)]
    texts += [None, "", "", " \n\t", "one", "one", "one two", "Ünïcode 漢字 🙂 <|endoftext|>", "a" * 30000, prose(9000)]
    texts += ["released Under the MIT license", "under the mit licence and Apache License, Version 2.0, apache license version 2"]
    texts += ["card 4316522678525456 +1 (743) 555-3824 a.b@mail.example.com 227.5.221.1 2024-02-29", "again 4316522678525456"]
    texts += [prose(rng.randint(1, 80)) for _ in range(20)]
    return texts


@pytest.fixture(scope="module")
def rows():
    listed = list(enumerate(make_texts()))
    return [*listed, listed[0], listed[8], (None, "text without an id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # columns whose names the operators use themselves
    return frame.select("*", *[F.lit(1).alias(c) for c in ("id", "key", "row", "n", "shard", "k1", "class", "start", "side", "_salt")])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def collected(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_equals_the_library(docs, rows, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    arguments = ("doc_id", "text", RANKS, public_tokenizers.PATTERN)
    wanted = Counter()
    for id_, text in rows:
        ids = library.encode_ordinary(text or "")
        wanted[id_, len(ids), sha(" ".join(map(str, ids))), sha(text or "")] += 1
    assert collected(bpe_codec.digests(docs, *arguments), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted
    encoded = bpe_codec.encode(docs, *arguments)
    back = bpe_codec.decode(encoded, "doc_id", "ids", RANKS, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    assert bpe_codec.digests(empty, *arguments).count() == 0


def test_pieces_walk_only_the_longest_matches(monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    own, seen = bpe_codec.Codec(RANKS, r"(?s).+"), [0]

    class Counted:
        def __init__(self, automaton):
            self.automaton = automaton

        def __getattr__(self, name):
            def walk(*arguments):
                for found in getattr(self.automaton, name)(*arguments):
                    seen[0] += 1
                    yield found

            return walk

    own.automaton = Counted(own.automaton)
    monkeypatch.setattr(bpe_codec, "MEMO", 50)
    rng, size = random.Random(9), 0
    bits = ["the", "ing", " an", "tion", "ha", "e", "ou", "é", "漢", "7", "\n", "  ", "zq", "_", "\x00"]
    for n in range(3000):
        text = "".join(rng.choice(bits) for _ in range(n % 20 + 1))
        size += len(text.encode())
        assert own.encode(text) == own.encode(text) == library.encode_ordinary(text), text
        assert own.decode(own.encode(text)) == text.encode()
    assert own.encode("") == []
    assert seen[0] < size


def test_unknown_pieces_are_walked_together(monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, begun = bpe_codec.Codec(RANKS, public_tokenizers.PATTERN), [0]

    class Counted:
        def __init__(self, automaton):
            self.automaton = automaton

        def iter_long(self, *arguments):
            begun[0] += 1
            return self.automaton.iter_long(*arguments)

    own.automaton = Counted(own.automaton)
    rng = random.Random(11)
    bits = ["the", "ing", "an", "tion", "ha", "e", "ou", "é", "ción", "漢", "zuß", "re", "ent", "q", "of", "ly", "1", "77", "%%", "!"]
    texts = [" ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(1500)) for _ in range(6)]
    texts += ["", " " * 300 + "a" * 500, "漢" * 70, texts[0], "\x00\U0010ffff \r\n\t ' 's"]
    different = {m for t in texts for m in own.pattern.findall(t)}
    for text in texts:
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()
    assert begun[0] < len(different) / 4
    for memo, run, few in ((300, 100, 0), (10**6, 7, 0), (0, 1000, 3)):  # forgetting, many walks, none left to `piece`
        monkeypatch.setattr(bpe_codec, "MEMO", memo)
        monkeypatch.setattr(bpe_codec, "RUN", run)
        monkeypatch.setattr(bpe_codec, "FEW", few)
        own = bpe_codec.Codec(RANKS, public_tokenizers.PATTERN)
        for text in texts:
            assert own.encode(text) == library.encode_ordinary(text)
        assert [(ids.split(), back) for ids, back in own.parts(texts)] == [
            ([b"%d" % i for i in library.encode_ordinary(t)], t.encode()) for t in texts
        ]


def test_packing_places_every_token_once(docs, rows, empty):
    own = Tokenizer.from_file(WORDS)
    assert any(t and "<|endoftext|>" in t for _, t in rows)  # an added token in a text gets its own id
    ids = {(i, t): own.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    pieces = curve_packing.pack(docs, "doc_id", "text", WORDS, length=512).collect()
    by_place = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    laid = [p["sequence_id"] * 512 + p["offset"] for p in by_place]
    assert laid == np.cumsum([0, *[p["length"] for p in by_place]])[:-1].tolist()
    assert sum(p["length"] for p in pieces) == sum(len(ids[r]) for r in rows)
    assert all(p["length"] == len(p["ids"]) and p["offset"] + p["length"] <= 512 for p in pieces)
    whole, lists = defaultdict(list), []
    for piece in by_place:  # neighbours along the sequences are the pieces of one document
        whole[piece["doc_id"]].append(piece)
    for id_, text in rows:
        if id_ is not None and [i for i, _ in rows].count(id_) == 1:
            lists = [x for p in sorted(whole[id_], key=lambda p: p["start"]) for x in p["ids"]]
            assert lists == ids[id_, text] and whole[id_][0]["doc_tokens"] == len(lists)
    sums = collected(curve_packing.pack(docs, "doc_id", "text", WORDS, length=512, digest=True), "doc_id", "start", "ids_crc32")
    assert sums == Counter((p["doc_id"], p["start"], zlib.crc32(np.array(p["ids"], "<u4").tobytes())) for p in pieces)
    assert curve_packing.pack(empty, "doc_id", "text", WORDS).count() == 0


def test_stretches_have_the_ids_of_whole_texts():
    own, words, rng = Tokenizer.from_file(WORDS), curve_packing.Words(WORDS), random.Random(8)
    bits = ["a", "B's", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "\n", "\t", "é", "漢", "12", "!?", "\u00a0", "'ll"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert words.ids(text).tolist() == own.encode(text, add_special_tokens=False).ids, text


def test_words_of_many_texts_are_looked_up_together(monkeypatch):
    monkeypatch.setattr(curve_packing, "MEMO", 8)
    own, words, asked = Tokenizer.from_file(WORDS), curve_packing.Words(WORDS), []
    part = words.parts.ids
    words.parts.ids = lambda p: asked.append(p) or part(p)
    texts = ["Often, rare%s often été's 漢 <|endoftext|>\n" % chr(97 + i) for i in range(20)] + [None, ""]
    got = words.of_texts(pa.array(texts))
    assert [g.tolist() for g in got] == [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked))  # each part once, though only eight are remembered


def test_batches_are_worked_on_in_runs_of_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "SLICE", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 40] * 9 + ["y" * 900])], ["t"])
    runs = list(common.slices(batch))
    assert len(runs) == 10 and pa.Table.from_batches(runs).combine_chunks().to_batches()[0].equals(batch)
    assert list(common.slices(batch.slice(0, 0))) == []
    common.tool("kept", dict)
    list(common.lean(lambda batches: (common.tool("kept", dict) and b or b for b in batches))([batch]))
    assert "kept" in common._tools
    list(common.lean(iter)([batch]))  # a task without a tool lets it go
    assert not common._tools


def test_pseudonyms_in_very_long_words(spark):
    long = ["a1" * 500_000, "9" * 1_000_000, "a@" * 300_000, "x." * 300_000 + "a1@b.example.com " + "y" * 63 + "1@b.example.com", "1-" * 300_000, "+1 " * 200_000, "@" + "a." * 300_000]
    frame = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(7)
    before = time.time()
    got = {r["doc_id"]: r for r in feistel_pii.pseudonymise(frame, "doc_id", "text", "k").collect()}
    assert time.time() - before < 60  # linear: a form that read on from every character took hours
    assert [i for i in range(7) if got[i]["text"] != long[i]] == [3]
    assert got[3]["n_email"] == 1 and got[3]["text"].endswith("@b.example.com") and len(got[3]["text"]) == len(long[3])
    assert got[3]["text"][:600_016] == long[3][:600_016]  # more than 64 characters before the sign are no mail


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("released under the bsd license", set()), ("released under the mpl license", set()), ("releasd under the mit licence", {"mit"}),
        ("gnu general public license version 1", set()), ("gnu generl public licence version 3", {"gpl-3"}), ("gnu general public license version 2 or later", {"gpl-2"}),
        ("licensed under cc by nd 4 0", set()), ("licenced under cc by nc 4 0", {"cc-by-nc"}), ("licensed under cc by sa 4.0", {"cc-by-sa"}),
        ("licensed under the apache license version 1 1", set()), ("licenced under the apache licence, version 2.0", {"apache-2"}),
        ("gnu lesser general public licence", {"lgpl"}), ("gnu affero generl public license", {"agpl"}), ("mozilla public licence version 1 1", set()),
    ],
)
def test_telling_words_of_a_notice_are_exact(text, labels):
    own = license_scan.Scanner(license_scan.BASE, license_scan.FUZZY)
    assert {find[2] for find in own.scan(text)[2]} == labels
    assert {find[2] for find in own.scan(f"Words before, {text} and words behind.")[2]} == labels


def test_hilbert_curve_steps_to_neighbours():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = curve_packing.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1).max() == 1


def test_shards_follow_the_curve_and_differ_by_one_row(spark, docs, rows, empty):
    grid = spark.createDataFrame([(x, y, z) for x in range(4) for y in range(4) for z in range(4)], "a int, b int, c int")
    placed = sorted((r["h"], r["a"], r["b"], r["c"]) for r in grid.withColumn("h", hilbert_shards.curve_index([F.col(c) for c in "abc"], 2)).collect())
    assert [p[0] for p in placed] == list(range(64))
    assert all(sum(abs(x - y) for x, y in zip(p[1:], q[1:], strict=True)) == 1 for p, q in zip(placed, placed[1:], strict=False))
    clashing = [F.lit("x").alias(c) for c in ("_hash", "_weight", "_row", "_id", "_row_", "curve", "_place", "_n")]
    narrow = docs.select("doc_id", "_salt", *clashing, F.col("text").substr(1, 3).alias("source"), F.length("text").alias("size"))
    for weight in (None, "size"):
        got = hilbert_shards.shards(narrow, "doc_id", ["source", "size", "doc_id"], 7, weight).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if weight is None:
            sizes = [len(slots[k]) for k in range(7)]
            assert max(sizes) - min(sizes) <= 1
        curve = sorted((r["shard"], r["slot"], r["curve"]) for r in got)
        assert [c[2] for c in curve] == sorted(c[2] for c in curve)
    assert hilbert_shards.shards(empty.select("doc_id", "text"), "doc_id", ["text", "doc_id"], 7).count() == 0


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark, docs, rows, empty):
    got = {(r["doc_id"], r["n_card"]): r for r in feistel_pii.pseudonymise(docs, "doc_id", "text", "k").collect()}
    linked = [r["text"] for r in got.values() if r["n_card"]]
    cards = {re.search(r"\d{16}", t)[0] for t in linked}
    assert len(linked) == 2 and len(cards) == 1 and luhn(cards.pop())
    changed = next(t for t in linked if "@" in t)
    pattern = r"card \d{16} \+1 \(\d{3}\) \d{3}-\d{4} [a-z]\.[a-z]@mail\.example\.com (?:\d{1,3}\.){3}\d{1,3} \d{4}-\d\d-\d\d"
    assert re.fullmatch(pattern, changed) and not any(x in changed for x in ("4316522678525456", "555-3824", "227.5.221.1", "2024-02-29"))
    plain = Counter((i, t) for i, t in rows if t is None or not re.search(r"\d{16}", t))
    assert Counter((r["doc_id"], r["text"]) for r in feistel_pii.pseudonymise(docs, "doc_id", "text", "k").collect() if not r["n_card"]) == plain
    finds = ["4316522678525456", "+1 (743) 555-3824", "1.2.3.4", "Thé.6@x.org", "123-45-6789", "29.02.2024", "31/12/1999", "ab" * 16 + "01", "4111-1111-1111-1111"]
    frame = spark.createDataFrame([(f,) for f in finds], "f string").withColumn("k", feistel_pii.kind(F.col("f")))
    there = frame.withColumn("p", feistel_pii.pseudonym(F.col("f"), F.col("k"), "key"))
    both = there.withColumn("b", feistel_pii.pseudonym(F.col("p"), F.col("k"), "key", back=True)).withColumn("again", feistel_pii.kind(F.col("p"))).collect()
    assert all(r["b"] == r["f"] != r["p"] and len(r["p"]) >= 7 and r["k"] == r["again"] for r in both)
    wrong = ["9870157079875996", "4316522678525457", "2023-02-29", "000-12-3456", "1234"]
    assert spark.createDataFrame([(f,) for f in wrong], "f string").where(feistel_pii.kind(F.col("f")).isNotNull()).count() == 0
    assert feistel_pii.pseudonymise(empty, "doc_id", "text", "k").count() == 0


def test_feistel_is_a_permutation(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("f"))
    moved = numbers.select(feistel_pii.code(F.col("f"), 10, "t", "key").alias("p"))
    assert moved.distinct().count() == 1000 and moved.where("length(p) = 3").count() == 1000


def test_license_places(docs, rows, empty):
    got = license_scan.summary(license_scan.scan(docs, "doc_id", "text"), "doc_id").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    by_text = dict(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), by_text[r["doc_id"]] or ""))
        places = [(i, n.label) for n in license_scan.BASE for i in range(len(words)) if words[i : i + len(n.phrase.split())] == n.phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
    edited = next(r for r in got if r["doc_id"] is not None and "licence" in (by_text[r["doc_id"]] or ""))
    assert edited["base_labels"] == "apache-2" and edited["n_base"] == 2 and "mit" in license_scan.Scanner(license_scan.BASE, license_scan.FUZZY).scan("released under the mit licence")[2][0]
    assert license_scan.scan(empty, "doc_id", "text").count() == 0


def test_adjoining_notices_are_all_found():
    own = license_scan.Scanner(license_scan.BASE, license_scan.FUZZY)
    copies = ["licensd undr the apache licence version 2 9", "licensed under the apache license version 2 0", "licensed under the apache license versoin 2 0"]
    for listed in (copies, copies[::-1], [copies[0]] * 3, [copies[2], copies[0], copies[1]]):
        finds = [f for f in own.scan(" ".join(listed))[2] if f[2] == "apache-2"]
        assert [f[0] for f in finds] == [0, 8, 16] and all(f[1] == 8 for f in finds)
        assert [f[3] for f in finds] == [{copies[0]: 4, copies[1]: 0, copies[2]: 2}[c] for c in listed]
    labels = [f[2] for f in own.scan("gnu generl public licence version 3 gnu general public license version 2")[2]]
    assert labels == ["gpl-3", "gpl-2"]
    single = [f for f in own.scan("so it is " + copies[0] + " and so on")[2]]
    assert [f[:4] for f in single] == [(3, 8, "apache-2", 4)]


@pytest.mark.parametrize(("hot", "share"), [(substring_dedup.HOT, substring_dedup.SHARE), (0, 1), (substring_dedup.HOT, 20)])
def test_repeated_windows_go(docs, rows, empty, hot, share):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    often = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    wanted = Counter()
    for (id_, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 34) if often[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        wanted[id_, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    got = substring_dedup.deduplicate(docs, "doc_id", "text", hot=hot, share=share)
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == wanted
    assert sum(k[2] * v for k, v in wanted.items()) > 600
    if hot and share == substring_dedup.SHARE:
        rewritten = substring_dedup.rewrite(docs, "doc_id", "text")
        assert rewritten.columns == docs.columns and rewritten.count() == len(rows)
        assert substring_dedup.deduplicate(empty, "doc_id", "text").count() == 0


@pytest.mark.parametrize("id_", [7, None])
def test_work_grows_with_repeated_rows_and_not_with_their_square(spark, id_):
    text, other = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(60))
    lengths = []
    for m in (10, 1000):
        frame = spark.createDataFrame([(id_, text)] * m + [(1, f"{other} {text}"), (2, other), (3, "x " + other)], "doc_id long, text string").repartition(4)
        outline, texts, hits, _ = substring_dedup.repeats(substring_dedup.keyed(frame, "doc_id", "text"))
        assert outline.count() == m + 3 and texts.count() == m + 3
        lengths.append(hits.select(F.sum(F.size("hits"))).first()[0])
    assert lengths[0] == lengths[1]  # a key's windows are listed once, however often the key comes
    got = substring_dedup.deduplicate(frame, "doc_id", "text")
    assert collected(got, "doc_id", "n_words", "n_removed") == Counter({(id_, 200, 200): 1000, (1, 260, 260): 1, (2, 60, 60): 1, (3, 61, 60): 1})


def test_a_hot_passage_is_folded_before_it_is_dealt(spark, monkeypatch):
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, hot = prose(50), 16
    rows = [(i, " ".join([*prose(30), *passage, *prose(30)])) for i in range(60)]
    frame = spark.createDataFrame([*rows, (60, " ".join(prose(90)))], "doc_id long, text string").repartition(4)
    dealt, real = [], substring_dedup.stream_map
    monkeypatch.setattr(substring_dedup, "stream_map", lambda df, *rest: dealt.append(df.select("anchor")) or real(df, *rest))
    got = {r["doc_id"]: r for r in substring_dedup.deduplicate(frame, "doc_id", "text", hot=hot).collect()}
    for id_, text in rows:
        words = text.split()
        assert (got[id_]["n_removed"], got[id_]["kept_sha256"]) == (50, sha(" ".join([*words[:30], *words[80:]])))
    assert got[60]["n_removed"] == 0
    assert all((df.groupBy("anchor").count().agg(F.max("count")).first()[0] or 0) <= hot for df in dealt) and dealt


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths = rng.integers(1, 12, rng.integers(1, 6))
        text, weights = rng.integers(0, 3, lengths.sum()), rng.integers(1, 3, len(lengths))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        passages = [text[a : a + n].tolist() for a, n in zip(starts, lengths, strict=True)]
        count = lambda p: sum(int(w) * sum(s[i : i + len(p)] == p for i in range(len(s))) for s, w in zip(passages, weights, strict=True))  # noqa: E731, B023
        floors = np.repeat(starts, lengths)
        got = fm_index.matches(fm_index.Index(text, starts, weights, 3), text, np.arange(len(text)), floors)
        for end, floor, reached in zip(range(len(text)), floors, got, strict=True):
            assert reached == min([s for s in range(floor, end + 1) if count(text[s : end + 1].tolist()) > 1], default=end + 1)


def test_near_duplicates(docs, rows, empty):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [grams(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    wanted = Counter()
    for i, (id_, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo = [k for j in todo for k in links[j] if k not in seen and not seen.add(k)]
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        wanted[id_, least, len(links[i])] += 1
    got = ngram_join.join(docs, "doc_id", "text")
    assert collected(got, "doc_id", "class_id", "n_links") == wanted
    assert max(k[2] for k in wanted) >= 3
    assert ngram_join.join(empty, "doc_id", "text").count() == 0


def test_a_forest_is_as_deep_as_the_audit_allows(spark):
    at_threshold = ngram_join.prefix_depth([0] * 9)
    assert ngram_join.expected(at_threshold, 0.8) >= ngram_join.RECALL > ngram_join.expected(at_threshold + 1, 0.8)
    assert ngram_join.prefix_depth([0] * 8 + [500]) == at_threshold  # pairs that agree in all say nothing about those at the threshold
    assert ngram_join.prefix_depth([0, 0, 3, 0, 0, 0, 0, 0, 500]) == 2  # audited pairs that only a shorter prefix finds
    assert ngram_join.prefix_depth([0] * 8 + [500], threshold=0.95) > at_threshold

    generator = random.Random(4)
    texts = []
    for _ in range(40):
        words = [str(generator.random()) for _ in range(60)]
        texts += [" ".join(words[:n] + [str(generator.random())]) for n in (60, 59, 58, 55)]
    signs = [ngram_join.signature(ngram_join.grams(t)) for t in texts]
    classes = spark.createDataFrame([(bytes([n]), s) for n, s in enumerate(signs)], "class binary, sign binary")
    found = ngram_join.audit(classes, 0.8, most=1000)

    rows = np.frombuffer(b"".join(signs), "<u4").reshape(len(texts), ngram_join.TREES, ngram_join.DEPTH)
    want = [0] * (ngram_join.DEPTH + 1)
    first_of = {}
    for n, row in enumerate(rows):
        for t in range(ngram_join.TREES):
            first_of.setdefault((t, row[t, : ngram_join.SHORTEST].tobytes()), []).append(n)
    sampled = {min(group) for group in first_of.values() if len(group) > 1}
    for a in sampled:
        for b in range(len(texts)):
            if a != b and (rows[a] == rows[b]).mean() >= 0.8:
                depths = [next((d for d in range(ngram_join.DEPTH) if rows[a][t][d] != rows[b][t][d]), ngram_join.DEPTH) for t in range(ngram_join.TREES)]
                want[max(depths)] += 1
    assert found == want and sum(want) > 100
    assert 0 < sum(ngram_join.audit(classes, 0.8, most=5)) < sum(want)
    assert ngram_join.audit(classes.where("false")) == [0] * (ngram_join.DEPTH + 1)


def test_blocks_and_patterns_count_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    both = ngram_join.shared(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))
    near = rng.random((30, 30)) < 0.03
    assert len(ngram_join.forest(near | near.T)) < 30


def smallest_reached(links):
    """Each linked node and the smallest one of its component."""
    top = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(top[a], top[b])
            changed |= top[a] != least or top[b] != least
            top[a] = top[b] = least
    return top


def test_a_round_of_components_shuffles_links_a_few_times(spark, monkeypatch):
    plans, save = [], common.save
    monkeypatch.setattr(common, "save", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(df, name))
    rng = random.Random(4)
    path = rng.sample(range(10_000, 10_100), 100)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, x) for x in range(501, 560)] + [(900, x) for x in range(840, 900)]
    links += [*zip(path, path[1:], strict=False), (7, 7), (501, 500)]
    found = common.components(spark.createDataFrame(links, "a bigint, b bigint"), "few").collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["root"] for r in found} == smallest_reached([x for x in links if x[0] != x[1]])
    assert max(plan.count("Exchange") for plan in plans[1:]) <= 6
    assert common.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint"), "none").count() == 0


@pytest.mark.parametrize("most", [1, 50, 1000])
def test_links_of_a_task_are_folded_to_stars(most):
    rng = random.Random(5)
    links = [(b"%d" % rng.randrange(300), b"%d" % rng.randrange(300)) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in links[at : at + 40]], pa.binary()) for i in (0, 1)], ["a", "b"]) for at in range(0, 400, 40)]
    stars = [(x["a"], x["b"]) for batch in ngram_join.folded(iter(batches), most) for x in batch.to_pylist()]
    wanted = smallest_reached([x for x in links if x[0] != x[1]])
    assert smallest_reached(stars) == wanted
    if most == 1000:
        assert dict(stars) == {a: b for a, b in wanted.items() if a != b} and len(dict(stars)) == len(stars)
    assert list(ngram_join.folded(iter([]))) == []


def test_embeddings_without_an_id(spark):
    table = [(None, "a", [1.0, 0.0]), (4, "a", [1.0, 0.01]), (4, "a", [1.0, 0.01]), (None, "b", [0.0, 1.0]), (None, "b", [0.0, 1.0]), (6, None, [1.0, 0.0]), (None, "a", None)]
    frame = spark.createDataFrame(table, "vec_id long, label string, embedding array<double>")
    got = collected(nn_descent.deduplicate(frame, "vec_id", "label", "embedding"), "vec_id", "n_links", "component_id", "kept")
    assert got == Counter([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 1, None, True), (None, 1, None, True), (6, 0, 6, True), (None, 0, None, True)])


def test_an_audit_that_never_passes_raises(spark, monkeypatch):
    frame = spark.createDataFrame([(i, "a", [1.0, i / 1000]) for i in range(12)], "vec_id long, label string, embedding array<double>")
    monkeypatch.setattr(nn_descent, "audited", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="0.500"):
        nn_descent.deduplicate(frame, "vec_id", "label", "embedding")


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 16))
    vectors = [(centre[i % 6] + rng.normal(0, 0.03, 16)).tolist() for i in range(120)] + rng.normal(size=(80, 16)).tolist()
    rows = [(i, i % 6 if i % 7 else 9, v) for i, v in enumerate(vectors)]
    rows += [(300, 1, vectors[1]), (301, None, vectors[1]), (302, 1, None), (303, 1, []), (304, 1, [0.0] * 16), (305, 1, [float("nan")] * 16), (306, 1, [None] * 16), (307, 1, vectors[1][:5])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4).withColumn("node", F.lit(1))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows[:201]}
    label = {i: y for i, y, _ in rows}
    links = {i: [j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.98] for i in unit}
    wanted = Counter()
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            todo = [k for j in todo for k in links.get(j, []) if k not in seen and not seen.add(k)]
        wanted[i, len(links.get(i, [])), min(seen), i == min(seen)] += 1
    got = nn_descent.deduplicate(frame, "vec_id", "label", "embedding", neighbours=4)
    assert collected(got, "vec_id", "n_links", "component_id", "kept") == wanted
    assert max(k[1] for k in wanted) > 8  # more than a list holds
    assert nn_descent.deduplicate(frame.where("false"), "vec_id", "label", "embedding").count() == 0


def test_dense_groups_with_links_across(spark):
    rng = np.random.default_rng(6)
    centre, aside = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    groups = [np.cos(t) * centre + np.sin(t) * aside + rng.normal(0, 0.0055, (40, 64)) for t in (0, 0.19)]
    unit = np.concatenate(groups)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    best = np.argsort(-(unit @ unit.T - 2 * np.eye(80)), axis=1)[:, :8]
    assert near[:40, 40:].any() and near.sum(1).min() > 8 and ((best < 40) == (np.arange(80) < 40)[:, None]).all()
    frame = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(unit)], "vec_id long, label int, embedding array<double>").repartition(4)
    # the audit would see so many lost links and start anew; without it the search itself has to find them
    got = nn_descent.deduplicate(frame, "vec_id", "label", "embedding", recall=0.0)
    assert collected(got, "vec_id", "n_links", "component_id") == Counter((i, int(n), 0) for i, n in enumerate(near.sum(1)))


def test_fingerprints(docs, rows, empty):
    got = weighted_sampling.edited_against_next(docs, "doc_id", "text").collect()
    assert len(got) == len(rows)
    known = [(i, t or "") for i, t in rows if i is not None]
    order = sorted(set(known), reverse=True)
    after = dict(zip([i for i, _ in order], [t for _, t in order[1:]], strict=False))
    texts = dict(known)
    prints = {}
    for r in got:
        if r["doc_id"] is None:
            continue
        text = texts[r["doc_id"]]
        assert r["n_chars"] == len(text) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if [i for i, _ in known].count(r["doc_id"]) == 1 and r["doc_id"] in after:
            half = len(text) // 2
            assert r["edited_sha256"] == sha(text[: len(text) - half] + after[r["doc_id"]][:half])
    assert weighted_sampling.edited_against_next(empty, "doc_id", "text").count() == 0


def test_likeness_estimates_the_generalised_jaccard(spark):
    a, b = ["x"] * 6 + ["y"] * 2 + ["z"], ["x"] * 3 + ["y"] * 4 + ["w"]
    pairs = 25  # each with words of its own, so that its draws are independent of the others'
    rows = [(2 * i + side, " ".join(f"{w}{i}" for w in text)) for i in range(pairs) for side, text in enumerate((a, b))]
    frame = spark.createDataFrame(rows, "id long, text string")
    signed = {r["id"]: r["signature"] for r in weighted_sampling.signatures(frame, ["id"], "text").collect()}
    wanted = (3 + 2) / (6 + 4 + 1 + 1)
    assert all(len(s) == weighted_sampling.SAMPLES for s in signed.values()) and len(signed) == 2 * pairs
    same = [np.array(signed[2 * i]) == np.array(signed[2 * i + 1]) for i in range(pairs)]
    assert abs(np.mean(same) - wanted) < 0.1


def test_classifier_on_rows_it_has_not_seen(spark, empty):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    junk = lambda n: " ".join(rng.choice(["$$$", "BUY!!", "###", "%%%x"]) for _ in range(n))
    rows = [(i, prose(60) if i % 3 else junk(60), int(i % 3 > 0)) for i in range(300)] + [(300, None, 1), (301, "", 1), (None, "x", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    net = byte_cnn.fit(docs, labels, "doc_id", "text", "quality", rows=100)
    scored = {r["doc_id"]: r["score"] for r in byte_cnn.score(docs, "doc_id", "text", net).collect()}
    assert all(0 <= s <= 1 for s in scored.values()) and len(scored) == len(rows)
    unseen = [(scored[i], q) for i, _, q in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(unseen) > 40 and sum((s >= 0.7) == (q == 1) for s, q in unseen) >= 0.97 * len(unseen)
    assert byte_cnn.accepted(docs, "text", net, 0.7).columns == docs.columns
    assert byte_cnn.score(empty, "doc_id", "text", net).count() == 0
    assert byte_cnn.train([]).score([b""])[0] == 0.5


def test_a_score_does_not_depend_on_the_texts_around():
    rng = np.random.default_rng(8)
    net = byte_cnn.train([])
    net.out[:] = rng.normal(0, 0.3, net.out.shape)
    texts = [rng.integers(0, 256, byte_cnn.BLOCK * (1 + i % 3)).astype(np.uint8).tobytes() for i in range(40)] + [b"", bytes(byte_cnn.SLICE), b"x" * 300]
    alone = np.concatenate([net.score([t]) for t in texts])
    assert np.abs(net.score(texts) - alone).max() < 1e-6 and np.abs(net.score(texts[::-1])[::-1] - alone).max() < 1e-6


def test_gradients():
    rng = np.random.default_rng(4)
    net = byte_cnn.train([])
    net.out[:] = rng.normal(0, 0.3, net.out.shape)
    net = byte_cnn.Network(*[p.astype(np.float64) for p in (net.vectors, net.left, net.right, net.bias, net.out, net.offset)])
    texts = [rng.integers(0, 256, (n, 2 * byte_cnn.BLOCK + byte_cnn.STEP)).astype(np.uint8) for n in (1, 3)]
    labels, weights = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        total = 0
        for chunk, y in zip(texts, labels, strict=True):
            groups = net.vectors[chunk].reshape(len(chunk), -1, net.left.shape[0])
            best = np.maximum((groups[:, :-1] @ net.left + groups[:, 1:] @ net.right).max(1) + net.bias, 0)
            p = 1 / (1 + np.exp(-(np.concatenate([best.mean(0), best.max(0)]) @ net.out + net.offset[0])))
            total -= (y * np.log(p) + (1 - y) * np.log(1 - p)) / 2
        return total

    grads = byte_cnn._gradients(net, texts, labels, weights)
    for part, grad in zip((net.left, net.right, net.bias, net.out, net.offset), grads[1:], strict=True):
        flat, slope = part.reshape(-1), grad.reshape(-1)
        at = int(np.abs(slope).argmax())
        before, step = flat[at], 1e-6
        flat[at] = before + step
        up = loss()
        flat[at] = before - step
        down = loss()
        flat[at] = before
        assert abs((up - down) / (2 * step) - slope[at]) < 1e-3 * max(1, abs(slope[at]))
