"""Short licence notices in texts, exact and with edits.

A notice that may differ by k edits is cut into k + 1 pieces; by the pigeonhole
principle one of them stands unchanged in every copy with at most k edits. An
Aho-Corasick automaton finds the pieces, and around each find by itself the
regex library's bounded-error matching verifies the notice and reports its
span, so that notices side by side are all found.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwatch.llm.common import arrow_map, tool

#: Bytes that are part of a word once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    """Words of a notice, joined by single spaces, its label and the edits it may have."""

    phrase: str
    label: str
    edits: int = 0
    #: Words that tell the notice from others like it; they have to stand as they are, edits may fall elsewhere only.
    telling: tuple[str, ...] = ()


# The notices that are searched for.
BASE = (
    Notice("under the mit license", "mit"),
    Notice("apache license version 2", "apache-2"),
    Notice("cc by nc", "cc-by-nc"),
)
FUZZY = (
    Notice("released under the mit license", "mit", 3, ("mit",)),
    Notice("permission is hereby granted free of charge to any person", "mit", 5),
    Notice("licensed under the apache license version 2 0", "apache-2", 4, ("apache", "2")),
    Notice("gnu general public license version 3", "gpl-3", 3, ("3",)),
    Notice("gnu general public license version 2", "gpl-2", 3, ("2",)),
    Notice("gnu lesser general public license", "lgpl", 3, ("lesser",)),
    Notice("gnu affero general public license", "agpl", 3, ("affero",)),
    Notice("mozilla public license version 2 0", "mpl-2", 3, ("mozilla", "2")),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("licensed under cc by nc 4 0", "cc-by-nc", 2, ("nc",)),
    Notice("licensed under cc by sa 4 0", "cc-by-sa", 2, ("sa",)),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 4),
    Notice("all rights reserved", "all-rights-reserved", 1),
)


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return (text or "").encode().lower().translate(WORD).split()


def places(joined: bytes, phrase: str) -> list[int]:
    """Starts, in bytes, of every place where the words of `phrase` stand one after the other; `joined` has a space at either end."""
    wanted = b" " + phrase.encode() + b" "
    found, at = [], joined.find(wanted)
    while at >= 0:
        found.append(at + 1)
        at = joined.find(wanted, at + 1)
    return found


class Scanner:
    def __init__(self, base: tuple[Notice, ...], fuzzy: tuple[Notice, ...]):
        self.base, self.fuzzy = base, fuzzy
        self.patterns = []
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(fuzzy):
            self.patterns.append(regex.compile(f"(?b)(?:{regex.escape(notice.phrase, literal_spaces=True)}){{e<={notice.edits}}}"))
            cuts = [round(i * len(notice.phrase) / (notice.edits + 1)) for i in range(notice.edits + 2)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice.phrase[start:end], []).append((number, start))
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> dict[int, set[tuple[int, int]]]:
        """For each notice the stretches of `text` that can hold it, one around each piece found."""
        found: dict[int, set[tuple[int, int]]] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for number, start in uses:
                notice = self.fuzzy[number]
                begin = max(0, end - length + 1 - start - notice.edits)
                stop = min(len(text), end - length + 1 - start + len(notice.phrase) + notice.edits)
                found.setdefault(number, set()).add((begin, stop))
        return found

    def matches(self, number: int, text: str, begin: int, stop: int) -> list[tuple[int, int, int]]:
        """Edits, start and end of the best match in a stretch, and of those before and behind it."""
        notice, found, todo = self.fuzzy[number], [], [(begin, stop)]
        while todo:
            begin, stop = todo.pop()
            match = self.patterns[number].search(text, begin, stop) if stop - begin >= len(notice.phrase) - notice.edits else None
            if match:
                found.append((sum(match.fuzzy_counts), match.start(), match.end()))
                todo += [(begin, match.start()), (match.end(), stop)]
        return found

    def scan(self, text: str | None):
        """Word count, exact places as (label, first word, words) and fuzzy finds as (label, first word, words, edits, likeness)."""
        found = words(text)
        joined = b" " + b" ".join(found) + b" "
        exact = sorted(
            (joined.count(b" ", 0, at) - 1, len(n.phrase.split()), n.label) for n in self.base for at in places(joined, n.phrase)
        )
        fuzzy = set()
        plain = joined.decode("latin-1")
        for number, spans in self.candidates(plain).items():
            notice = self.fuzzy[number]
            for edits, start, end in separate(m for begin, stop in spans for m in self.matches(number, plain, begin, stop)):
                around = plain[plain.rfind(" ", 0, start + 1) + 1 : plain.find(" ", end - 1)].split()
                if any(word not in around for word in notice.telling):
                    continue
                first = max(0, plain.count(" ", 0, start + 1) - 1)
                fuzzy.add((first, max(1, len(plain[start:end].split())), notice.label, edits, round(1 - edits / len(notice.phrase), 6)))
        return len(found), exact, best_of(exact, fuzzy)


def separate(found) -> list[tuple[int, int, int]]:
    """Matches of one notice without those that share half of their length with one of fewer edits, which are the same place read differently."""
    starts: list[int] = []
    kept: dict[int, tuple[int, int, int]] = {}
    for match in sorted(set(found)):
        _, start, end = match
        at = bisect_left(starts, start)
        if all(2 * (min(end, e) - max(start, s)) < min(end - start, e - s) for _, s, e in (kept[x] for x in starts[max(0, at - 2) : at + 2])):
            insort(starts, start)
            kept[start] = match
    return list(kept.values())


def best_of(exact, fuzzy) -> list:
    """Without the finds that overlap an exact place, or a find of fewer edits, with another label."""
    kept = [(f, n, label, 0, 1.0) for f, n, label in exact]
    start = len(kept)
    for find in sorted(fuzzy, key=lambda x: (-x[4], -x[1], x)):
        first, n, label = find[:3]
        if all(k[2] == label or first >= k[0] + k[1] or k[0] >= first + n for k in kept):
            kept.append(find)
    return sorted(kept[start:])


def scanner(base: tuple[Notice, ...], fuzzy: tuple[Notice, ...]) -> Scanner:
    return tool(("scanner", base, fuzzy), lambda: Scanner(base, fuzzy))


SPANS = "array<struct<first_word:bigint,n_words:bigint,label:string,edits:int,likeness:double>>"


def scan(df: DataFrame, id_col: str, text_col: str, base: tuple[Notice, ...] = BASE, fuzzy: tuple[Notice, ...] = FUZZY) -> DataFrame:
    """id_col, n_words, exact and fuzzy spans (both in words, from 0) of every whole text.

    One row per row of `df`; null and empty texts have no words and no spans;
    overlapping places all count; other columns of `df` are not read. One pass,
    no shuffle; memory is that of one batch of texts.
    """
    span = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("likeness", pa.float64())])

    def function(batch):
        own = scanner(base, fuzzy)
        counts, exact, near = [], [], []
        for text in batch.column(1).to_pylist():
            n, places_, finds = own.scan(text)
            counts.append(n)
            exact.append([{"first_word": f, "n_words": k, "label": label, "edits": 0, "likeness": 1.0} for f, k, label in places_])
            near.append([{"first_word": f, "n_words": k, "label": label, "edits": e, "likeness": s} for f, k, label, e, s in finds])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(exact, pa.list_(span)), pa.array(near, pa.list_(span))],
            ["id", "n_words", "exact", "fuzzy"],
        )

    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_words bigint, exact {SPANS}, fuzzy {SPANS}"
    return arrow_map(df.select(F.col(id_col).alias("id"), text_col), function, schema).withColumnRenamed("id", id_col)


def summary(scanned: DataFrame, id_col: str) -> DataFrame:
    """One line per text: counts, first and last exact place, labels of the exact places and of all finds, best likeness."""
    firsts = F.transform("exact", lambda s: s["first_word"])
    lasts = F.transform("exact", lambda s: s["first_word"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    both = F.concat("exact", "fuzzy")
    return scanned.select(
        id_col,
        "n_words",
        F.size("exact").cast("bigint").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(lasts).alias("last_word"),
        labels(F.col("exact")).alias("base_labels"),
        labels(both).alias("labels"),
        F.coalesce(F.array_max(F.transform(both, lambda s: s["likeness"])), F.lit(0.0)).alias("score"),
    )
