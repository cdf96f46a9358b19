import random

import pytest
from offerwatch.plans.serving import Serving
from offerwatch.session import work_dir
from pyspark.sql import functions as F

TEXTS = ("title", "city_part", "locality")
SCHEMA = "listing_key string, ordinal bigint, rate double, title string, city_part string, locality string"


def served(spark, rows, ranges):
    serving = Serving(spark, work_dir(spark, "serving"), ["rate", "ordinal"])
    serving.write(spark.createDataFrame(rows, SCHEMA), TEXTS, ranges)
    return serving


def lowest_null(row):
    return (row[2] is not None, row[2] or 0, row[1])


@pytest.fixture(scope="module")
def many(spark):
    draw = random.Random(3)
    word = ["Žižkov", "byt", "BYT 2+kk", "a", "", None, "100%_x", "straße", "日本語の家", "ab\\c", "aaa", "🏠 dům"]
    rows = [
        (f"k{i}", i, draw.choice([None, None, 1.5, 2.0, 2.0, 2.0, draw.random()]), f"{draw.choice(word)} {draw.choice(word)}", draw.choice(word), draw.choice(word))
        for i in range(300)
    ]
    return rows, served(spark, rows, 7)


@pytest.mark.parametrize("descending", [False, True])
def test_pages_joined_are_the_whole_order(many, descending):
    rows, serving = many
    assert serving.rows().select("part").distinct().count() > 4
    for size, where, keep in ((70, None, lambda r: True), (3, F.col("ordinal") % 37 == 5, lambda r: r[1] % 37 == 5)):
        got, after = [], None
        while page := serving.page(size, after, descending, where).collect():
            assert len(page) <= size
            got += [r.listing_key for r in page]
            after = page[-1]
        assert got == [r[0] for r in sorted(rows, key=lowest_null, reverse=descending) if keep(r)]


def test_a_page_opens_only_its_ranges(many):
    _, serving = many
    ranges = {r.part: r for r in serving.spark.read.parquet(f"{serving.path}/ends").collect()}
    last = max(ranges)
    plan = serving.page(1, ranges[last]["first"])._jdf.queryExecution().toString()
    assert "part#" in plan and f">= {last})" in plan and f"<= {last})" in plan


def test_pages_of_an_empty_table_and_behind_the_last_row(spark, many):
    rows, serving = many
    end = max(rows, key=lowest_null)
    assert serving.page(5, {"rate": end[2], "ordinal": end[1]}).count() == 0
    nothing = served(spark, [], 3)
    assert nothing.page(5).count() == 0 and nothing.page(5, None, True, F.col("ordinal") > 0).count() == 0 and nothing.search("abc").count() == 0


def test_search_is_the_substring_test(many):
    rows, serving = many
    for needle in ("", "a", "Ž", "ab", "byt", "BYT", "t 2", "žižk", "0%_", "b\\c", "aaa", "aaaa", "語の家", "🏠 d", "v b", "kk a", "ß", "zzz"):
        want = {r[0] for r in rows if any(t is not None and needle.lower() in t.lower() for t in r[3:])}
        assert {r.listing_key for r in serving.search(needle, TEXTS).collect()} == (want if needle else {r[0] for r in rows}), needle


def test_search_reads_postings_of_the_rarest_letters(many):
    _, serving = many
    assert "vyt" not in serving.rarest("žižkov byt") and len(serving.rarest("žižkov byt")) == 3
    assert serving.rarest("qqqq") == []
    plan = serving.search("byt")._jdf.queryExecution().toString()
    assert "EqualTo(gram,byt)" in plan  # of what a search reads, only postings have letters
    assert "StringStartsWith(gram,a)" in serving.search("a")._jdf.queryExecution().toString()
