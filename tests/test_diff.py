import random
import re
from collections import Counter

import pytest
from offerwatch import schemas
from offerwatch.operators import diff
from offerwatch.operators.dedup import keep_last
from pyspark.sql import functions as F

COLS = "run_seq bigint, listing_key string, source string, price_czk bigint, total_czk bigint, electricity_estimated boolean, enrich_failed boolean"


def table(spark, rows):
    return spark.createDataFrame(rows, COLS)


def sighting(run, key, price, source="a", total="same", estimated=True, failed=None):
    return (run, key, source, price, price if total == "same" else total, estimated, failed)


def by_rule(rows, last):
    """Every event from the two runs around it: a sighting is known from up to two runs back, gone after two without it."""
    seen = {(row[1], row[0]): row for row in rows}
    compared = lambda row: row[3] if None in (row[4], row[5]) else row[4]
    events = set()
    for (key, run), row in seen.items():
        known = next((seen[key, run - back] for back in (1, 2) if (key, run - back) in seen), None)
        if known is None and run > 1:
            events.add((run, "new", key, None, None, None))
        if known is not None and compared(known) != compared(row):
            events.add((run, "price_change", key, known[4], row[4], None))
        if run + 2 <= last and not {(key, run + 1), (key, run + 2)} & set(seen):
            events.add((run + 2, "removed", key, None, None, run + 1))
    return events, {key for key, run in seen if run == last - 1 and (key, last) not in seen}


def as_set(changes):
    return {
        (r.run_seq, r.kind, r.listing_key, r.old_total_czk, r.new_total_czk, r.missing_since_seq)
        for r in changes.collect()
    }


PATTERNS = {"1": [], "11": [], "101": [], "1001": [(3, "removed"), (4, "new")], "011": [(2, "new")],
            "10": [], "100": [(3, "removed")], "0101": [(2, "new")], "11001": [(4, "removed"), (5, "new")]}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_presence_patterns(spark, pattern):
    rows = [sighting(i + 1, "k", 100) for i, c in enumerate(pattern) if c == "1"]
    rows += [sighting(i + 1, "always", 5) for i in range(len(pattern))]
    got = diff.diff_runs(table(spark, rows), with_item=False).select("run_seq", "kind").collect()
    assert sorted((r.run_seq, r.kind) for r in got) == PATTERNS[pattern]
    waiting = [r.listing_key for r in diff.pending(table(spark, rows)).collect()]
    assert waiting == (["k"] if pattern.endswith("10") else [])


def random_rows(seed, keys=40, runs=30):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        price = rng.randint(1, 4) * 100
        for run in range(1, runs + 1):
            if rng.random() < 0.25:
                price = rng.randint(1, 4) * 100
            if rng.random() < 0.55:
                rows.append(sighting(run, f"k{k}", price, total=rng.choice(["same", None]), estimated=rng.choice([True, False, None])))
    rows += [sighting(run, "always", 7) for run in range(1, runs + 1)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("group", [3, 512])
def test_whole_history_equals_the_rules(spark, monkeypatch, seed, group):
    monkeypatch.setattr(diff, "RUNS_PER_GROUP", group)
    rows = random_rows(seed)
    events, waiting = by_rule(rows, 30)
    df = table(spark, rows)
    assert as_set(diff.diff_runs(df)) == events
    assert {r.listing_key for r in diff.pending(df).collect()} == waiting


def test_pair_steps_and_new_runs_equal_the_history(spark):
    rows = random_rows(5, keys=15, runs=8)
    df = table(spark, rows).cache()
    whole = as_set(diff.diff_runs(df, 8))
    waiting = df.where("false")
    stepped = set()
    for run in range(2, 9):
        changes, waiting = diff.diff_pair(df.where(F.col("run_seq") == run - 1), waiting, df.where(F.col("run_seq") == run), run)
        stepped |= as_set(changes)
        waiting = spark.createDataFrame(waiting.collect(), waiting.schema)
    assert stepped == whole
    assert as_set(diff.diff_new_runs(df, 2, 4)) | as_set(diff.diff_new_runs(df, 5, 8)) == whole
    df.unpersist()


def test_failed_detail_is_a_price_change_unless_strict(spark):
    rows = [sighting(1, "k", 100, total=1700), sighting(2, "k", 100, total=100, estimated=False, failed=True),
            sighting(1, "m", 100, total=1700), sighting(2, "m", 120, total=120, estimated=False, failed=True)]
    df = table(spark, rows)
    assert {r.listing_key for r in diff.diff_runs(df).collect()} == {"k", "m"}


def test_strict_mode_compares_price_of_failed_rows(spark):
    rows = [sighting(1, "k", 100, total=1700), sighting(2, "k", 100, total=100, failed=True), sighting(3, "k", 100, total=1700),
            sighting(1, "m", 100, total=1700), sighting(2, "m", 130, total=130, failed=True), sighting(3, "m", 130, total=1730)]
    df = table(spark, rows)
    assert len(diff.diff_runs(df).collect()) == 4
    assert [(r.run_seq, r.kind, r.listing_key) for r in diff.diff_runs(df, strict=True).collect()] == [(2, "price_change", "m")]
    one, two = df.where("run_seq = 1"), df.where("run_seq = 2")
    stepped, _ = diff.diff_pair(one, df.where("false"), two, 2, strict=True)
    assert [(r.run_seq, r.listing_key) for r in stepped.collect()] == [(2, "m")]


def test_failed_source_is_not_a_removal_in_strict_mode(spark):
    runs = range(1, 6)
    rows = [sighting(r, "a1", 100) for r in runs] + [sighting(r, "b1", 100, source="b") for r in (1, 4)]
    df = table(spark, rows)
    assert {(r.run_seq, r.kind, r.listing_key) for r in diff.diff_runs(df).collect()} == {(3, "removed", "b1"), (4, "new", "b1")}
    complete = spark.createDataFrame([("a", r) for r in runs] + [("b", r) for r in (1, 4, 5)], "source string, run_seq bigint")
    assert diff.diff_runs_strict(df, complete).collect() == []
    longer = table(spark, rows + [sighting(6, "a1", 100), sighting(7, "a1", 100)])
    complete = complete.unionByName(spark.createDataFrame([("a", 6), ("a", 7), ("b", 7)], complete.schema))
    got = diff.diff_runs_strict(longer, complete).collect()
    assert [(r.run_seq, r.kind, r.listing_key, r.missing_since_seq) for r in got] == [(7, "removed", "b1", 5)]


def test_removed_carries_the_last_record(spark):
    rows = [sighting(1, "k", 100), sighting(2, "k", 110)] + [sighting(r, "x", 1) for r in range(1, 5)]
    got = {(r.run_seq, r.kind): r for r in diff.diff_runs(table(spark, rows)).collect()}
    gone = got[(4, "removed")]
    assert gone.item.price_czk == 110 and (gone.missing_since_seq, gone.removed_since_seq) == (3, 4)


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), ("b", 1, "q")], "k string, o int, v string")
    assert {tuple(r) for r in keep_last(df, ["k"], ["o"]).collect()} == {("a", 3, None), ("b", 1, "q")}


def test_one_window_shuffle(spark):
    df = spark.range(1000).select(
        (F.col("id") % 50 + 1).alias("run_seq"), (F.col("id") % 20).cast("string").alias("listing_key"),
        F.col("id").alias("price_czk"), F.col("id").alias("total_czk"), F.lit(True).alias("electricity_estimated"),
    )
    plan = diff.diff_runs(df, 50, with_item=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "EvalPython" not in plan


def test_conform_keeps_nulls_and_defaults_absent(spark):
    df = schemas.conform(spark.createDataFrame([("k", None)], "listing_key string, fees_missing boolean")).first()
    assert df.fees_missing is None and df.active is True and df.images == [] and df.electricity_estimated is False


def test_strict_step_reads_the_last_complete_runs_and_equals_the_whole(spark, tmp_path):
    rng = random.Random(4)
    rows, complete = [], []
    for run in range(1, 15):
        for source in "abc":
            if rng.random() < 0.6 and not (source == "c" and 4 <= run <= 10):
                complete.append((source, run))
            rows += [(run, f"{source}{k}", source, rng.choice([1, 2]), rng.random() < 0.2) for k in range(8) if rng.random() < 0.6]
    listings = spark.createDataFrame(rows, "run_seq bigint, listing_key string, source string, price_czk bigint, enrich_failed boolean")
    listings = listings.selectExpr("*", "price_czk as total_czk", "true as electricity_estimated")
    listings.write.partitionBy("run_seq").parquet(str(tmp_path / "listings"))
    stored = spark.read.parquet(str(tmp_path / "listings")).select(*[F.col(c).cast(listings.schema[c].dataType) for c in listings.columns])
    calendar = spark.createDataFrame(complete, "source string, run_seq bigint")
    runs = spark.range(1, 15).select(F.col("id").alias("run_seq"))
    states = diff.source_states(calendar, runs).cache()
    names = [c for c in diff.DIFF_COLUMNS if c != "item"]
    whole = Counter(tuple(r) for r in diff.diff_runs_strict(stored, calendar, with_item=False).select(*names).collect())
    assert len(whole) > 60
    step, got = spark.createDataFrame([], diff.SOURCE_STATE), Counter()
    for run in range(1, 15):
        now = diff.step_source_states(step, calendar.where(F.col("run_seq") == run), run)
        step = spark.createDataFrame(now.collect(), diff.SOURCE_STATE)
        assert {tuple(map(str, r)) for r in step.collect()} == {tuple(map(str, r)) for r in states.where(F.col("run_seq") == run).select(*step.columns).collect()}
        events = diff.diff_new_runs_strict(stored, states, run, run, with_item=False)
        got += Counter(tuple(r) for r in events.select(*names).collect())
        named = sorted({r for x in step.collect() for r in x.recent})
        if len(named) > 1:
            read = re.search(r"PartitionFilters: \[[^\n]*?IN \(([\d,]+)\)", events._jdf.queryExecution().executedPlan().toString())
            assert len(named) <= 9 and sorted(map(int, read.group(1).split(","))) == named
    assert got == whole
    batch = diff.diff_new_runs_strict(stored, states, 5, 14, with_item=False)
    assert Counter(tuple(r) for r in batch.select(*names).collect()) == Counter({k: n for k, n in whole.items() if k[0] >= 5})
