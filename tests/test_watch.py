import itertools
import random
from datetime import datetime, timedelta

import pytest
from offerwatch.operators import watch
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
COLS = "run_seq bigint, listing_key string, outcome string, fetched_at timestamp, error string, payload struct<total_czk bigint, electricity_estimated boolean>"


def read(run, key, outcome, total=None):
    error = {"ok": None, "gone": "HTTP 404"}.get(outcome, f"failed {run}")
    return (run, key, outcome, START + timedelta(hours=8 * run), error, (total if total is not None else run * 10, True) if outcome == "ok" else None)


def by_rule(rows):
    """Each output of a read as the last of something in its unbroken stretch of runs, up to that read."""
    by_key = {}
    for row in sorted(rows):
        by_key.setdefault(row[1], []).append(row)
    out = []
    for reads in by_key.values():
        for n, (run, key, outcome, at, error, _) in enumerate(reads):
            start = max(i for i in range(n + 1) if i == 0 or reads[i][0] != reads[i - 1][0] + 1)
            stretch = reads[start : n + 1]
            last = lambda *kinds, among=stretch: next((r for r in reversed(among) if r[2] in kinds), None)
            ok, answer = last("ok"), last("ok", "gone")
            base = answer or stretch[0]
            gone = answer is not None and answer[2] == "gone"
            unread = outcome == "unreadable" and len(stretch) > 1
            out.append((
                run, key,
                answer is not None and not gone,
                base[3],
                base[4],
                ok[3] if gone and ok else None,
                True if stretch[0][2] == "unreadable" and not ok else None,
                error if unread else None,
                at if unread else None,
                ok[5] if ok else None,
            ))
    return sorted(out, key=lambda r: r[:2])


def rows_of(df):
    return sorted(
        (
            (r.run_seq, r.listing_key, r.active, r.fetched_at, r.error, r.last_active_at, r.unavailable, r.fetch_error,
             r.fetch_error_at, tuple(r.payload) if r.payload else None)
            for r in df.collect()
        ),
        key=lambda r: r[:2],
    )


def every_order():
    rows = []
    for n, outcomes in enumerate(itertools.product(("ok", "gone", "unreadable"), repeat=4)):
        rows += [read(i + 1, f"k{n}", o) for i, o in enumerate(outcomes)]
    return rows


def random_reads(seed, keys=60, runs=24):
    rng = random.Random(seed)
    return [
        read(run, f"k{k}", rng.choice(["ok", "ok", "gone", "unreadable"]), rng.choice([1, 2]))
        for k in range(keys) for run in range(1, runs + 1) if rng.random() < 0.85
    ]


@pytest.mark.parametrize("block", [1, 5, 512])
def test_closed_form_equals_the_rules(spark, block):
    rows = every_order() + [tuple([r[0], "z" + r[1], *r[2:]]) for r in random_reads(3)]
    df = spark.createDataFrame(rows, COLS)
    assert rows_of(watch.carry_forward(df, block)) == by_rule(rows)


def test_steps_equal_the_rules(spark):
    rows = random_reads(4, keys=20, runs=6)
    df = spark.createDataFrame(rows, COLS).cache()
    state = watch.carry_forward(df.where("false"))
    got = []
    for run in range(1, 7):
        state = watch.carry_step(state, df.where(F.col("run_seq") == run))
        state = spark.createDataFrame(state.collect(), state.schema)
        got += rows_of(state)
    assert sorted(got, key=lambda r: r[:2]) == by_rule(rows)
    df.unpersist()


@pytest.mark.parametrize("cut", [2, 5])
def test_state_as_reads_carries_on(spark, cut):
    rows = every_order() + [tuple([r[0], "z" + r[1], *r[2:]]) for r in random_reads(6, keys=30, runs=9)]
    df = spark.createDataFrame(rows, COLS)
    before = watch.carry_forward(df.where(F.col("run_seq") <= cut)).where(F.col("run_seq") == cut)
    later = watch.carry_on(before, df.where(F.col("run_seq") > cut), cut + 1)
    assert rows_of(later) == [r for r in by_rule(rows) if r[0] > cut]


def test_watched_changes(spark):
    rows = [read(1, "a", "ok", 5), read(2, "a", "ok", 6), read(3, "a", "gone"), read(1, "b", "ok", 5), read(2, "b", "unreadable"),
            read(3, "b", "ok", 9), read(1, "c", "ok", 1), read(3, "c", "ok", 2)]
    states = watch.carry_forward(spark.createDataFrame(rows, COLS))
    got = {tuple(r) for r in watch.watched_changes(states).collect()}
    assert got == {(2, "a", 5, 6), (3, "b", 5, 9)}


def test_legacy_watched_row_compares_as_null(spark):
    df = spark.createDataFrame(
        [(1, "a", True, (5, None)), (2, "a", True, (7, None)), (3, "a", True, (7, True))],
        "run_seq bigint, listing_key string, active boolean, payload struct<total_czk bigint, electricity_estimated boolean>",
    )
    assert [r.run_seq for r in watch.watched_changes(df).collect()] == [3]


def test_watchlist_edits(spark):
    at = [START + timedelta(minutes=i) for i in range(12)]
    edits = spark.createDataFrame(
        [("add", "https://x/detail/1", at[0]), ("add", "https://y/other/1/", at[1]), ("add", " https://x/007 ", at[2]),
         ("add", "https://x/5?q=1", at[3]), ("add", "12", at[4]), ("remove", "9", at[5]), ("remove", "https://x/8/", at[6]),
         ("remove", "nothing", at[7]), ("remove", "404", at[8]), ("add", "https://x/9", at[9]), ("add", "https://z/10", at[10]), ("remove", "10", at[11])],
        "op string, arg string, ts timestamp",
    )
    listed = spark.createDataFrame([("8", "u8"), ("9", "u9"), ("7", "u7")], "listing_key string, url string")
    usable, rejects = watch.read_edits(edits)
    assert {r.url for r in rejects.collect()} == {"https://x/5?q=1", "12", "nothing"}
    got = {tuple(r) for r in watch.apply_edits(listed, usable).collect()}
    assert got == {("7", "u7"), ("1", "https://x/detail/1"), ("9", "https://x/9")}
    again = watch.apply_edits(spark.createDataFrame(list(got), listed.schema), usable)
    assert {tuple(r) for r in again.collect()} == got


def test_columns_along_stay_with_their_state_without_another_join(spark):
    rows = [(run, key, "ok" if run % 3 else "unreadable", f"{run:02}", None, run if run % 3 else None, f"{key}{run}") for run in (1, 2, 3, 5, 6, 7) for key in "ab"]
    reads = spark.createDataFrame(rows, "run_seq long, listing_key string, outcome string, fetched_at string, error string, payload long, url string")
    plain, along = watch.carry_forward(reads, 2), watch.carry_forward(reads, 2, along=("url",))
    assert along.columns == [*plain.columns, "url"]
    assert sorted(along.drop("url").collect(), key=str) == sorted(plain.collect(), key=str)
    assert {(r["run_seq"], r["listing_key"]): r["url"] for r in along.collect()} == {(r[0], r[1]): r[6] for r in rows}
    exchanges = [d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for d in (plain, along)]
    assert exchanges[0] == exchanges[1]
