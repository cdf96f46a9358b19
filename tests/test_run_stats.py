import random
import statistics

from offerwatch.operators import run_stats

SCHEMA = "run_seq bigint, listing_key string, kind string, price bigint"


def plain(rows, last):
    groups = {}
    for run, _, kind, price in rows:
        if price:
            groups.setdefault((run, kind), []).append(price)
    return {g: (round(statistics.median(v)), round(sum(v) / len(v)), len(v)) for g, v in groups.items() if g[0] <= last}


def computed(spark, rows, last):
    changes = run_stats.value_changes(spark.createDataFrame(rows, SCHEMA), ["kind"], "price", last)
    found = run_stats.price_stats_by_run(changes, ["kind"], "price", last).collect()
    assert len({(r.run_seq, r.kind) for r in found}) == len(found)
    return {(r.run_seq, r.kind): (r.median_per_sqm, r.avg_per_sqm, r.n) for r in found}


def test_equal_to_a_plain_loop(spark):
    draw = random.Random(5)
    rows, price = [], {}
    for run in range(1, 13):
        for k in range(30):
            if draw.random() < 0.3 or k not in price:
                price[k] = draw.choice([None, 0, 7, 7, 300, -5, draw.randrange(1, 70000), draw.randrange(1, 2**36)])
            # one group has nothing for some runs, one has no name, one value never changes
            if draw.random() < 0.8 and not (k % 3 == 1 and 4 <= run <= 6):
                rows.append((run, f"k{k}", [None, "sale", "rent"][k % 3], price[k]))
        rows.append((run, "still", "rent", 1234))
    assert computed(spark, rows, 12) == plain(rows, 12)
    assert computed(spark, rows, 9) == plain(rows, 9)


def test_a_value_that_stays_is_no_change(spark):
    rows = [(run, f"k{k}", "rent", 100 + k) for run in range(1, 6) for k in range(4)] + [(3, "k9", "rent", 50)]
    changes = run_stats.value_changes(spark.createDataFrame(rows, SCHEMA), ["kind"], "price", 5).collect()
    assert {(r.run_seq, r.price, r.d) for r in changes} == {(1, 100 + k, 1) for k in range(4)} | {(3, 50, 1), (4, 50, -1)}


def test_without_listings(spark):
    assert computed(spark, [], 4) == {} and computed(spark, [(1, "a", "rent", None), (2, "b", "rent", 0)], 2) == {}
