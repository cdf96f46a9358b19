import random
import re
import statistics

import pytest
from offerwatch import config as C
from offerwatch.functions import costs, geo, html
from offerwatch.functions import text as X
from offerwatch.operators import enrich, stats
from offerwatch.operators.geo import near_centres
from offerwatch.plans import marts
from pyspark.sql import functions as F


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


AMOUNTS = {
    "3400": 3400, "3 400 Kč": 3400, "3.400 Kč": 3400, "3,400": 3400, "12 345 678": 12345678,
    "3 400": 400,                 # only the plain space groups digits
    "99 Kč": None, "0": None, "000": None, "0.000": None, "1234567": 123456, "byt 54 m2, 1 200 Kč": 1200,
    "č.p. 1975 a 500": 1975, "": None, "1 2345": 2345, "12 3456": 123456 // 10, "007.500": 7500,
}


def amount_by_rule(text):
    found = re.search(r"\d{1,3}(?:[ .,]\d{3})+|\d{3,6}", text)
    value = int(re.sub("[ .,]", "", found.group())) if found else 0
    return value or None


def test_amounts(spark):
    assert column(spark, list(AMOUNTS), "string", X.first_amount) == [amount_by_rule(t) for t in AMOUNTS]
    assert amount_by_rule("3 400") == 400 and amount_by_rule("12 3456") == 12345


CLAUSES = {
    "a + b;c\nd": ["a ", " b", "c", "d"],
    "nájem plus energie PLUS voda": ["nájem ", " energie ", " voda"],
    "surplus plusová": ["surplus plusová"],
    "3,400 Kč, kauce": ["3,400 Kč", "kauce"],
    "Byt je hezký. Poplatky 5": ["Byt je hezký", "Poplatky 5"],
    "el. energie": ["el", "energie"],          # upper and lower case are not told apart
    "BYT KČ. další": ["BYT KČ", "další"],
    "rok 1975. Dům": ["rok 1975. Dům"],
    "a, b": ["a", "b"],
    "": [""],
}


def test_clauses(spark):
    assert column(spark, list(CLAUSES), "string", X.split_clauses) == list(CLAUSES.values())
    assert column(spark, [None], "string", X.split_clauses) == [[""]]


FEES = [
    # cost field, description, fees, source, electricity
    ("3400", "energie 900", 3400, "field", None),
    (" +34 ", "poplatky 900", 34, "field", None),
    ("3_400", None, 3400, "field", None),
    ("0", None, None, None, None),
    ("-500", None, 500, "field", None),
    ("3 400", None, 3400, "field", None),
    ("3 400 Kč", None, 400, "field", None),
    ("+ poplatky 3.400 Kč + el. energie + vratná kauce 20 000 + provize RK", "energie 700", 3400, "field", None),
    ("4800 Kč plus elektřina 1200 Kč", "poplatky 99999", 4800, "field", 1200),
    ("energie 800 Kč", "Služby 2 000 Kč, energie 500", 2000, "text", 800),
    (None, "Kauce a poplatky 9 000 Kč", None, None, None),
    (None, "Poplatky a energie 3 100 Kč", 3100, "text", 3100),
    (None, "Poplatky dle dohody, služby 1 500", 1500, "text", None),
    ("", "cena 15 000 Kč měsíčně", None, None, None),
    (None, None, None, None, None),
    ("dohodou", "FOND OPRAV 1 234", 1234, "text", None),
]


def test_fees(spark):
    df = spark.createDataFrame([(i, *row[:2]) for i, row in enumerate(FEES)], "i int, f string, d string")
    got = costs.with_fees(df, "f", "d").orderBy("i").select("fees_czk", "fees_source", "electricity_explicit").collect()
    assert [tuple(r) for r in got] == [row[2:] for row in FEES]


def test_null_price_differs_by_path(spark):
    df = spark.createDataFrame([("pronajem", None), ("prodej", None), ("pronajem", 0)], "tx string, p bigint")
    none = F.lit(None).cast("bigint")
    main = df.select(*[v.alias(n) for n, v in costs.breakdown(F.col("p"), none, F.col("tx"), none, 1500).items()]).collect()
    assert [(r.electricity_czk, r.electricity_estimated, r.total_czk) for r in main] == [(1500, True, None), (None, False, None), (1500, True, 1500)]
    other = df.select(*[v.alias(n) for n, v in costs.finalize(F.col("p"), none, F.col("tx"), F.lit(50.0), 1500).items()]).collect()
    assert [(r.electricity_czk, r.electricity_estimated, r.total_czk) for r in other] == [(None, False, None), (None, False, None), (None, False, 0)]


def test_rounding_is_half_even(spark):
    assert column(spark, [2.5, 3.5, -2.5, 2.4, 0.5], "double", costs.half_even) == [2, 4, -2, 2, 0]


def test_sample_invariants(spark):
    df = spark.createDataFrame([(20400, 33.0), (8790000, 53.0), (23400, 51.0), (5, 0.0), (0, 5.0)], "t bigint, a double")
    got = [r.v for r in df.select(costs.per_sqm(F.col("t"), F.col("a")).alias("v")).collect()]
    assert got == [618, 165849, 459, None, None]


def test_money(spark):
    assert column(spark, [None, 0, 1234567, -1500], "bigint", X.money) == ["—", "0 Kč", "1 234 567 Kč", "-1 500 Kč"]


def test_url_pieces(spark):
    assert column(spark, ["1+kk", "6 a více", "a/b*~"], "string", X.url_quote) == ["1%2Bkk", "6%20a%20v%C3%ADce", "a/b%2A~"]
    assert column(spark, ["https://x/1", "https://x/12/", "https://x/12/a", " /7 "], "string", X.listing_id_from_url) == ["1", "12", None, "7"]
    assert column(spark, ["https://x/a/b//", "b"], "string", X.last_path_segment) == ["b", "b"]
    assert column(spark, ["//a", "", None, "https://b"], "string", html.absolute_url) == ["https://a", None, None, "https://b"]


def test_tristate(spark):
    values = ["true", "false", "null", "0", "2", '""', '"no"', "[]", "[1]", "{}", '{"a":1}', "0.0", "1.5"]
    df = spark.createDataFrame([(i, f'{{"v":{v}}}') for i, v in enumerate([*values, "1"])], "i int, j string")
    v = F.try_variant_get(F.parse_json("j"), "$.v", "variant")
    got = [r.t for r in df.orderBy("i").select(costs.tristate(v).alias("t")).collect()]
    assert got[:-1] == [True, False, None, False, True, False, True, False, True, False, True, False, True]
    missing = spark.createDataFrame([("{}",)], "j string").select(costs.tristate(F.try_variant_get(F.parse_json("j"), "$.v", "variant")).alias("t"))
    assert missing.first().t is None


def test_cost_lines(spark):
    df = spark.createDataFrame(
        [("pronajem", 100, None, True, None, 1500, True, 1600, None), ("pronajem", 100, 50, False, "text", 70, False, 220, 900),
         ("prodej", 500, 9, False, None, None, False, 500, 3)],
        "transaction_type string, price_czk bigint, fees_czk bigint, fees_missing boolean, fees_source string, "
        "electricity_czk bigint, electricity_estimated boolean, total_czk bigint, admin_fee_czk bigint",
    )
    got = [[tuple(line) for line in r.lines] for r in df.select(costs.cost_lines().alias("lines")).collect()]
    rent, fees, power, total = "Nájem (net)", "Poplatky / služby", "Elektřina", "Celkem (s elektřinou)"
    once = "Administrativní poplatek (jednorázově)"
    assert got == [
        [(rent, 100, None), (fees, None, "neuvedeno listingem"), (power, 1500, "odhad"), (total, 1600, C.FEES_AS_ZERO)],
        [(rent, 100, None), (fees, 50, "z popisu"), (power, 70, C.ELECTRICITY_STATED), (total, 220, None), (once, 900, None)],
        [("Cena", 500, None), (once, 3, None)],
    ]


def test_map_layer_precedence(spark):
    df = spark.createDataFrame([(True, True, "pronajem"), (False, True, "prodej"), (None, None, "pronajem"), (False, False, "prodej")], "a boolean, w boolean, t string")
    got = [r.l for r in df.select(marts.map_layer(F.col("a"), F.col("w"), F.col("t")).alias("l")).collect()]
    assert got == ["approx", "watched", "rent", "sale"]


@pytest.mark.parametrize("seed", range(3))
def test_stats_equal_the_plain_ones(spark, seed):
    rng = random.Random(seed)
    groups = {
        "hot": [rng.choice([5, 6, 7_000_000, rng.randint(1, 10**10)]) for _ in range(900)],
        "even": [2, 3], "odd": [7, 1 << 20, (1 << 20) + 1], "one": [9], "edge": [(1 << 20) - 1, 1 << 20], "none": [],
    }
    rows = [(g, v) for g, values in groups.items() for v in [*values, None, 0]]
    df = spark.createDataFrame(rows, "transaction_type string, v bigint")
    got = {r.transaction_type: (r.median_per_sqm, r.avg_per_sqm, r.n) for r in stats.price_stats(df, ["transaction_type"], "v").collect()}
    want = {g: (round(statistics.median(v)), round(statistics.mean(v)), len(v)) for g, v in groups.items() if v}
    assert got == want
    wide = stats.wide_stats(stats.price_stats(df, ["transaction_type"], "v"), [], names={"even": "e", "none": "x"}).first()
    assert (wide.e_median_czk_per_sqm, wide.e_avg_czk_per_sqm, wide.e_count) == (2, 2, 2)
    assert (wide.x_median_czk_per_sqm, wide.x_avg_czk_per_sqm, wide.x_count) == (None, None, 0)


def test_stats_of_nothing(spark):
    df = spark.createDataFrame([], "transaction_type string, v bigint")
    row = stats.wide_stats(stats.price_stats(df, ["transaction_type"], "v"), []).first()
    assert tuple(row) == (None, None, 0, None, None, 0)


def test_near_centres_equals_brute_force(spark):
    rng = random.Random(7)
    spots = [(50.1, 14.5), (0.0, 179.995), (-89.99, 10.0), (89.995, -170.0), (60.0, -180.0)]
    points = []
    for i in range(600):
        lat, lon = rng.choice(spots)
        lat = max(-90.0, min(90.0, lat + rng.uniform(-0.03, 0.03)))
        lon = (lon + rng.uniform(-0.06, 0.06) * (1 if abs(lat) < 80 else 1500) + 180) % 360 - 180
        points.append((str(i), lat, lon))
    centres = [(n, lat, lon) for n, (lat, lon) in enumerate(spots)] + [(9, 50.1, 14.5), (10, 50.11, 14.51)]
    p = spark.createDataFrame(points, "listing_key string, lat double, lon double")
    c = spark.createDataFrame(centres, "centre_id int, centre_lat double, centre_lon double")
    got = {(r.listing_key, r.centre_id) for r in near_centres(p, c, 2.0).collect()}
    km = geo.distance_km(F.col("centre_lat"), F.col("centre_lon"), F.col("lat"), F.col("lon"))
    every = p.crossJoin(c).withColumn("km", km).where("km <= 2").collect()
    best = {}
    for r in sorted(every, key=lambda r: (r.km, r.centre_id)):
        best.setdefault(r.listing_key, r.centre_id)
    assert got == set(best.items()) and len(got) > 100


def test_radius_box_loses_nothing(spark):
    rng = random.Random(1)
    rows = [(50.10444 + rng.uniform(-0.03, 0.03), 14.5065 + rng.uniform(-0.05, 0.05)) for _ in range(500)] + [(None, 14.5), (50.1, None)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    lat0, lon0 = C.DEFAULTS.centre
    plain = df.where(geo.distance_km(F.lit(lat0), F.lit(lon0), F.col("lat"), F.col("lon")) <= 2).count()
    assert df.where(geo.within_radius(F.col("lat"), F.col("lon"), C.DEFAULTS.centre, 2.0)).count() == plain > 50


def test_fee_cap_boundaries(spark):
    got = column(spark, [None, 0, 5000, 5001], "bigint", lambda v: enrich.fee_within_cap(v, 5000))
    assert got == [True, True, True, False]


def test_change_note_precedence(spark):
    changes = spark.createDataFrame(
        [(1, "a", "price_change", 1, 2), (1, "b", "price_change", 1000, 2000), (1, "c", "new", None, None), (1, "d", "removed", None, None)],
        "run_seq bigint, listing_key string, kind string, old_total_czk bigint, new_total_czk bigint",
    )
    watched = spark.createDataFrame([(1, "a", 7, None)], "run_seq bigint, listing_key string, old_total_czk bigint, new_total_czk bigint")
    got = {r.listing_key: r.change_note for r in marts.change_notes(changes, watched).collect()}
    assert got == {"a": "Price changed: 7 Kč → —", "b": "Price changed: 1 000 Kč → 2 000 Kč", "c": "New listing since last check"}


def test_history_lines(spark):
    df = spark.createDataFrame(
        [("new", "1", "T", 1500, None, None), ("removed", "2", "", None, None, None), ("price_change", "3", None, None, 1, 2)],
        "kind string, k string, title string, shown bigint, old bigint, new bigint",
    )
    line = marts.history_line(*[F.col(c) for c in ("kind", "k", "title", "shown", "old", "new")])
    assert [r.l for r in df.select(line.alias("l")).collect()] == ["New: T — 1 500 Kč", "Gone: 2 — last seen at —", "#3: 1 Kč → 2 Kč"]


def test_no_python_in_hot_plans(spark):
    import __spark_entry__ as contract

    for name in ("snapshot_diff", "offers_from_json", "offers_from_nodes", "offers_from_cards", "amounts_in_text", "watch_carry_forward", "price_stats_rollup"):
        plan = contract.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "InPandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan, name
