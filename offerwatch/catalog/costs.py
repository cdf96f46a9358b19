"""Costs and price statistics over orders and line items; facets over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerwatch.catalog.tables import load, money_sql
from offerwatch.functions import costs
from offerwatch.functions import text as X
from offerwatch.operators import stats
from offerwatch.plans import marts

ESTIMATE = 1500


def _unit_prices(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    unit = costs.per_sqm(F.col("l_extendedprice"), F.col("l_quantity"))
    return lines.select(
        F.col("l_returnflag").alias("transaction_type"), F.col("l_linestatus").alias("disposition"),
        unit.alias("price_czk_per_sqm"),
    )


def price_stats_wide(spark, sf_dir):
    found = stats.price_stats(_unit_prices(spark, sf_dir), ["transaction_type"], "price_czk_per_sqm")
    return stats.wide_stats(found, [], names={"A": "a", "N": "n", "R": "r", "none": "none"})


def price_stats_rollup(spark, sf_dir):
    by = ["transaction_type", "disposition"]
    return stats.price_stats(_unit_prices(spark, sf_dir), by, "price_czk_per_sqm", levels=[by, by[:1]])


UNIT_SQL = """
unit AS (
  SELECT l_returnflag AS tx, l_linestatus AS disposition,
         CAST(round_even(l_extendedprice / nullif(l_quantity, 0), 0) AS BIGINT) AS v
  FROM lineitem WHERE l_extendedprice <> 0 AND l_quantity <> 0),
kept AS (SELECT * FROM unit WHERE v <> 0)"""


def _wide(flag, name):
    return f"""CAST(round_even(median(v) FILTER (tx = '{flag}'), 0) AS BIGINT) AS {name}_median_czk_per_sqm,
       CAST(round_even(avg(v) FILTER (tx = '{flag}'), 0) AS BIGINT) AS {name}_avg_czk_per_sqm,
       count(v) FILTER (tx = '{flag}') AS {name}_count"""


def _priced_lines(spark, sf_dir):
    """Line items as offers: an open order is a rental, some lack fees, price or electricity."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"
    )
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    key = F.col("l_partkey")
    return joined.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.when(F.col("o_orderstatus") == "O", "pronajem").otherwise("prodej").alias("transaction_type"),
        F.when(key % 13 == 1, 0).when(key % 11 != 0, costs.half_even(F.col("l_extendedprice"))).alias("price_czk"),
        F.when(key % 5 != 0, costs.half_even(F.col("l_extendedprice") * F.col("l_tax"))).alias("fees"),
        F.when(key % 7 == 0, F.lit(900).cast("bigint")).alias("electricity_explicit"),
        F.when(key % 17 != 0, F.col("l_quantity")).alias("floor_area_sqm"),
    )


PRICED_SQL = """
priced AS (
  SELECT l_orderkey, l_partkey, l_linenumber,
         CASE WHEN o_orderstatus = 'O' THEN 'pronajem' ELSE 'prodej' END AS tx,
         CASE WHEN l_partkey % 13 = 1 THEN 0 WHEN l_partkey % 11 <> 0 THEN CAST(round_even(l_extendedprice, 0) AS BIGINT) END AS price,
         CASE WHEN l_partkey % 5 <> 0 THEN CAST(round_even(l_extendedprice * l_tax, 0) AS BIGINT) END AS fees,
         CASE WHEN l_partkey % 7 = 0 THEN 900 END AS explicit,
         CASE WHEN l_partkey % 17 <> 0 THEN l_quantity END AS area
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def cost_breakdown(spark, sf_dir):
    rows = _priced_lines(spark, sf_dir)
    cost = costs.breakdown(
        F.col("price_czk"), F.col("fees"), F.col("transaction_type"), F.col("electricity_explicit"), ESTIMATE
    )
    out = rows.select("*", *[v.alias(n) for n, v in cost.items()])
    sale_figure = costs.per_sqm(F.col("price_czk"), F.col("floor_area_sqm"))
    rent_figure = costs.per_sqm(F.col("total_czk"), F.col("floor_area_sqm"))
    return out.select(
        "l_orderkey", "l_partkey", "l_linenumber", "fees_missing", "electricity_czk", "electricity_estimated", "total_czk",
        F.when(F.col("transaction_type") == "pronajem", F.coalesce(rent_figure, sale_figure)).otherwise(sale_figure).alias("price_czk_per_sqm"),
    )


COST_BREAKDOWN = f"""
WITH {PRICED_SQL},
totals AS (
  SELECT *, CASE WHEN tx = 'pronajem' THEN coalesce(explicit, {ESTIMATE}) END AS electricity,
         CASE WHEN tx = 'pronajem' THEN price + coalesce(fees, 0) + coalesce(explicit, {ESTIMATE}) ELSE price END AS total
  FROM priced)
SELECT l_orderkey, l_partkey, l_linenumber, fees IS NULL AS fees_missing, CAST(electricity AS BIGINT) AS electricity_czk,
       tx = 'pronajem' AND explicit IS NULL AS electricity_estimated, CAST(total AS BIGINT) AS total_czk,
       CAST(round_even(coalesce(nullif(CASE WHEN tx = 'pronajem' THEN total END, 0), nullif(price, 0)) / nullif(area, 0), 0) AS BIGINT) AS price_czk_per_sqm
FROM totals"""


def finalize_costs(spark, sf_dir):
    rows = _priced_lines(spark, sf_dir)
    cost = costs.finalize(
        F.col("price_czk"), F.col("fees"), F.col("transaction_type"), F.col("floor_area_sqm"), ESTIMATE
    )
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", *[v.alias(n) for n, v in cost.items()])


FINALIZE_COSTS = f"""
WITH {PRICED_SQL},
totals AS (
  SELECT *, tx = 'pronajem' AND coalesce(price, 0) <> 0 AS billed FROM priced),
summed AS (
  SELECT *, CASE WHEN billed THEN price + coalesce(fees, 0) + {ESTIMATE} ELSE price END AS total FROM totals)
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN billed THEN CAST({ESTIMATE} AS BIGINT) END AS electricity_czk,
       billed AS electricity_estimated, CAST(total AS BIGINT) AS total_czk,
       CASE WHEN total <> 0 AND area <> 0 THEN CAST(round_even(total / area, 0) AS BIGINT) END AS price_czk_per_sqm
FROM summed"""


def facet_search_sort(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    mart = part.select(
        F.col("p_partkey").cast("string").alias("listing_key"), F.col("p_name").alias("title"),
        F.col("p_type").alias("transaction_type"), F.col("p_brand").alias("disposition"),
        F.col("p_retailprice").alias("price_czk"), F.col("p_partkey").alias("ordinal"),
        (F.col("p_size") > 5).alias("is_focus_street"),
    )
    return marts.query_listings(
        mart, tx="ECONOMY", focus_only=True, text="RING", sort_key="price_czk", descending=True, text_columns=("title",)
    )


def money_format(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    price = costs.half_even(F.col("o_totalprice"))
    key = F.col("o_orderkey")
    return orders.select(
        "o_orderkey",
        X.money(F.when(key % 7 != 0, price)).alias("money"),
        costs.shown_total(
            F.when(key % 3 == 0, price), F.when(key % 7 != 0, price + 1),
            F.when(F.col("o_orderstatus") == "O", "pronajem").otherwise("prodej"), key % 2 == 0,
        ).alias("shown"),
    )


MONEY_FORMAT = f"""
WITH p AS (SELECT *, CAST(round_even(o_totalprice, 0) AS BIGINT) AS price FROM orders),
q AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN price END AS plain,
             coalesce(CASE WHEN o_orderkey % 3 = 0 THEN price END, CASE WHEN o_orderkey % 7 <> 0 THEN price + 1 END) AS best FROM p)
SELECT o_orderkey, {money_sql("plain")} AS money,
       {money_sql("best")} || CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN '*' ELSE '' END AS shown
FROM q"""


QUERIES = {
    "price_stats_wide": price_stats_wide,
    "price_stats_rollup": price_stats_rollup,
    "cost_breakdown": cost_breakdown,
    "finalize_costs": finalize_costs,
    "facet_search_sort": facet_search_sort,
    "money_format": money_format,
}

ORACLES = {
    "price_stats_wide": f"WITH {UNIT_SQL} SELECT {_wide('A', 'a')}, {_wide('N', 'n')}, {_wide('R', 'r')}, {_wide('none', 'none')} FROM kept",
    "price_stats_rollup": f"""
        WITH {UNIT_SQL}
        SELECT tx AS transaction_type, disposition, CAST(2 AS BIGINT) AS grain,
               CAST(round_even(median(v), 0) AS BIGINT) AS median_per_sqm,
               CAST(round_even(avg(v), 0) AS BIGINT) AS avg_per_sqm, count(*) AS n
        FROM kept GROUP BY tx, disposition
        UNION ALL
        SELECT tx, NULL, 1, CAST(round_even(median(v), 0) AS BIGINT), CAST(round_even(avg(v), 0) AS BIGINT), count(*)
        FROM kept GROUP BY tx""",
    "cost_breakdown": COST_BREAKDOWN,
    "finalize_costs": FINALIZE_COSTS,
    "facet_search_sort": """
        SELECT CAST(p_partkey AS VARCHAR) AS listing_key, p_name AS title, p_type AS transaction_type,
               p_brand AS disposition, p_retailprice AS price_czk, p_partkey AS ordinal, true AS is_focus_street
        FROM part WHERE p_type = 'ECONOMY' AND p_size > 5 AND p_name ILIKE '%ring%'
        ORDER BY p_retailprice DESC, p_partkey""",
    "money_format": MONEY_FORMAT,
}
