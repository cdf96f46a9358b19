"""Pages and searches of the sorted listings, over all parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.catalog.tables import load
from offerwatch.plans.serving import Serving
from offerwatch.session import work_dir

SOURCES = list(C.SOURCE_BADGES)
#: Needles of one letter and more, with letters that mean something in patterns, in either case, and one that nothing holds.
NEEDLES = ("g", "_1", "#1", "t g", "RING", "small ring", "Žiž", "nd#25", "nowhere")

#: More than one even of the smallest table, so that pages go over their ends.
RANGES = 12


def _served(spark, sf_dir, name) -> Serving:
    """Parts as listings: many ties and nulls in the default order, names, brands and nations as texts."""
    part, nation = load(spark, sf_dir, "part"), load(spark, sf_dir, "nation")
    k = F.col("p_partkey")
    mart = part.join(nation, F.col("p_size") == F.col("n_nationkey"), "left").select(
        k.cast("string").alias("listing_key"), k.alias("ordinal"),
        F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("bigint")).alias("price_czk_per_sqm"),
        F.when(k % 2 == 0, C.RENT).otherwise(C.SALE).alias("transaction_type"), F.col("p_type").alias("disposition"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (k % 3 + 1).cast("int")).alias("source"), (k % 5 < 4).alias("is_focus_street"),
        F.when(k % 4 == 0, F.concat("p_name", F.lit(" Žižkov"))).otherwise(F.col("p_name")).alias("title"),
        F.when(k % 9 > 0, F.col("p_brand")).otherwise("").alias("city_part"), F.col("n_name").alias("locality"),
    )
    serving = Serving(spark, work_dir(spark, name), ["price_czk_per_sqm", "ordinal"])
    serving.write(mart, ranges=RANGES)
    return serving


def keyset_pages(spark, sf_dir):
    """The whole order page by page, each from the last row of the one before: upwards all rows, downwards those of four facets."""
    serving = _served(spark, sf_dir, "pages")
    rows = serving.rows().count()
    facets = (F.col("transaction_type") == C.RENT) & (F.col("disposition") == "ECONOMY") & (F.col("source") == SOURCES[0]) & F.col("is_focus_street")
    pages: list[DataFrame] = []
    for direction, size, where in (("up", rows // 4 + 1, None), ("down", rows // 100 + 1, facets)):
        after, number = None, 0
        while True:
            page = serving.page(size, after, direction == "down", where)
            place = F.struct(*serving.order)
            end = page.agg((F.min(place) if direction == "down" else F.max(place)).alias("place")).first()["place"]
            if end is None:
                break
            pages.append(page.select(F.lit(direction).alias("direction"), F.lit(number).alias("page"), "listing_key", "price_czk_per_sqm"))
            after, number = end, number + 1
    return reduce(DataFrame.unionByName, pages)


def substring_search(spark, sf_dir):
    serving = _served(spark, sf_dir, "search")
    found = [serving.search(needle).select(F.lit(needle).alias("needle"), "listing_key", "title") for needle in NEEDLES]
    return reduce(DataFrame.unionByName, found)


SERVED_SQL = f"""
mart AS (
  SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS listing_key, CASE WHEN p_size % 7 > 0 THEN CAST(p_size AS BIGINT) END AS price_czk_per_sqm,
         p_partkey % 2 = 0 AND p_type = 'ECONOMY' AND p_partkey % 3 = 0 AND p_partkey % 5 < 4 AS wanted,
         CASE WHEN p_partkey % 4 = 0 THEN p_name || ' Žižkov' ELSE p_name END AS title,
         CASE WHEN p_partkey % 9 > 0 THEN p_brand ELSE '' END AS city_part, n_name AS locality
  FROM part LEFT JOIN nation ON n_nationkey = p_size)"""

QUERIES = {"keyset_pages": keyset_pages, "substring_search": substring_search}

ORACLES = {
    "keyset_pages": f"""
        WITH {SERVED_SQL},
        total AS (SELECT count(*) AS n FROM mart)
        SELECT 'up' AS direction, (row_number() OVER (ORDER BY price_czk_per_sqm NULLS FIRST, k) - 1) // (n // 4 + 1) AS page, listing_key, price_czk_per_sqm
        FROM mart, total
        UNION ALL
        SELECT 'down', (row_number() OVER (ORDER BY price_czk_per_sqm DESC NULLS LAST, k DESC) - 1) // (n // 100 + 1), listing_key, price_czk_per_sqm
        FROM mart, total WHERE wanted""",
    "substring_search": f"""
        WITH {SERVED_SQL}
        SELECT needle, listing_key, title
        FROM mart JOIN (VALUES {", ".join(f"('{n}')" for n in NEEDLES)}) v(needle)
          ON contains(lower(title), lower(needle)) OR contains(lower(city_part), lower(needle)) OR contains(lower(locality), lower(needle))""",
}
