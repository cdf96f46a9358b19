"""Coordinates, sources and completeness over customers, suppliers and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch import schemas
from offerwatch.catalog.tables import load
from offerwatch.functions.costs import half_even
from offerwatch.functions.geo import distance_km, within_radius
from offerwatch.operators import completeness, enrich
from offerwatch.operators.geo import near_centres
from offerwatch.plans import marts, monitor

LAT0, LON0 = C.DEFAULTS.centre
LABEL = C.DEFAULTS.locality_label
STREET = C.DEFAULTS.focus_street


def _located(spark, sf_dir):
    """Customers scattered around the centre; every eleventh lacks a coordinate."""
    customers = load(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    lat = F.lit(LAT0) + (key * 37 % 2000 - 1000) / 20000.0
    lon = F.lit(LON0) + (key * 91 % 2000 - 1000) / 12000.0
    return customers.select(
        F.col("c_custkey").cast("string").alias("listing_key"),
        "c_custkey",
        "c_nationkey",
        F.when(key % 11 != 0, lat).alias("lat"),
        F.when(key % 22 != 0, lon).alias("lon"),
        (key % 13 == 0).alias("is_focus_street"),
        F.lit(False).alias("approx_location"),
    )


LOCATED_SQL = f"""
located AS (
  SELECT CAST(c_custkey AS VARCHAR) AS listing_key, c_custkey, c_nationkey,
         CASE WHEN c_custkey % 11 <> 0 THEN CAST({LAT0} AS DOUBLE) + (c_custkey * 37 % 2000 - 1000) / CAST(20000 AS DOUBLE) END AS lat,
         CASE WHEN c_custkey % 22 <> 0 THEN CAST({LON0} AS DOUBLE) + (c_custkey * 91 % 2000 - 1000) / CAST(12000 AS DOUBLE) END AS lon,
         c_custkey % 13 = 0 AS is_focus_street
  FROM customer)"""


def _km_sql(lat1, lon1, lat2, lon2):
    """By the spherical law of cosines on unit vectors' chord, not the haversine of the library."""
    def axis(lat, lon):
        return (f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))")

    squares = " + ".join(f"pow(({a}) - ({b}), 2)" for a, b in zip(axis(lat1, lon1), axis(lat2, lon2), strict=True))
    return f"(2 * 6371 * asin(sqrt({squares}) / 2))"


def radius_filter(spark, sf_dir):
    rows = _located(spark, sf_dir)
    kept = rows.where(within_radius(F.col("lat"), F.col("lon"), C.DEFAULTS.centre, C.DEFAULTS.radius_km))
    far = distance_km(F.lit(LAT0), F.lit(LON0), F.col("lat"), F.col("lon"))
    return kept.select("listing_key", F.round(far, 4).alias("km"))


def radius_join(spark, sf_dir):
    key = F.col("n_nationkey")
    centres = load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("centre_id"),
        (F.lit(LAT0) + (key * 7 % 25 - 12) / 300.0).alias("centre_lat"),
        (F.lit(LON0) + (key * 11 % 25 - 12) / 200.0).alias("centre_lon"),
    )
    near = near_centres(_located(spark, sf_dir), centres, C.DEFAULTS.radius_km)
    return near.select("listing_key", "centre_id", F.round("distance_km", 4).alias("km"))


RADIUS_JOIN = f"""
WITH {LOCATED_SQL},
centres AS (SELECT n_nationkey AS centre_id, CAST({LAT0} AS DOUBLE) + (n_nationkey * 7 % 25 - 12) / CAST(300 AS DOUBLE) AS clat,
                   CAST({LON0} AS DOUBLE) + (n_nationkey * 11 % 25 - 12) / CAST(200 AS DOUBLE) AS clon FROM nation),
pairs AS (SELECT listing_key, centre_id, {_km_sql("clat", "clon", "lat", "lon")} AS km
          FROM located, centres WHERE lat IS NOT NULL AND lon IS NOT NULL)
SELECT listing_key, arg_min(centre_id, km) AS centre_id, round(min(km), 4) AS km
FROM pairs WHERE km <= 2 GROUP BY listing_key"""


def centroid_fill(spark, sf_dir):
    """Every nation is a run of its own."""
    filled = enrich.fill_coordinates(_located(spark, sf_dir), ["c_nationkey"])
    return filled.select(
        "listing_key", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "approx_location"
    )


FILLED_SQL = f"""{LOCATED_SQL},
means AS (
  SELECT c_nationkey, avg(lat) FILTER (lat <> 0 AND lon <> 0) AS mlat, avg(lon) FILTER (lat <> 0 AND lon <> 0) AS mlon,
         avg(lat) FILTER (lat <> 0 AND lon <> 0 AND is_focus_street) AS flat,
         avg(lon) FILTER (lat <> 0 AND lon <> 0 AND is_focus_street) AS flon
  FROM located GROUP BY 1),
filled AS (
  SELECT listing_key, c_custkey, lat IS NULL OR lon IS NULL AS approx,
         CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat WHEN is_focus_street THEN coalesce(flat, mlat, 50.1075) ELSE coalesce(mlat, 50.1075) END AS lat,
         CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon WHEN is_focus_street THEN coalesce(flon, mlon, 14.507) ELSE coalesce(mlon, 14.507) END AS lon
  FROM located JOIN means USING (c_nationkey))"""


def _map_items(spark, sf_dir):
    filled = enrich.fill_coordinates(_located(spark, sf_dir), ["c_nationkey"])
    key = F.col("c_custkey")
    return filled.select(
        "listing_key",
        F.when(key % 10 != 9, F.col("lat")).alias("lat"),
        "lon",
        "approx_location",
        (key % 50 == 7).alias("is_seed"),
        F.when(key % 2 == 0, "pronajem").otherwise("prodej").alias("transaction_type"),
        F.col("c_custkey").alias("ordinal"),
    )


def map_layers(spark, sf_dir):
    return marts.mart_map(_map_items(spark, sf_dir)).select("listing_key", "layer")


def map_center(spark, sf_dir):
    return marts.map_centre(_map_items(spark, sf_dir)).select(
        "listing_key", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


def multi_source_union(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("listing_key"), F.col("c_name").alias("title"),
        half_even(F.col("c_acctbal")).alias("price_czk"), F.lit(None).cast("boolean").alias("fees_missing"),
    )
    suppliers = load(spark, sf_dir, "supplier").select(
        F.concat(F.lit(C.CARD_KEY_PREFIX), F.col("s_suppkey").cast("string")).alias("listing_key"),
        F.lit(C.CARD_SOURCE).alias("source"), F.col("s_name").alias("title"),
        half_even(F.col("s_acctbal")).alias("price_czk"), (F.col("s_nationkey") < 12).alias("active"),
    )
    return monitor.union_sources(customers, suppliers).select(
        "listing_key", "source", "title", "price_czk", "fees_missing", "active", F.size("images").cast("bigint").alias("n_images")
    )


def completeness_gate(spark, sf_dir):
    """An order is a search, a line one of its pages."""
    lines = load(spark, sf_dir, "lineitem")
    pages = lines.select(
        "l_orderkey",
        F.col("l_linenumber").alias("page_no"),
        F.when(F.col("l_orderkey") % 9 != 0, F.col("l_orderkey") % 5 + 1).alias("total"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("page_offset"),
        F.lit(1).cast("bigint").alias("page_limit"),
        F.when(F.col("l_quantity") > 1, 1).otherwise(0).alias("n_results"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_quantity") > 49, "fatal").otherwise("ok")).otherwise("ok").alias("outcome"),
    )
    return completeness.search_completeness(pages, ["l_orderkey"])


COMPLETENESS_GATE = """
WITH p AS (
  SELECT l_orderkey, l_linenumber AS page_no, CASE WHEN l_orderkey % 9 <> 0 THEN l_orderkey % 5 + 1 END AS total,
         CASE WHEN l_quantity > 1 THEN 1 ELSE 0 END AS n_rows, l_returnflag = 'R' AND l_quantity > 49 AS is_fatal
  FROM lineitem)
SELECT l_orderkey, count(*) AS pages, CAST(sum(n_rows) AS BIGINT) AS rows_seen, max(total) AS total,
       bool_or(is_fatal) AS fatal,
       min(n_rows) > 0 AND NOT bool_or(is_fatal) AND max(page_no) >= coalesce(max(total), 0)
         AND count(DISTINCT page_no) = count(*) AND max(page_no) = count(*) AS complete
FROM p GROUP BY 1"""


def detail_enrich(spark, sf_dir):
    """Customers as search results, each one's last order as its detail page."""
    key = F.col("c_custkey")
    found = load(spark, sf_dir, "customer").select(
        F.lit("r1").alias("run_id"),
        F.lit(1).cast("bigint").alias("run_seq"),
        F.col("c_custkey").cast("string").alias("listing_key"),
        F.when(key % 3 != 0, "pronajem").otherwise("prodej").alias("transaction_type"),
        F.when(key % 17 != 0, half_even(F.col("c_acctbal"))).alias("price_czk"),
        F.when(key % 17 != 0, half_even(F.col("c_acctbal"))).alias("total_czk"),
        F.when(key % 4 != 0, 50.0).alias("lat"),
        F.when(key % 4 != 0, 14.0).alias("lon"),
        F.when(key % 5 == 0, 0.0).when(key % 5 != 1, 55.0).alias("floor_area_sqm"),
        F.lit(7).cast("bigint").alias("price_czk_per_sqm"),
        F.array(F.lit("old")).alias("images"),
    )
    orders = load(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("o"))
    order = F.col("o.o_orderkey")
    rules = order % 7
    details = last.select(
        F.lit("r1").alias("run_id"),
        F.lit(1).cast("bigint").alias("run_seq"),
        F.col("o_custkey").cast("string").alias("listing_key"),
        F.when(rules == 0, "gone").when(rules == 1, "transient").when(rules == 2, "unreadable").otherwise("ok").alias("outcome"),
        F.when(order % 2 == 0, F.concat(F.lit("order "), order.cast("string"))).alias("description"),
        F.lit("seller").alias("seller_name"),
        F.when(order % 3 == 0, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")).alias("images"),
        F.lit(None).cast("string").alias("thumb"),
        F.when(order % 5 != 0, 51.0).alias("lat"),
        F.when(order % 5 != 0, 15.0).alias("lon"),
        F.when(order % 4 != 0, 40.0).alias("floor_area_sqm"),
        F.lit(3).alias("floor_number"),
        F.lit(8).alias("floors_total"),
        F.when(order % 3 != 0, half_even(F.col("o.o_totalprice") / 100)).alias("fees_czk"),
        F.when(order % 3 != 0, "field").alias("fees_source"),
        F.when(order % 11 == 0, F.lit(800).cast("bigint")).alias("electricity_explicit"),
        F.lit(True).alias("garage"),
        F.lit(None).cast("boolean").alias("parking"),
    )
    return enrich.enrich(found, details).select(
        "listing_key", "description", "seller_name", F.array_join("images", ",").alias("images"), "lat", "lon",
        "floor_area_sqm", F.col("floor_number").cast("bigint").alias("floor_number"), "fees_czk", "fees_missing",
        "electricity_czk", "electricity_estimated", "total_czk", "price_czk_per_sqm", "garage", "enrich_failed",
    )


DETAIL_ENRICH = """
WITH last AS (
  SELECT o_custkey, max(o_orderkey) AS ok, arg_max(o_totalprice, o_orderkey) AS total FROM orders GROUP BY 1),
s AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS listing_key, c_custkey % 3 <> 0 AS rent,
         CASE WHEN c_custkey % 17 <> 0 THEN CAST(round_even(c_acctbal, 0) AS BIGINT) END AS price,
         CASE WHEN c_custkey % 5 = 0 THEN 0.0 WHEN c_custkey % 5 <> 1 THEN 55.0 END::DOUBLE AS area, ok, total,
         ok IS NOT NULL AND ok % 7 > 2 AS was_read
  FROM customer LEFT JOIN last ON o_custkey = c_custkey),
d AS (
  SELECT *, CASE WHEN was_read AND ok % 3 <> 0 THEN CAST(round_even(total / 100, 0) AS BIGINT) END AS fees,
         CASE WHEN was_read AND rent THEN CASE WHEN ok % 11 = 0 THEN 800 ELSE 1500 END END AS power,
         CASE WHEN was_read AND coalesce(area, 0) = 0 AND ok % 4 <> 0 THEN 40.0 ELSE area END AS area2
  FROM s WHERE ok IS NULL OR ok % 7 <> 0),
t AS (SELECT *, price + CASE WHEN was_read AND rent THEN coalesce(fees, 0) + power ELSE 0 END AS all_in FROM d)
SELECT listing_key,
       CASE WHEN was_read AND ok % 2 = 0 THEN 'order ' || ok END AS description,
       CASE WHEN was_read THEN 'seller' END AS seller_name,
       CASE WHEN was_read AND ok % 3 = 0 THEN 'new' ELSE 'old' END AS images,
       CASE WHEN k % 4 <> 0 THEN 50.0 WHEN was_read AND ok % 5 <> 0 THEN 51.0 END::DOUBLE AS lat,
       CASE WHEN k % 4 <> 0 THEN 14.0 WHEN was_read AND ok % 5 <> 0 THEN 15.0 END::DOUBLE AS lon,
       area2::DOUBLE AS floor_area_sqm, CASE WHEN was_read THEN CAST(3 AS BIGINT) END AS floor_number,
       fees AS fees_czk, CASE WHEN was_read THEN fees IS NULL ELSE true END AS fees_missing,
       CAST(power AS BIGINT) AS electricity_czk, was_read AND rent AND ok % 11 <> 0 AS electricity_estimated,
       CAST(all_in AS BIGINT) AS total_czk,
       CASE WHEN was_read AND rent AND coalesce(all_in, 0) <> 0 AND coalesce(area2, 0) <> 0
            THEN CAST(round_even(all_in / CAST(area2 AS DOUBLE), 0) AS BIGINT) ELSE 7 END AS price_czk_per_sqm,
       CASE WHEN was_read THEN true END AS garage, CASE WHEN ok IS NULL OR ok % 7 = 1 THEN true END AS enrich_failed
FROM t"""


def fee_cap(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select(
        F.lit("r1").alias("run_id"), F.lit(1).cast("bigint").alias("run_seq"),
        F.col("c_custkey").cast("string").alias("listing_key"), F.col("c_name").alias("description"),
    )
    orders = load(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("o"))
    details = last.select(
        F.lit("r1").alias("run_id"), F.lit(1).cast("bigint").alias("run_seq"),
        F.col("o_custkey").cast("string").alias("listing_key"),
        F.when(F.col("o.o_orderkey") % 4 != 0, half_even(F.col("o.o_totalprice") / 40)).alias("admin_fee_czk"),
        F.when(F.col("o.o_orderkey") % 3 == 0, "").when(F.col("o.o_orderkey") % 3 == 1, "text").alias("description"),
    )
    kept = enrich.add_details(schemas.conform(customers), details)
    return kept.select("listing_key", "admin_fee_czk", "description")


QUERIES = {
    "radius_filter": radius_filter,
    "radius_join": radius_join,
    "centroid_fill": centroid_fill,
    "map_layers": map_layers,
    "map_center": map_center,
    "multi_source_union": multi_source_union,
    "completeness_gate": completeness_gate,
    "detail_enrich": detail_enrich,
    "fee_cap": fee_cap,
}

ORACLES = {
    "radius_filter": f"""
        WITH {LOCATED_SQL}, d AS (SELECT listing_key, {_km_sql(LAT0, LON0, "lat", "lon")} AS km FROM located)
        SELECT listing_key, round(km, 4) AS km FROM d WHERE km <= 2""",
    "radius_join": RADIUS_JOIN,
    "centroid_fill": f"""
        WITH {FILLED_SQL}
        SELECT listing_key, round(lat, 6) AS lat, round(lon, 6) AS lon, approx AS approx_location FROM filled""",
    "map_layers": f"""
        WITH {FILLED_SQL}
        SELECT listing_key, CASE WHEN approx THEN 'approx' WHEN c_custkey % 50 = 7 THEN 'watched'
                                 WHEN c_custkey % 2 = 0 THEN 'rent' ELSE 'sale' END AS layer
        FROM filled WHERE c_custkey % 10 <> 9""",
    "map_center": f"""
        WITH {FILLED_SQL}
        SELECT listing_key, round(lat, 6) AS lat, round(lon, 6) AS lon FROM filled WHERE c_custkey % 10 <> 9
        ORDER BY c_custkey % 50 <> 7, c_custkey LIMIT 1""",
    "multi_source_union": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS listing_key, '{C.MAIN_SOURCE}' AS source, c_name AS title,
               CAST(round_even(c_acctbal, 0) AS BIGINT) AS price_czk, NULL::BOOLEAN AS fees_missing, true AS active, CAST(0 AS BIGINT) AS n_images
        FROM customer
        UNION ALL
        SELECT '{C.CARD_KEY_PREFIX}' || s_suppkey, '{C.CARD_SOURCE}', s_name, CAST(round_even(s_acctbal, 0) AS BIGINT), true, s_nationkey < 12, 0
        FROM supplier""",
    "completeness_gate": COMPLETENESS_GATE,
    "detail_enrich": DETAIL_ENRICH,
    "fee_cap": """
        WITH last AS (SELECT o_custkey, max(o_orderkey) AS ok, arg_max(o_totalprice, o_orderkey) AS total FROM orders GROUP BY 1),
        f AS (SELECT CAST(c_custkey AS VARCHAR) AS listing_key, c_name, ok,
                     CASE WHEN ok % 4 <> 0 THEN CAST(round_even(total / 40, 0) AS BIGINT) END AS fee
              FROM customer LEFT JOIN last ON o_custkey = c_custkey)
        SELECT listing_key, fee AS admin_fee_czk, CASE WHEN ok % 3 = 1 THEN 'text' ELSE c_name END AS description
        FROM f WHERE coalesce(fee, 0) <= 5000""",
}
