"""The three portals' pages, built from driver tables and read back by the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.catalog.tables import dealt, load
from offerwatch.functions.costs import half_even
from offerwatch.operators import enrich
from offerwatch.plans import monitor
from offerwatch.sources import card_portal, main_portal, node_portal
from offerwatch.sources.pages import in_region

PER_PAGE = 20
LABEL = C.DEFAULTS.locality_label
STREET = C.DEFAULTS.focus_street


def _embedded(state: Column) -> Column:
    return F.concat(
        F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script></html>")
    )


def _query_page(key: str, data: Column) -> Column:
    """A page whose second query is the wanted one."""
    queries = F.concat(
        F.lit('{"props":{"pageProps":{"dehydratedState":{"queries":[{"queryKey":["other"],"state":{"status":"success","data":[1]}},'
              f'{{"queryKey":["{key}",{{"page":1}}],"state":{{"status":"success","data":'),
        data,
        F.lit("}}]}}}}"),
    )
    return _embedded(queries)


def _landed(df: DataFrame, source: str, kind: str, **columns: Column) -> DataFrame:
    """Rows in the landed-page schema; what is not given is null."""
    given = {
        "run_id": F.lit("r1"), "run_seq": F.lit(1).cast("bigint"), "source": F.lit(source), "kind": F.lit(kind),
        "status": F.lit(200), "page_no": F.lit(1), "tx": F.lit(C.RENT),
        "fetched_at": F.lit("2024-01-01").cast("timestamp"), **columns,
    }
    kinds = {"listing_key": "string", "url": "string", "page_no": "int", "status": "int"}
    names = ["run_id", "run_seq", "source", "kind", "tx", "page_no", "url", "listing_key", "status", "fetched_at", "body"]
    return df.select(*[given.get(n, F.lit(None)).cast(kinds[n]).alias(n) if n in kinds else given[n].alias(n) for n in names])


# ------------------------------------------------------------------ main portal


def _parts(spark, sf_dir) -> DataFrame:
    """Parts with a nation as their part of town, those of a page together."""
    part, nation = load(spark, sf_dir, "part"), load(spark, sf_dir, "nation")
    part = dealt(part.withColumn("_page", F.floor(F.col("p_partkey") / PER_PAGE)), "_page")
    return part.join(nation, part["p_size"] % 25 == nation["n_nationkey"], "left")


def _main_pages(spark, sf_dir) -> DataFrame:
    parts = _parts(spark, sf_dir)
    k = F.col("p_partkey")
    tx = F.when(F.floor(k / PER_PAGE) % 2 == 0, C.RENT).otherwise(C.SALE)
    code = F.when(k % 3 == 0, 2).when(k % 3 == 1, 4).otherwise(9)
    label = F.when(k % 3 == 0, "1+kk").when(k % 3 == 1, "2+kk").otherwise("3+kk")
    street = F.when(k % 5 == 0, STREET).when(k % 5 == 1, "").when(k % 5 != 2, F.col("n_name"))
    image_no = F.sequence(F.lit(1), (k % 8 + 1).cast("int"))
    images = F.transform(image_no, lambda i: F.struct(
        F.when(i == 2, F.lit("")).otherwise(F.concat(F.lit("//img/"), k.cast("string"), F.lit("-"), i.cast("string"))).alias("url")))
    place = F.struct(
        street.alias("street"), F.col("n_name").alias("cityPart"), F.lit("Praha").alias("city"),
        F.when(k % 7 != 0, 50 + (k % 100) / 1000).alias("latitude"), F.when(k % 14 != 0, 14 + (k % 90) / 1000).alias("longitude"),
    )
    result = F.struct(
        k.alias("id"),
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.when(k % 2 == 1, ",5 m²").otherwise(" m²")).alias("name"),
        F.when(k % 17 == 0, 0).otherwise(half_even(F.col("p_retailprice") * 20)).alias("priceCzk"),
        F.when(k % 6 == 0, F.lit(333).cast("bigint")).alias("priceCzkPerSqM"),
        F.struct(code.alias("value"), label.alias("name")).alias("categorySubCb"),
        place.alias("locality"),
        images.alias("images"),
    )
    # at most PER_PAGE results share a page
    pages = parts.groupBy(tx.alias("tx"), "_page").agg(
        F.array_sort(F.collect_list(F.struct(k.alias("k"), F.to_json(result).alias("json")))).alias("_results")
    )
    data = F.concat(
        F.lit('{"pagination":{"total":10,"offset":0,"limit":20},"results":['),
        F.array_join(F.transform("_results", lambda r: r["json"]), ","), F.lit("]}"),
    )
    region = F.when(F.col("_page") % 11 == 10, "Brno").otherwise(F.url_encode(F.lit(C.DEFAULTS.region)))
    search = _landed(
        pages, C.MAIN_SOURCE, "search", tx=F.col("tx"), page_no=F.col("_page") + 1,
        url=F.concat(F.lit("https://main.example/search?region="), region, F.lit("&page=1")),
        body=_query_page(C.SEARCH_QUERY, data),
    )

    n = F.floor("p_retailprice").cast("string")
    cost_field = (
        F.when(k % 4 == 0, n).when(k % 4 == 1, F.concat(F.lit("+ poplatky "), n, F.lit(" Kč + el. energie 800 Kč + vratná kauce 20 000 Kč")))
    )
    prose = F.when(k % 4 == 2, F.concat(F.lit("Hezký byt. Poplatky "), n, F.lit(" Kč měsíčně."))).when(k % 4 == 3, F.repeat(F.lit("ž"), 1300))
    detail = F.struct(
        prose.alias("description"),
        F.struct(F.when(k % 3 == 0, F.col("p_brand")).otherwise("").alias("name")).alias("seller"),
        F.struct(F.lit("office").alias("name")).alias("premise"),
        F.struct(F.lit(49.5).alias("latitude"), F.lit(13.5).alias("longitude")).alias("locality"),
        F.struct(
            cost_field.alias("costOfLiving"), F.lit(44).alias("floorArea"), (k % 9).alias("floorNumber"), F.lit(9).alias("floors"),
            F.when(k % 3 == 0, k % 2 == 0).alias("garage"), F.when(k % 3 == 1, (k % 2).cast("int")).alias("parkingLots"), F.lit(True).alias("parking"),
        ).alias("params"),
        F.when(k % 6 == 1, F.array(F.struct(F.lit("https://new/").alias("url")))).alias("images"),
    )
    status = F.when(k % 19 == 0, 404).when(k % 19 == 1, 500).otherwise(200)
    body = F.when(k % 19 == 2, "<html></html>").otherwise(_query_page(C.DETAIL_QUERY, F.to_json(detail)))
    details = _landed(parts, C.MAIN_SOURCE, "detail", listing_key=k, status=status, body=F.when(status == 200, body))
    return search.unionByName(details)


def offers_from_json(spark, sf_dir):
    pages = in_region(_main_pages(spark, sf_dir), C.DEFAULTS.region)
    listings = monitor.main_listings(main_portal.search_pages(pages), main_portal.details(pages))
    return listings.select(
        "listing_key", "title", "disposition", "transaction_type", "price_czk", "floor_area_sqm", "price_czk_per_sqm",
        "locality", "is_focus_street", "url", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "approx_location",
        F.size("images").cast("bigint").alias("n_images"), "thumb", F.length("description").cast("bigint").alias("description_chars"),
        "seller_name", F.col("floor_number").cast("bigint").alias("floor_number"), "fees_czk", "fees_missing", "fees_source",
        "electricity_czk", "electricity_estimated", "total_czk", "garage", "parking", "enrich_failed",
    )


OFFERS_FROM_JSON = f"""
WITH b AS (
  SELECT p.*, p_partkey AS k, n_name, (p_partkey // {PER_PAGE}) % 2 = 0 AS rent,
         CASE WHEN p_partkey % 17 <> 0 THEN CAST(round_even(p_retailprice * 20, 0) AS BIGINT) END AS price,
         p_size + CASE WHEN p_partkey % 2 = 1 THEN 0.5 ELSE 0 END AS area,
         p_partkey % 19 > 2 AS was_read, CAST(floor(p_retailprice) AS BIGINT) AS n,
         CASE p_partkey % 5 WHEN 0 THEN '{STREET}' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE n_name END AS street
  FROM part p LEFT JOIN nation ON n_nationkey = p_size % 25
  WHERE p_partkey % 3 <> 2 AND p_partkey % 19 <> 0 AND (p_partkey // {PER_PAGE}) % 11 <> 10),
c AS (
  SELECT *,
         CASE WHEN was_read AND k % 4 <> 3 THEN n END AS fees,
         CASE WHEN was_read THEN CASE k % 4 WHEN 2 THEN 'text' WHEN 3 THEN NULL ELSE 'field' END END AS src,
         CASE WHEN was_read AND rent THEN CASE WHEN k % 4 = 1 THEN 800 ELSE 1500 END END AS power,
         CASE WHEN k % 7 <> 0 THEN 50 + (k % 100) / CAST(1000 AS DOUBLE) WHEN was_read THEN 49.5 END::DOUBLE AS lat0,
         CASE WHEN k % 7 = 0 AND was_read THEN 13.5 WHEN k % 14 <> 0 THEN 14 + (k % 90) / CAST(1000 AS DOUBLE) END::DOUBLE AS lon0,
         CASE WHEN was_read AND k % 6 = 1 THEN 1 ELSE least(k % 8 + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END, 5) END AS n_images
  FROM b),
t AS (SELECT *, price + CASE WHEN was_read AND rent THEN coalesce(fees, 0) + power ELSE 0 END AS total FROM c),
m AS (SELECT avg(lat0) AS mlat, avg(lon0) AS mlon, avg(lat0) FILTER (k % 5 = 0) AS flat, avg(lon0) FILTER (k % 5 = 0) AS flon
      FROM t WHERE lat0 IS NOT NULL AND lon0 IS NOT NULL)
SELECT CAST(k AS VARCHAR) AS listing_key,
       p_name || ' ' || p_size || CASE WHEN k % 2 = 1 THEN ',5' || chr(160) || 'm²' ELSE ' m²' END AS title,
       CASE WHEN k % 3 = 0 THEN '1+kk' ELSE '2+kk' END AS disposition,
       CASE WHEN rent THEN 'pronajem' ELSE 'prodej' END AS transaction_type, price AS price_czk, CAST(area AS DOUBLE) AS floor_area_sqm,
       CASE WHEN was_read AND rent AND total <> 0 THEN CAST(round_even(total / CAST(area AS DOUBLE), 0) AS BIGINT)
            WHEN k % 6 = 0 THEN 333 ELSE CAST(round_even(price / CAST(area AS DOUBLE), 0) AS BIGINT) END AS price_czk_per_sqm,
       concat_ws(', ', street, n_name, 'Praha') AS locality, k % 5 = 0 AS is_focus_street,
       '{C.MAIN_DETAIL_URL}' || CASE WHEN rent THEN 'pronajem' ELSE 'prodej' END || '/byt/' || CASE WHEN k % 3 = 0 THEN '1' ELSE '2' END || '%2Bkk/x/' || k AS url,
       round(CASE WHEN lat0 IS NOT NULL AND lon0 IS NOT NULL THEN lat0 WHEN k % 5 = 0 THEN coalesce(flat, mlat) ELSE mlat END, 6) AS lat,
       round(CASE WHEN lat0 IS NOT NULL AND lon0 IS NOT NULL THEN lon0 WHEN k % 5 = 0 THEN coalesce(flon, mlon) ELSE mlon END, 6) AS lon,
       lat0 IS NULL OR lon0 IS NULL AS approx_location, CAST(n_images AS BIGINT) AS n_images,
       CASE WHEN was_read AND k % 6 = 1 THEN 'https://new/' ELSE 'https://img/' || k || '-1' END || '{C.THUMB_SUFFIX}' AS thumb,
       CASE WHEN was_read THEN CASE k % 4 WHEN 2 THEN length('Hezký byt. Poplatky  Kč měsíčně.') + length(CAST(n AS VARCHAR)) WHEN 3 THEN 1200 END END AS description_chars,
       CASE WHEN was_read THEN CASE WHEN k % 3 = 0 THEN p_brand ELSE 'office' END END AS seller_name,
       CASE WHEN was_read THEN k % 9 END AS floor_number, fees AS fees_czk, fees IS NULL AS fees_missing, src AS fees_source,
       CAST(power AS BIGINT) AS electricity_czk, was_read AND rent AND k % 4 <> 1 AS electricity_estimated, CAST(total AS BIGINT) AS total_czk,
       CASE WHEN was_read AND k % 3 = 0 THEN k % 2 = 0 END AS garage,
       CASE WHEN was_read THEN CASE WHEN k % 3 = 1 THEN k % 2 <> 0 ELSE true END END AS parking,
       CASE WHEN k % 19 = 1 THEN true END AS enrich_failed
FROM t CROSS JOIN m"""


# ------------------------------------------------------- watched detail pages

#: Suppliers a part may have here; a table with fewer leaves some parts without one.
SELLERS = 100


def _literals(json: Column) -> Column:
    """Strings between at-signs become bare JSON: a struct cannot hold values of several types in one field."""
    return F.regexp_replace(json, '"@([^@]*)@"', "$1")


def _watched_pages(spark, sf_dir) -> DataFrame:
    """A watched page per part, sold by a supplier; some parts were asked for twice, the first time in vain."""
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    seller = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    part = dealt(load(spark, sf_dir, "part"), "p_partkey").join(seller, F.col("s_suppkey") == F.col("p_partkey") % SELLERS + 1, "left")
    k = F.col("p_partkey")
    n = F.floor("p_retailprice").cast("string")

    def nth(by: Column, *values) -> Column:
        """The value whose place is `by`; null behind the last."""
        return F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))

    case = F.floor(k / 4) % 6
    cost = (
        F.when(case == 0, n).when(case == 1, F.concat(F.lit("@"), n, F.lit("@")))
        .when(case == 2, F.concat(F.lit("+ poplatky "), n, F.lit(" Kč + el. energie 800 Kč + vratná kauce 20 000 Kč")))
        .when(case == 3, "dle dohody")
    )
    prose = F.when(case == 3, F.concat(F.lit("Hezký byt. Poplatky "), n, F.lit(" Kč měsíčně."))).when(case == 4, F.repeat(F.lit("ž"), 1300)).when(case == 5, "")
    image_no = F.sequence(F.lit(1), (k % 8).cast("int"))
    images = F.when(k % 8 > 0, F.transform(image_no, lambda i: F.struct(
        F.when(i == 2, F.lit("")).otherwise(F.concat(F.lit("//img/"), k.cast("string"), F.lit("-"), i.cast("string"))).alias("url"))))
    detail = F.struct(
        F.col("p_name").alias("name"), prose.alias("description"),
        F.when(k % 17 == 0, None).when(k % 17 == 1, 0).otherwise(half_even(F.col("p_retailprice") * 20)).alias("priceCzk"),
        F.when(k % 6 < 3, F.lit(333)).alias("priceCzkPerSqM"),
        F.struct(nth(k % 4, 2, 1, 2, 3).alias("value")).alias("categoryTypeCb"),
        F.struct(nth(k % 3, "1+kk", "2+kk").alias("name")).alias("categorySubCb"),
        images.alias("images"),
        F.struct(F.when(k % 3 == 0, F.col("s_name")).otherwise("").alias("name")).alias("seller"),
        F.struct(F.when(k % 5 > 0, F.lit("office")).alias("name")).alias("premise"),
        F.struct(
            F.when(k % 5 == 0, STREET).when(k % 5 == 1, "").when(k % 5 > 2, F.col("s_name")).alias("street"),
            F.col("n_name").alias("cityPart"), F.lit("Praha").alias("city"), F.when(k % 2 == 0, F.col("p_brand")).alias("district"),
            F.when(k % 7 > 0, 50 + (k % 100) / 1000).alias("latitude"), F.when(k % 14 > 0, 14 + (k % 90) / 1000).alias("longitude"),
        ).alias("locality"),
        F.struct(
            cost.alias("costOfLiving"), F.when(k % 9 > 0, F.col("p_size") + 0.5).alias("floorArea"),
            (k % 9).alias("floorNumber"), F.when(k % 10 > 0, F.lit(9)).alias("floors"),
            nth(k % 9, "@true@", "@false@", "@0@", "@2@", "", "ano", "@[]@", "@null@").alias("garage"),
            nth(k % 5, "@null@", "@0@", "@3@", "@[1]@").alias("parkingLots"),
            nth(k % 3, "@true@", "@{}@").alias("parking"),
            F.when(k % 4 == 2, half_even(F.col("p_retailprice"))).alias("refundableDeposit"),
        ).alias("params"),
    )
    status = nth(k % 13, 404, 500, None, 403, 200, 200, 429, 200, 200, 200, 200, 200, 200)
    good = _query_page(C.DETAIL_QUERY, _literals(F.to_json(detail)))
    body = (
        F.when(k % 13 == 4, "<html></html>").when(k % 13 == 5, _query_page("advert", F.to_json(detail)))
        .when(k % 13 == 7, _query_page(C.DETAIL_QUERY, F.lit("null"))).otherwise(good)
    )
    url = F.concat(F.lit("https://main.example/"), k.cast("string"))
    read = _landed(part, C.MAIN_SOURCE, "watched", listing_key=k, url=url, status=status, body=F.when(status == 200, body))
    early = _landed(
        part.where(k % 10 < 2), C.MAIN_SOURCE, "watched", listing_key=k, url=url, status=F.lit(500),
        fetched_at=F.lit("2023-12-31").cast("timestamp"), body=F.lit(None).cast("string"),
    )
    return early.unionByName(read)


def watched_from_json(spark, sf_dir):
    reads = main_portal.watched_reads(_watched_pages(spark, sf_dir))
    whole = ("rent_czk", "fees_czk", "electricity_czk", "total_czk", "price_czk_per_sqm", "floor_number", "floors_total", "photo_count", "refundable_deposit_czk")
    plain = (
        "title", "disposition", "transaction_type", "fees_missing", "fees_source", "electricity_estimated", "garage", "parking", "floor_area_sqm",
        "locality", "city_part", "street", "district", "description", "seller_name", "thumb", "approx_location",
    )
    return reads.select(
        "listing_key", "url", "outcome", "error",
        *[F.col(f"payload.{c}").cast("bigint").alias(c) for c in whole], *[F.col(f"payload.{c}").alias(c) for c in plain],
        F.round("payload.lat", 6).alias("lat"), F.round("payload.lon", 6).alias("lon"),
        F.array_join("payload.images", " ").alias("images"),
    )


WATCHED_FROM_JSON = f"""
WITH b AS (
  SELECT p.*, p_partkey AS k, p_partkey % 13 > 7 AS ok, p_partkey % 2 = 0 AS rent, p_partkey // 4 % 6 AS how, s_name, n_name,
         'https://main.example/' || p_partkey AS url, CAST(floor(p_retailprice) AS BIGINT) AS n,
         CASE WHEN p_partkey % 17 = 1 THEN 0 WHEN p_partkey % 17 > 1 THEN CAST(round_even(p_retailprice * 20, 0) AS BIGINT) END AS price,
         CASE WHEN p_partkey % 9 > 0 THEN p_size + CAST(0.5 AS DOUBLE) END AS area,
         CASE p_partkey % 5 WHEN 0 THEN '{STREET}' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE s_name END AS street
  FROM part p LEFT JOIN supplier ON s_suppkey = p_partkey % {SELLERS} + 1 LEFT JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT *, CASE WHEN how < 4 THEN n END AS fees, CASE WHEN rent THEN CASE WHEN how = 2 THEN 800 ELSE 1500 END END AS power FROM b),
t AS (
  SELECT *, price + CASE WHEN rent THEN coalesce(fees, 0) + power ELSE 0 END AS total,
         list_filter(range(1, 1 + k % 8), lambda i: i <> 2)[1:5] AS shots
  FROM c)
SELECT CAST(k AS VARCHAR) AS listing_key, url,
       CASE WHEN ok THEN 'ok' ELSE ['gone', 'unreadable', 'unreadable', 'fatal', 'unreadable', 'unreadable', 'unreadable', 'unreadable'][k % 13 + 1] END AS outcome,
       CASE k % 13 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN url || ': HTTP 500' WHEN 2 THEN url || ': no answer' WHEN 3 THEN 'HTTP 403'
         WHEN 4 THEN 'no __NEXT_DATA__ in page (HTTP 200)' WHEN 5 THEN 'estate query missing from page' WHEN 6 THEN url || ': HTTP 429'
         WHEN 7 THEN 'estate query missing from page' END AS error,
       CASE WHEN ok THEN price END AS rent_czk, CASE WHEN ok THEN fees END AS fees_czk, CAST(CASE WHEN ok THEN power END AS BIGINT) AS electricity_czk,
       CAST(CASE WHEN ok THEN total END AS BIGINT) AS total_czk,
       CAST(CASE WHEN ok THEN coalesce(CASE WHEN rent AND total <> 0 THEN round_even(total / area, 0) END, CASE WHEN k % 6 < 3 THEN 333 END) END AS BIGINT) AS price_czk_per_sqm,
       CASE WHEN ok THEN k % 9 END AS floor_number, CAST(CASE WHEN ok AND k % 10 > 0 THEN 9 END AS BIGINT) AS floors_total,
       CASE WHEN ok THEN k % 8 END AS photo_count,
       CASE WHEN ok AND k % 4 = 2 THEN CAST(round_even(p_retailprice, 0) AS BIGINT) END AS refundable_deposit_czk,
       CASE WHEN ok THEN p_name END AS title, CASE WHEN ok THEN ['1+kk', '2+kk', NULL][k % 3 + 1] END AS disposition,
       CASE WHEN ok THEN CASE WHEN rent THEN 'pronajem' ELSE 'prodej' END END AS transaction_type,
       CASE WHEN ok THEN fees IS NULL END AS fees_missing,
       CASE WHEN ok THEN CASE WHEN how < 3 THEN 'field' WHEN how = 3 THEN 'text' END END AS fees_source,
       CASE WHEN ok THEN rent AND how <> 2 END AS electricity_estimated,
       CASE WHEN ok THEN [true, false, false, true, false, true, false, NULL, NULL][k % 9 + 1] END AS garage,
       CASE WHEN ok THEN CASE WHEN k % 5 IN (1, 2, 3) THEN k % 5 > 1 ELSE [true, false, NULL][k % 3 + 1] END END AS parking,
       CASE WHEN ok THEN area END AS floor_area_sqm,
       CASE WHEN ok THEN concat_ws(', ', nullif(street, ''), n_name, 'Praha') END AS locality,
       CASE WHEN ok THEN n_name END AS city_part, CASE WHEN ok THEN street END AS street,
       CASE WHEN ok AND k % 2 = 0 THEN p_brand END AS district,
       CASE WHEN ok THEN CASE how WHEN 3 THEN 'Hezký byt. Poplatky ' || n || ' Kč měsíčně.' WHEN 4 THEN repeat('ž', 1200) ELSE '' END END AS description,
       CASE WHEN ok THEN CASE WHEN k % 3 = 0 AND s_name IS NOT NULL THEN s_name WHEN k % 5 > 0 THEN 'office' END END AS seller_name,
       CASE WHEN ok AND k % 8 > 0 THEN 'https://img/' || k || '-1{C.THUMB_SUFFIX}' END AS thumb,
       CASE WHEN ok THEN false END AS approx_location,
       CASE WHEN ok AND k % 7 > 0 THEN round(50 + (k % 100) / CAST(1000 AS DOUBLE), 6) END AS lat,
       CASE WHEN ok AND k % 14 > 0 THEN round(14 + (k % 90) / CAST(1000 AS DOUBLE), 6) END AS lon,
       CASE WHEN ok THEN array_to_string(list_transform(shots, lambda i: 'https://img/' || k || '-' || i || '{C.FULL_SUFFIX}'), ' ') END AS images
FROM t"""


# ---------------------------------------------------------------- second portal


def _node_pages(spark, sf_dir) -> DataFrame:
    """Twenty customers a page, their images beside them, adverts at changing depth."""
    k = F.col("c_custkey")
    customers = dealt(load(spark, sf_dir, "customer").withColumn("_page", F.floor(k / PER_PAGE)), "_page")
    enum = F.element_at(F.array(*[F.lit(c) for c in ("DISP_1_KK", "DISP_2_KK", "DISP_3_KK")]), (k % 3 + 1).cast("int"))

    def quoted(name, value):
        return F.concat(F.lit(f'"{name}":"'), value.cast("string"), F.lit('",'))

    def bare(name, value):
        return F.concat(F.lit(f'"{name}":'), F.coalesce(value.cast("string"), F.lit("null")), F.lit(","))

    lat, lon = C.DEFAULTS.centre
    advert = F.concat(
        F.lit("{"),
        bare("id", k), quoted("disposition", enum), quoted("offerType", F.when(k % 2 == 0, C.RENT_OFFER_TYPE).otherwise("PRODEJ")),
        bare("price", F.when(k % 13 != 0, half_even(F.abs("c_acctbal")) + 1)),
        F.when(k % 11 == 0, bare("surface", F.lit(None).cast("string"))).otherwise(bare("surface", k % 60 + 20)),
        F.when(k % 10 == 1, F.lit('"gps":null,')).otherwise(
            F.concat(F.lit('"gps":{"lat":'), F.format_number(F.lit(lat) + (k % 40 - 20) / 1000, 5), F.lit(f',"lng":{lon}}},'))),
        F.when(k % 7 == 0, '"active":null,').when(k % 7 == 1, '"active":false,').when(k % 7 == 2, '"active":true,').otherwise(""),
        F.when(k % 8 == 0, '"archived":true,').otherwise(""),
        F.when(k % 5 != 0, quoted("uri", F.concat(F.lit("offer-"), k.cast("string")))).otherwise(""),
        F.when(k % 4 != 0, F.concat(F.lit('"mainImage":{"__ref":"Image:'), k.cast("string"), F.lit('"},'))).otherwise('"mainImage":null,'),
        F.lit('"__typename":"Advert"}'),
    )
    image = F.concat(
        F.lit('{"__typename":"Image","id":'), k.cast("string"),
        F.when(k % 3 != 2, F.concat(F.lit(',"url({\\"filter\\":\\"RECORD_THUMB\\"})":"t'), k.cast("string"), F.lit('"'))).otherwise(""),
        F.when(k % 6 != 1, F.concat(F.lit(',"url({\\"filter\\":\\"RECORD_MAIN\\"})":"m'), k.cast("string"), F.lit('"'))).otherwise(""),
        F.lit("}"),
    )
    depth = (k % 4).cast("int")
    node = F.concat(F.repeat(F.lit('{"in":['), depth), advert, F.repeat(F.lit("]}"), depth))
    # at most PER_PAGE customers share a page
    pages = customers.groupBy("_page").agg(
        F.collect_list(F.concat(node, F.lit(","), image)).alias("_nodes")
    )
    state = F.concat(F.lit('{"props":{"store":['), F.array_join("_nodes", ","), F.lit("]}}"))
    search = _landed(pages, C.NODE_SOURCE, "search", page_no=F.col("_page") + 1, body=_embedded(state))
    detail_state = F.concat(
        F.lit('{"a":{"__typename":"Advert","id":1},"b":{"deep":[{"__typename":"Advert","id":'), k.cast("string"),
        F.lit(',"fee":'), F.when(k % 6 != 5, (k % 9 * 1000).cast("string")).otherwise("null"),
        F.lit(',"description":"'), F.when(k % 3 != 1, F.concat(F.lit("text "), k.cast("string"))).otherwise(""), F.lit('"}]}}'),
    )
    details = _landed(
        customers, C.NODE_SOURCE, "detail",
        listing_key=F.concat(F.lit(C.NODE_KEY_PREFIX), k.cast("string")),
        status=F.when((k % 5 == 0) | (k % 12 == 6), 500).otherwise(200), body=_embedded(detail_state),
    )
    return search.unionByName(details)


def offers_from_nodes(spark, sf_dir):
    pages = _node_pages(spark, sf_dir)
    listings = enrich.add_details(node_portal.adverts(pages), node_portal.advert_details(pages))
    return listings.select(
        "listing_key", "source", "title", "disposition", "transaction_type", "price_czk", "floor_area_sqm", "price_czk_per_sqm",
        "locality", "url", F.round("lat", 5).alias("lat"), "thumb", F.get("images", F.lit(0)).alias("image"),
        "electricity_czk", "electricity_estimated", "total_czk", "fees_missing", "admin_fee_czk", "description",
    )


OFFERS_FROM_NODES = f"""
WITH b AS (
  SELECT c_custkey AS k, c_custkey % 2 = 0 AS rent, CASE c_custkey % 3 WHEN 0 THEN '1+kk' ELSE '2+kk' END AS disp,
         CASE WHEN c_custkey % 13 <> 0 THEN CAST(round_even(abs(c_acctbal), 0) AS BIGINT) + 1 END AS price,
         CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 60 + 20 END AS area,
         round({C.DEFAULTS.centre[0]}::DOUBLE + (c_custkey % 40 - 20) / CAST(1000 AS DOUBLE), 5) AS lat,
         CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 <> 2 THEN 't' || c_custkey END AS t,
         CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 6 <> 1 THEN 'm' || c_custkey END AS m,
         c_custkey % 5 <> 0 AND c_custkey % 12 <> 6 AS has_detail
  FROM customer
  WHERE c_custkey % 3 <> 2 AND c_custkey % 10 <> 1 AND c_custkey % 7 NOT IN (0, 1) AND c_custkey % 8 <> 0
    AND abs(c_custkey % 40 - 20) / 1000.0 * 111.1949 <= 2),
f AS (SELECT *, CASE WHEN has_detail AND k % 6 <> 5 THEN k % 9 * 1000 END AS fee, rent AND price IS NOT NULL AS billed FROM b)
SELECT '{C.NODE_KEY_PREFIX}' || k AS listing_key, '{C.NODE_SOURCE}' AS source,
       CASE WHEN rent THEN 'Pronájem' ELSE 'Prodej' END || ' bytu ' || disp || ' ' || coalesce(CAST(area AS VARCHAR), '') || ' m²' AS title,
       disp AS disposition, CASE WHEN rent THEN 'pronajem' ELSE 'prodej' END AS transaction_type, price AS price_czk,
       CAST(area AS DOUBLE) AS floor_area_sqm,
       CAST(round_even((price + CASE WHEN billed THEN 1500 ELSE 0 END) / CAST(area AS DOUBLE), 0) AS BIGINT) AS price_czk_per_sqm,
       '{C.DEFAULTS.node_locality}' AS locality, CASE WHEN k % 5 <> 0 THEN '{C.NODE_DETAIL_URL}offer-' || k END AS url, lat,
       coalesce(t, m) AS thumb, coalesce(m, t) AS image,
       CASE WHEN billed THEN CAST(1500 AS BIGINT) END AS electricity_czk, billed AS electricity_estimated,
       price + CASE WHEN billed THEN 1500 ELSE 0 END AS total_czk, true AS fees_missing, fee AS admin_fee_czk,
       CASE WHEN has_detail AND k % 3 <> 1 THEN 'text ' || k END AS description
FROM f WHERE coalesce(fee, 0) <= 5000"""


def ref_lookup(spark, sf_dir):
    """Suppliers refer to their nation's picture on the same page; some refer to nothing or to no known one."""
    supplier, nation = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"], "left")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    ref = F.when(k % 5 == 0, "Image:missing").when(k % 7 != 0, F.concat(F.lit("Image:"), n.cast("string")))
    state = F.concat(
        F.lit('{"a":[{"__typename":"Advert","id":'), k.cast("string"), F.lit(',"mainImage":'),
        F.coalesce(F.concat(F.lit('{"__ref":"'), ref, F.lit('"}')), F.lit("null")), F.lit('}],"b":{"__typename":"Image","id":'), n.cast("string"),
        F.when(n % 3 != 0, F.concat(F.lit(',"url({\\"filter\\":\\"RECORD_THUMB\\"})":"t-'), "n_name", F.lit('"'))).otherwise(""),
        F.lit(',"url({\\"filter\\":\\"RECORD_MAIN\\"})":"m-'), F.col("n_name"), F.lit('"}}'),
    )
    pages = _landed(joined, C.NODE_SOURCE, "search", page_no=k, body=_embedded(state))
    read = node_portal.with_image_urls(node_portal.with_nodes(pages, (C.ADVERT_NODE, C.IMAGE_NODE)))
    node = F.get(node_portal.of_type(F.col("nodes"), C.ADVERT_NODE), F.lit(0))["node"]
    key = F.regexp_replace(F.try_variant_get(node, "$.mainImage.__ref", "string"), "(?s)^[^:]*:", "")
    found = read.select(
        F.try_variant_get(node, "$.id", "bigint").alias("s_suppkey"), F.try_element_at("urls", key).alias("u")
    )
    return found.select(
        "s_suppkey", F.coalesce("u.thumb", "u.main").alias("thumb"), F.coalesce("u.main", "u.thumb").alias("image")
    )


# ----------------------------------------------------------------- third portal


def _card_pages(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    part = dealt(load(spark, sf_dir, "part").withColumn("_page", F.floor(k / PER_PAGE)), "_page")
    price = half_even(F.col("p_retailprice") * 20)
    title = F.concat(
        F.lit("Byt "), F.when(k % 3 == 0, "1 +  KK").when(k % 3 == 1, "2+kk").otherwise("3+1"), F.lit(" "),
        F.when(k % 5 != 0, F.concat(F.col("p_size").cast("string"), F.when(k % 2 == 0, ".5").otherwise(""), F.lit("&nbsp; m²"))).otherwise(""),
        F.when(k % 4 == 0, F.concat(F.lit(" "), F.lit(LABEL))).otherwise(""),
    )
    title = F.replace(title, F.lit("&nbsp;"), F.lit(" "))
    info = F.when(k % 4 == 1, F.concat(F.lit("<b>Praha 9</b>\n - "), F.lit(LABEL))).when(k % 4 == 2, "Praha 8").otherwise("")
    money = F.when(k % 6 == 0, "Cena na dotaz").otherwise(F.concat(F.lit("<strong>"), F.replace(F.format_number(price, 0), F.lit(","), F.lit(" ")), F.lit(" Kč</strong>")))
    slug = F.when(k % 7 != 0, F.concat(F.lit("p9/x/"), F.lower(F.hex(k)), F.lit("/"))).otherwise(F.concat(F.lit("p9/n"), k.cast("string")))
    host = F.when(k % 10 == 9, "https://elsewhere.example/detail/a/").otherwise("https://reality.idnes.cz/detail/a/")
    card = F.concat(
        F.lit('<div class="c-products__item"><a href="'), host, slug, F.lit('"><img src="/logo.png"><img alt="" data-src="https://'),
        F.when(k % 8 == 3, "other.example").otherwise("x.1gr.cz"), F.lit("/"), k.cast("string"), F.lit('.jpg"></a><h2 class="c-products__title big">'),
        title, F.lit('</a><p class="c-products__info">'), info, F.lit('</p><p class="c-products__price">'), money, F.lit("</p></div>"),
    )
    # at most PER_PAGE parts share a page
    pages = part.groupBy("_page").agg(F.collect_list(card).alias("_cards"))
    body = F.concat(F.lit("<main>"), F.array_join("_cards", ""), F.lit("</main>"))
    tx = F.when(F.col("_page") % 2 == 0, C.RENT).otherwise(C.SALE)
    return _landed(pages, C.CARD_SOURCE, "search", tx=tx, page_no=F.col("_page") + 1, body=body)


def offers_from_cards(spark, sf_dir):
    listings = card_portal.card_listings(card_portal.cards(_card_pages(spark, sf_dir)))
    return listings.select(
        "listing_key", "source", "title", "disposition", "transaction_type", "price_czk", "floor_area_sqm", "price_czk_per_sqm",
        "locality", "city_part", "url", "thumb", F.size("images").cast("bigint").alias("n_images"), "electricity_czk",
        "electricity_estimated", "total_czk", "lat", "approx_location",
    )


OFFERS_FROM_CARDS = f"""
WITH b AS (
  SELECT p_partkey AS k, (p_partkey // {PER_PAGE}) % 2 = 0 AS rent, CASE p_partkey % 3 WHEN 0 THEN '1+kk' ELSE '2+kk' END AS disp,
         CASE WHEN p_partkey % 6 <> 0 THEN CAST(round_even(p_retailprice * 20, 0) AS BIGINT) END AS price,
         CASE WHEN p_partkey % 5 <> 0 THEN p_size + CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0 END END AS area, p_size,
         CASE WHEN p_partkey % 7 <> 0 THEN 'p9/x/' || lower(hex(p_partkey)) || '/' ELSE 'p9/n' || p_partkey END AS slug,
         CASE WHEN p_partkey % 7 <> 0 THEN lower(hex(p_partkey)) ELSE 'n' || p_partkey END AS tail
  FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 4 IN (0, 1) AND p_partkey % 10 <> 9),
t AS (SELECT *, rent AND price IS NOT NULL AS billed, price + CASE WHEN rent THEN 1500 ELSE 0 END AS total FROM b)
SELECT '{C.CARD_KEY_PREFIX}' || tail AS listing_key, '{C.CARD_SOURCE}' AS source,
       CASE WHEN rent THEN 'Pronájem' ELSE 'Prodej' END || ' bytu ' || disp || ' ' || CASE WHEN area IS NOT NULL THEN CAST(p_size AS VARCHAR) ELSE '' END || ' m²' AS title,
       disp AS disposition, CASE WHEN rent THEN 'pronajem' ELSE 'prodej' END AS transaction_type, price AS price_czk, CAST(area AS DOUBLE) AS floor_area_sqm,
       CAST(round_even(total / CAST(area AS DOUBLE), 0) AS BIGINT) AS price_czk_per_sqm,
       CASE WHEN k % 4 = 1 THEN 'Praha 9 - {LABEL}' ELSE '{LABEL}' END AS locality, '{LABEL}' AS city_part,
       'https://reality.idnes.cz/detail/a/' || slug AS url,
       CASE WHEN k % 8 <> 3 THEN 'https://x.1gr.cz/' || k || '.jpg' END AS thumb, CAST(CASE WHEN k % 8 <> 3 THEN 1 ELSE 0 END AS BIGINT) AS n_images,
       CASE WHEN billed THEN CAST(1500 AS BIGINT) END AS electricity_czk, billed AS electricity_estimated, total AS total_czk,
       NULL::DOUBLE AS lat, false AS approx_location
FROM t"""


# ------------------------------------------------------------------ all portals


def offers_all_sources(spark, sf_dir):
    """The whole way from the landed pages of all portals to one listing table."""
    pages = _main_pages(spark, sf_dir).unionByName(_node_pages(spark, sf_dir)).unionByName(_card_pages(spark, sf_dir))
    return monitor.listings_from_pages(pages).select(
        "listing_key", "source", "title", "transaction_type", "price_czk", "fees_czk", "admin_fee_czk", "total_czk",
        "price_czk_per_sqm", "approx_location", "url",
    )


OFFERS_ALL_SOURCES = f"""
SELECT listing_key, '{C.MAIN_SOURCE}' AS source, title, transaction_type, price_czk, fees_czk, NULL::BIGINT AS admin_fee_czk,
       total_czk, price_czk_per_sqm, approx_location, url FROM ({OFFERS_FROM_JSON})
UNION ALL
SELECT listing_key, source, title, transaction_type, price_czk, NULL, admin_fee_czk, total_czk, price_czk_per_sqm, false, url
FROM ({OFFERS_FROM_NODES})
UNION ALL
SELECT listing_key, source, title, transaction_type, price_czk, NULL, NULL, total_czk, price_czk_per_sqm, false, url
FROM ({OFFERS_FROM_CARDS})"""


QUERIES = {
    "offers_from_json": offers_from_json,
    "watched_from_json": watched_from_json,
    "offers_from_nodes": offers_from_nodes,
    "ref_lookup": ref_lookup,
    "offers_from_cards": offers_from_cards,
    "offers_all_sources": offers_all_sources,
}

ORACLES = {
    "offers_from_json": OFFERS_FROM_JSON,
    "watched_from_json": WATCHED_FROM_JSON,
    "offers_from_nodes": OFFERS_FROM_NODES,
    "ref_lookup": """
        SELECT s_suppkey, CASE WHEN known THEN CASE WHEN s_nationkey % 3 <> 0 THEN 't-' ELSE 'm-' END || n_name END AS thumb,
               CASE WHEN known THEN 'm-' || n_name END AS image
        FROM (SELECT *, s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS known FROM supplier JOIN nation ON n_nationkey = s_nationkey)""",
    "offers_from_cards": OFFERS_FROM_CARDS,
    "offers_all_sources": OFFERS_ALL_SOURCES,
}
