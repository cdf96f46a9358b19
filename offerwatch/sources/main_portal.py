"""Main portal: search results, detail pages and watched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.functions import costs, html
from offerwatch.functions import text as X
from offerwatch.operators.dedup import keep_last
from offerwatch.sources.pages import embedded_state, fetch_outcome, has_data, pages_of, query_data, result_ordinal

_LOCALITY = "struct<street string, cityPart string, city string, latitude double, longitude double>"

SEARCH_DATA = (
    "struct<pagination struct<total bigint, `offset` bigint, `limit` bigint>, "
    "results array<struct<id bigint, name string, priceCzk bigint, priceCzkPerSqM bigint, "
    "categorySubCb struct<value int, name string>, "
    f"locality {_LOCALITY}, images array<struct<url string>>>>>"
)

DETAIL_DATA = (
    "struct<name string, description string, priceCzk bigint, priceCzkPerSqM bigint, "
    "categoryTypeCb struct<value int>, categorySubCb struct<name string>, "
    "images array<struct<url string>>, seller struct<name string>, premise struct<name string>, "
    "locality struct<street string, cityPart string, city string, district string, "
    "latitude double, longitude double>, "
    "params struct<costOfLiving string, floorArea double, floorNumber int, floors int, "
    "garage variant, parkingLots variant, parking variant, refundableDeposit bigint>>"
)


def search_pages(pages: DataFrame) -> DataFrame:
    """One row per search page: outcome, pagination and the typed results."""
    read = pages_of(pages, C.MAIN_SOURCE, "search").withColumn(
        "_data", query_data(embedded_state(F.col("body")), C.SEARCH_QUERY)
    )
    typed = read.withColumn("_search", F.try_variant_get("_data", "$", SEARCH_DATA))
    return typed.select(
        "run_id",
        "run_seq",
        "tx",
        "page_no",
        fetch_outcome(F.col("status"), has_data(F.col("_data"))).alias("outcome"),
        F.col("_search.pagination.total").alias("total"),
        F.col("_search.pagination.offset").alias("page_offset"),
        F.col("_search.pagination.limit").alias("page_limit"),
        F.coalesce("_search.results", F.expr("cast(array() as array<struct<id bigint, name string, priceCzk bigint, "
                   "priceCzkPerSqM bigint, categorySubCb struct<value int, name string>, "
                   f"locality {_LOCALITY}, images array<struct<url string>>>>)")).alias("results"),
    )


def search_listings(searched: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """Search results of the wanted dispositions in the listing schema, before detail."""
    rows = searched.select("run_id", "run_seq", "tx", "page_no", F.posexplode("results").alias("_pos", "r")).where(
        F.col("r.categorySubCb.value").isin(*cfg.disposition_codes)
    )
    price = F.nullif(F.col("r.priceCzk"), F.lit(0))
    stated = F.nullif(F.col("r.priceCzkPerSqM"), F.lit(0))
    rows = rows.withColumn("_area", X.title_area(F.col("r.name")))
    sub = F.col("r.categorySubCb.name")
    place = F.col("r.locality")
    key = F.col("r.id").cast("string")
    slug = X.url_quote(F.coalesce(X.non_empty(sub), F.lit("x")))
    return rows.select(
        "run_id",
        "run_seq",
        key.alias("listing_key"),
        F.col("r.name").alias("title"),
        sub.alias("disposition"),
        F.when(F.col("tx") == C.RENT, C.RENT).otherwise(C.SALE).alias("transaction_type"),
        price.alias("price_czk"),
        F.col("_area").alias("floor_area_sqm"),
        F.coalesce(stated, costs.per_sqm(price, F.col("_area"))).alias("price_czk_per_sqm"),
        X.join_parts(place["street"], place["cityPart"], place["city"]).alias("locality"),
        place["cityPart"].alias("city_part"),
        place["street"].alias("street"),
        F.coalesce(place["street"] == cfg.focus_street, F.lit(False)).alias("is_focus_street"),
        F.concat(F.lit(C.MAIN_DETAIL_URL), F.col("tx"), F.lit("/byt/"), slug, F.lit("/x/"), key).alias("url"),
        place["latitude"].alias("lat"),
        place["longitude"].alias("lon"),
        html.gallery(F.col("r.images"), cfg.max_images).alias("images"),
        html.thumbnail(F.col("r.images"), cfg.max_images).alias("thumb"),
        price.alias("total_czk"),
        result_ordinal(C.MAIN_SOURCE, F.col("tx"), F.col("page_no"), F.col("_pos")).alias("ordinal"),
    )


def _detail_struct(pages: DataFrame) -> DataFrame:
    read = pages.withColumn("_state", embedded_state(F.col("body")))
    read = read.withColumn("_data", query_data(F.col("_state"), C.DETAIL_QUERY))
    return read.withColumn("d", F.try_variant_get("_data", "$", DETAIL_DATA)).withColumn(
        "outcome", fetch_outcome(F.col("status"), has_data(F.col("_data")))
    )


def _seller() -> Column:
    return F.coalesce(X.non_empty(F.col("d.seller.name")), F.col("d.premise.name"))


def _parking() -> Column:
    lots = F.col("d.params.parkingLots")
    known = lots.isNotNull() & ~F.is_variant_null(lots)
    return F.when(known, costs.tristate(lots)).otherwise(costs.tristate(F.col("d.params.parking")))


def details(pages: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """One row per fetched detail page with what it adds to a search result.

    Fetched twice, the later page counts.
    """
    read = _detail_struct(pages_of(pages, C.MAIN_SOURCE, "detail"))
    read = read.select(
        "run_id", "run_seq", "listing_key", "fetched_at", "outcome", "d",
        F.col("d.params.costOfLiving").alias("_cost"), F.col("d.description").alias("_text"),
    )
    read = costs.with_fees(read, "_cost", "_text")
    out = read.select(
        "run_id",
        "run_seq",
        "listing_key",
        "fetched_at",
        "outcome",
        X.non_empty(X.truncate(F.col("_text"), cfg.max_text)).alias("description"),
        _seller().alias("seller_name"),
        html.gallery(F.col("d.images"), cfg.max_images).alias("images"),
        html.thumbnail(F.col("d.images"), cfg.max_images).alias("thumb"),
        F.col("d.locality.latitude").alias("lat"),
        F.col("d.locality.longitude").alias("lon"),
        F.col("d.params.floorArea").alias("floor_area_sqm"),
        F.col("d.params.floorNumber").alias("floor_number"),
        F.col("d.params.floors").alias("floors_total"),
        "fees_czk",
        "fees_source",
        "electricity_explicit",
        costs.tristate(F.col("d.params.garage")).alias("garage"),
        _parking().alias("parking"),
    )
    return keep_last(out, ["run_id", "run_seq", "listing_key"], ["fetched_at"])


def watched_reads(pages: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """One row per watched fetch: outcome (ok / gone / unreadable / fatal), error, payload.

    For a watched listing a transient failure is one more way of being unreadable.
    """
    read = _detail_struct(pages_of(pages, C.MAIN_SOURCE, "watched"))
    status = F.coalesce(F.concat(F.lit(C.ERROR_STATUS), F.col("status").cast("string")), F.lit(C.ERROR_NO_ANSWER))
    no_state = F.format_string(C.ERROR_NO_STATE.replace("{}", "%d"), "status")
    error = (
        F.when(F.col("outcome").isin("gone", "fatal"), status)
        .when(F.col("outcome") == "transient", F.concat_ws(": ", "url", status))
        .when(F.col("outcome") == "unreadable", F.when(F.col("_state").isNull(), no_state).otherwise(C.ERROR_NO_QUERY))
    )
    read = read.withColumn("error", error).withColumn(
        "outcome", F.when(F.col("outcome") == "transient", "unreadable").otherwise(F.col("outcome"))
    )
    read = read.select(
        "run_id", "run_seq", "listing_key", "url", "fetched_at", "outcome", "error", "d",
        F.col("d.params.costOfLiving").alias("_cost"), F.col("d.description").alias("_text"),
    )
    read = costs.with_fees(read, "_cost", "_text")
    rent = F.col("d.priceCzk")
    area = F.col("d.params.floorArea")
    place = F.col("d.locality")
    tx = F.when(F.col("d.categoryTypeCb.value") == C.RENT_TYPE_CODE, C.RENT).otherwise(C.SALE)
    read = read.withColumn("_tx", tx)
    cost = costs.breakdown(rent, F.col("fees_czk"), F.col("_tx"), F.col("electricity_explicit"), cfg.electricity_estimate)
    from_total = F.when(F.col("_tx") == C.RENT, costs.per_sqm(cost["total_czk"], area))
    payload = F.struct(
        F.col("d.name").alias("title"),
        F.col("d.categorySubCb.name").alias("disposition"),
        F.col("_tx").alias("transaction_type"),
        rent.alias("rent_czk"),
        F.col("fees_czk"),
        cost["fees_missing"].alias("fees_missing"),
        F.col("fees_source"),
        cost["electricity_czk"].alias("electricity_czk"),
        cost["electricity_estimated"].alias("electricity_estimated"),
        cost["total_czk"].alias("total_czk"),
        costs.tristate(F.col("d.params.garage")).alias("garage"),
        _parking().alias("parking"),
        F.coalesce(from_total, F.col("d.priceCzkPerSqM")).alias("price_czk_per_sqm"),
        area.alias("floor_area_sqm"),
        F.col("d.params.floorNumber").alias("floor_number"),
        F.col("d.params.floors").alias("floors_total"),
        X.join_parts(place["street"], place["cityPart"], place["city"]).alias("locality"),
        place["cityPart"].alias("city_part"),
        place["street"].alias("street"),
        place["district"].alias("district"),
        X.truncate(F.coalesce(F.col("_text"), F.lit("")), cfg.max_text).alias("description"),
        _seller().alias("seller_name"),
        F.size(F.coalesce(F.col("d.images"), F.array().cast("array<struct<url string>>"))).alias("photo_count"),
        html.gallery(F.col("d.images"), cfg.max_images).alias("images"),
        html.thumbnail(F.col("d.images"), cfg.max_images).alias("thumb"),
        F.col("d.params.refundableDeposit").alias("refundable_deposit_czk"),
        place["latitude"].alias("lat"),
        place["longitude"].alias("lon"),
        F.lit(False).alias("approx_location"),
    )
    out = read.select(
        "run_id", "run_seq", "listing_key", "url", "fetched_at", "outcome", "error",
        F.when(F.col("outcome") == "ok", payload).alias("payload"),
    )
    return keep_last(out, ["run_id", "run_seq", "listing_key"], ["fetched_at"])
