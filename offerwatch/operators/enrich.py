"""Search results completed from detail pages, and missing coordinates filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.functions import costs
from offerwatch.schemas import conform

RUN_KEY = ["run_id", "run_seq", "listing_key"]


def enrich(listings: DataFrame, details: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """Left join of search results with their detail rows, then inactive ones go.

    A readable detail page always sets description, seller, floors, costs and
    parking; images only if it has some; coordinates only if the latitude is
    missing; the area only if there is none. A page that failed to load leaves
    the listing as found and marks it; one without data leaves it unmarked; a 404
    drops it. Both sides have one row per run and key.
    """
    base = conform(listings)
    joined = base.alias("s").join(details.alias("d"), RUN_KEY, "left")
    read = F.coalesce(F.col("d.outcome") == "ok", F.lit(False))
    failed = F.coalesce(F.col("d.outcome") == "transient", F.col("d.outcome").isNull())

    def over(name: str) -> Column:
        return F.when(read, F.col(f"d.{name}")).otherwise(F.col(f"s.{name}"))

    pictured = read & (F.size("d.images") > 0)
    located = read & F.col("s.lat").isNull() & F.col("d.lat").isNotNull()
    roomless = read & (F.coalesce(F.col("s.floor_area_sqm"), F.lit(0.0)) == 0) & (
        F.coalesce(F.col("d.floor_area_sqm"), F.lit(0.0)) != 0
    )
    cost = costs.breakdown(
        F.col("s.price_czk"), F.col("d.fees_czk"), F.col("s.transaction_type"),
        F.col("d.electricity_explicit"), cfg.electricity_estimate,
    )
    changed = {
        "description": over("description"),
        "seller_name": over("seller_name"),
        "floor_number": over("floor_number"),
        "floors_total": over("floors_total"),
        "garage": over("garage"),
        "parking": over("parking"),
        "fees_czk": over("fees_czk"),
        "fees_source": over("fees_source"),
        "images": F.when(pictured, F.col("d.images")).otherwise(F.col("s.images")),
        "thumb": F.when(pictured, F.col("d.thumb")).otherwise(F.col("s.thumb")),
        "lat": F.when(located, F.col("d.lat")).otherwise(F.col("s.lat")),
        "lon": F.when(located, F.col("d.lon")).otherwise(F.col("s.lon")),
        "floor_area_sqm": F.when(roomless, F.col("d.floor_area_sqm")).otherwise(F.col("s.floor_area_sqm")),
        "active": ~F.coalesce(F.col("d.outcome") == "gone", F.lit(False)),
        "enrich_failed": F.when(failed, F.lit(True)),
        **{name: F.when(read, value).otherwise(F.col(f"s.{name}")) for name, value in cost.items()},
    }
    out = joined.select(
        *RUN_KEY,
        read.alias("_read"),
        *[changed.get(c, F.col(f"s.{c}")).alias(c) for c in base.columns if c not in RUN_KEY],
    ).where("active")
    rent_figure = F.when(
        F.col("_read") & (F.col("transaction_type") == C.RENT), costs.per_sqm(F.col("total_czk"), F.col("floor_area_sqm"))
    )
    return out.withColumn("price_czk_per_sqm", F.coalesce(rent_figure, "price_czk_per_sqm")).select(*base.columns)


def add_details(candidates: DataFrame, details: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """One-time fee and description from detail pages; listings above the fee cap go."""
    extra = details.select(
        *RUN_KEY, F.col("admin_fee_czk").alias("_fee"), F.col("description").alias("_text")
    )
    joined = candidates.join(extra, RUN_KEY, "left")
    joined = joined.withColumn("admin_fee_czk", F.col("_fee")).withColumn(
        "description", F.coalesce(F.nullif("_text", F.lit("")), "description")
    )
    return joined.where(fee_within_cap(F.col("admin_fee_czk"), cfg.admin_fee_cap)).select(*candidates.columns)


def fee_within_cap(fee: Column, cap: int) -> Column:
    return F.coalesce(fee, F.lit(0)) <= cap


def centroids(listings: DataFrame, by: list[str], cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """Per group: mean position of all located listings and of those on the focus street.

    A zero coordinate does not count as known. Without any located listing the
    fixed fallback applies, and the focus street falls back to the whole group.
    """
    known = (F.col("lat") != 0) & (F.col("lon") != 0)
    focus = known & F.col("is_focus_street")
    means = listings.groupBy(*by).agg(
        F.avg(F.when(known, F.col("lat"))).alias("_lat"),
        F.avg(F.when(known, F.col("lon"))).alias("_lon"),
        F.avg(F.when(focus, F.col("lat"))).alias("_focus_lat"),
        F.avg(F.when(focus, F.col("lon"))).alias("_focus_lon"),
    )
    lat0, lon0 = cfg.fallback_centroid
    lat, lon = F.coalesce("_lat", F.lit(lat0)), F.coalesce("_lon", F.lit(lon0))
    return means.select(
        *by,
        lat.alias("centroid_lat"),
        lon.alias("centroid_lon"),
        F.coalesce("_focus_lat", lat).alias("focus_lat"),
        F.coalesce("_focus_lon", lon).alias("focus_lon"),
    )


def fill_coordinates(listings: DataFrame, by: list[str], cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """Give listings lacking either coordinate their group's centroid and mark them.

    The centroid table has one row per group (a run). The hint is needed: Spark
    takes the table for as large as the listings before it has run, and would
    send all listings of a run to one task.
    """
    joined = listings.join(F.broadcast(centroids(listings, by, cfg)), by, "left")
    missing = F.col("lat").isNull() | F.col("lon").isNull()

    def filled(name: str) -> Column:
        centre = F.when(F.col("is_focus_street"), F.col(f"focus_{name}")).otherwise(F.col(f"centroid_{name}"))
        return F.when(missing, centre).otherwise(F.col(name))

    changed = {
        "lat": filled("lat"),
        "lon": filled("lon"),
        "approx_location": missing | F.coalesce("approx_location", F.lit(False)),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in listings.columns])
