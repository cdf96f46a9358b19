"""Listings near a set of centres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch.config import EARTH_RADIUS_KM
from offerwatch.functions.geo import distance_km


def near_centres(listings: DataFrame, centres: DataFrame, radius_km: float, key: str = "listing_key") -> DataFrame:
    """Each listing within the radius of some centre, with the nearest one and its distance.

    `centres(centre_id, centre_lat, centre_lon)`. The globe is cut into cells as
    high as the radius; a centre goes into every cell its circle can touch, a
    listing into its own, and the cells are joined by equality. Spark broadcasts
    the centres while they are small and splits crowded cells otherwise. Centres
    at the same point act as one, and a listing's matches fold into the nearest.
    """
    reach = math.degrees(radius_km / EARTH_RADIUS_KM)
    columns = int(360 / reach)
    size = 360.0 / columns

    def cell(coordinate: Column) -> Column:
        return F.floor(coordinate / size)

    def lon_cell(number: Column) -> Column:
        return F.pmod(number, F.lit(columns))

    points = centres.groupBy("centre_lat", "centre_lon").agg(F.min("centre_id").alias("centre_id"))
    ratio = F.lit(math.sin(radius_km / EARTH_RADIUS_KM)) / F.greatest(
        F.cos(F.radians("centre_lat")), F.lit(1e-12)
    )
    lon_reach = F.when(ratio < 1, F.degrees(F.asin(F.least(ratio, F.lit(1.0))))).otherwise(180.0) + 1e-9
    west = cell(F.col("centre_lon") + 180 - lon_reach)
    east = F.least(cell(F.col("centre_lon") + 180 + lon_reach), west + columns - 1)
    covered = (
        points.select(
            "*",
            F.explode(
                F.sequence(cell(F.col("centre_lat") - reach - 1e-9), cell(F.col("centre_lat") + reach + 1e-9))
            ).alias("_row"),
            west.alias("_west"),
            east.alias("_east"),
        )
        .select("*", F.explode(F.sequence("_west", "_east")).alias("_at"))
        .select("centre_id", "centre_lat", "centre_lon", "_row", lon_cell(F.col("_at")).alias("_col"))
    )
    placed = listings.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        key, "lat", "lon", cell(F.col("lat")).alias("_row"), lon_cell(cell(F.col("lon") + 180)).alias("_col")
    )
    far = distance_km(F.col("centre_lat"), F.col("centre_lon"), F.col("lat"), F.col("lon"))
    pairs = placed.join(covered, ["_row", "_col"]).withColumn("_km", far).where(F.col("_km") <= radius_km)
    nearest = F.min(F.struct(F.col("_km").alias("km"), F.col("centre_id").alias("centre_id")))
    return pairs.groupBy(key).agg(nearest.alias("_n")).select(
        key, F.col("_n.centre_id").alias("centre_id"), F.col("_n.km").alias("distance_km")
    )
