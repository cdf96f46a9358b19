"""Table schemas shared by the sources, the diff, the store and the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """'name type, ...' as a schema; unlike fromDDL it needs no running session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_PAGES = struct(
    "run_id string, run_seq bigint, source string, kind string, tx string, page_no int, "
    "url string, listing_key string, status int, fetched_at timestamp, body string"
)

RUNS = struct("run_id string, run_seq bigint, generated_at timestamp")

WATCHLIST = struct("listing_key string, url string")

LISTING = struct(
    "run_id string, run_seq bigint, listing_key string, source string, title string, "
    "disposition string, transaction_type string, price_czk bigint, fees_czk bigint, "
    "fees_missing boolean, fees_source string, electricity_czk bigint, "
    "electricity_estimated boolean, total_czk bigint, admin_fee_czk bigint, "
    "floor_area_sqm double, price_czk_per_sqm bigint, floor_number int, floors_total int, "
    "locality string, city_part string, street string, is_focus_street boolean, "
    "lat double, lon double, approx_location boolean, garage boolean, parking boolean, "
    "description string, seller_name string, images array<string>, thumb string, url string, "
    "active boolean, enrich_failed boolean, ordinal bigint"
)

# What a field holds when a source does not provide it; everything else is null.
LISTING_DEFAULTS = {
    "is_focus_street": False,
    "approx_location": False,
    "active": True,
    "fees_missing": True,
    "electricity_estimated": False,
}

WATCHED_PAYLOAD = struct(
    "title string, disposition string, transaction_type string, rent_czk bigint, "
    "fees_czk bigint, fees_missing boolean, fees_source string, electricity_czk bigint, "
    "electricity_estimated boolean, total_czk bigint, garage boolean, parking boolean, "
    "price_czk_per_sqm bigint, floor_area_sqm double, floor_number int, floors_total int, "
    "locality string, city_part string, street string, district string, description string, "
    "seller_name string, photo_count int, images array<string>, thumb string, "
    "refundable_deposit_czk bigint, lat double, lon double, approx_location boolean"
)

CHANGES = T.StructType(
    struct(
        "run_seq bigint, at timestamp, kind string, is_watched boolean, listing_key string, "
        "old_price_czk bigint, new_price_czk bigint, old_total_czk bigint, new_total_czk bigint, "
        "first_seen timestamp, missing_since timestamp, removed_since timestamp"
    ).fields
    + [T.StructField("item", LISTING)]
)


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType = LISTING, defaults: dict | None = None) -> DataFrame:
    """Select exactly `schema`, casting what is there and defaulting what is not.

    A column the frame does not have gets its default; a column it has keeps its
    nulls, so "unknown" and "not provided" stay apart.
    """
    defaults = LISTING_DEFAULTS if defaults is None else defaults
    present = set(df.columns)
    out = []
    for field in schema.fields:
        if field.name in present:
            value = F.col(field.name).cast(field.dataType)
        elif field.name == "images":
            value = F.array().cast(field.dataType)
        else:
            value = F.lit(defaults.get(field.name)).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)
