"""Comparable all-in costs of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.functions import text as X


def half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("bigint")


def per_sqm(amount: Column, area: Column) -> Column:
    """Rounded amount per square metre; null when either is missing or zero."""
    return half_even(F.nullif(amount, F.lit(0)) / F.nullif(area, F.lit(0.0)))


def with_fees(df: DataFrame, cost_field: str, description: str) -> DataFrame:
    """Add fees_czk, fees_source and electricity_explicit.

    A clean positive number in the cost field is the fee and nothing else is
    read. Otherwise amounts come from the field's clauses, and only when those
    give no fee from the description. Each step is its own column, so a text is
    parsed once and only where an earlier step has not settled the matter.
    """
    nothing = F.struct(
        F.lit(None).cast("bigint").alias("fee"), F.lit(None).cast("bigint").alias("electricity")
    )
    clean = X.clean_integer(F.col(cost_field))
    df = df.withColumn("_clean", F.when(clean > 0, clean))
    df = df.withColumn(
        "_field",
        F.when(F.col("_clean").isNull(), X.amounts_in_cost_field(X.trim_space(F.col(cost_field)))).otherwise(nothing),
    )
    settled = F.col("_clean").isNotNull() | F.col("_field.fee").isNotNull()
    df = df.withColumn(
        "_prose", F.when(~settled, X.amounts_in_description(F.col(description))).otherwise(nothing)
    )
    return df.select(
        *[c for c in df.columns if c not in ("_clean", "_field", "_prose")],
        F.coalesce("_clean", "_field.fee", "_prose.fee").alias("fees_czk"),
        F.when(settled, "field").when(F.col("_prose.fee").isNotNull(), "text").alias("fees_source"),
        F.coalesce("_field.electricity", "_prose.electricity").alias("electricity_explicit"),
    )


def breakdown(price: Column, fees: Column, tx: Column, electricity: Column, estimate: int) -> dict[str, Column]:
    """Cost columns of the main portal. Only rentals carry electricity and a sum."""
    rent = F.coalesce(tx == C.RENT, F.lit(False))
    power = F.when(rent, F.coalesce(electricity, F.lit(estimate).cast("bigint")))
    return {
        "fees_missing": fees.isNull(),
        "electricity_czk": power,
        "electricity_estimated": rent & electricity.isNull(),
        "total_czk": F.when(rent, price + F.coalesce(fees, F.lit(0)) + power).otherwise(price),
    }


def finalize(price: Column, fees: Column, tx: Column, area: Column, estimate: int) -> dict[str, Column]:
    """Cost columns of the other portals: a rental without a price gets no estimate at all."""
    priced_rent = F.coalesce((tx == C.RENT) & (price != 0), F.lit(False))
    power = F.lit(estimate).cast("bigint")
    total = F.when(priced_rent, price + F.coalesce(fees, F.lit(0)) + power).otherwise(price)
    return {
        "electricity_czk": F.when(priced_rent, power),
        "electricity_estimated": priced_rent,
        "total_czk": total,
        "price_czk_per_sqm": per_sqm(total, area),
    }


def comparison_value(total: Column, estimated: Column, price: Column) -> Column:
    """What two sightings are compared on: the all-in total, or the bare price of a
    record written before totals were all-in (it does not say whether electricity
    is an estimate)."""
    return F.when(total.isNotNull() & estimated.isNotNull(), total).otherwise(price)


def shown_total(total: Column, price: Column, tx: Column, fees_missing: Column, group: str = " ") -> Column:
    """Total for display; a star marks a rental whose fees are unknown."""
    star = F.when((tx == C.RENT) & F.coalesce(fees_missing, F.lit(False)), "*").otherwise("")
    return F.concat(X.money(F.coalesce(total, price), group), star)


def _line(label: str, amount: Column, note: Column | None = None) -> Column:
    return F.struct(
        F.lit(C.COST_LABELS[label]).alias("label"),
        amount.cast("bigint").alias("amount"),
        (F.lit(None) if note is None else note).cast("string").alias("note"),
    )


def cost_lines() -> Column:
    """array<struct<label,amount,note>> from the cost columns of a listing."""
    rent = F.coalesce(F.col("transaction_type") == C.RENT, F.lit(False))
    missing = F.coalesce(F.col("fees_missing"), F.lit(False))
    estimated = F.coalesce(F.col("electricity_estimated"), F.lit(False))
    fee_note = F.when(missing, C.FEES_UNSTATED).when(F.col("fees_source") == "text", C.FEES_FROM_TEXT)
    one_time = F.when(
        F.coalesce(F.col("admin_fee_czk"), F.lit(0)) != 0, _line("one_time", F.col("admin_fee_czk"))
    )
    rental = F.array(
        _line("rent", F.col("price_czk")),
        _line("fees", F.when(~missing, F.col("fees_czk")), fee_note),
        _line("electricity", F.col("electricity_czk"), F.when(estimated, C.ESTIMATED).otherwise(C.ELECTRICITY_STATED)),
        _line("total", F.col("total_czk"), F.when(missing, C.FEES_AS_ZERO)),
        one_time,
    )
    sale = F.array(_line("price", F.col("price_czk")), one_time)
    return F.array_compact(F.when(rent, rental).otherwise(sale))


def tristate(value: Column) -> Column:
    """Truthiness of a JSON value as true / false / null (absent or JSON null)."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("boolean"))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~kind.isin("OBJECT<>", "ARRAY<VOID>"))
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )
