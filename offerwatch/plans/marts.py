"""Serving tables and the queries asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.functions import costs
from offerwatch.functions import text as X
from offerwatch.operators.diff import KIND_ORDER, NEW, PRICE_CHANGE, REMOVED, WATCHED_KIND_ORDER

# Digit grouping on screen uses the no-break space; notes use the plain one.
SCREEN_GROUP = " "

SORT_KEYS = (
    "title", "transaction_type", "disposition", "price_czk", "total_czk",
    "floor_area_sqm", "price_czk_per_sqm", "city_part",
)


# ------------------------------------------------------------- notes and flags


def change_marks(changes: DataFrame, watched_changes: DataFrame | None = None) -> DataFrame:
    """Per run and listing with changes: one note (a watched change before a price
    change before new) and whether the price changed."""
    moved = F.concat(F.lit(C.NOTE_PRICE), X.money(F.col("old_total_czk")), F.lit(" → "), X.money(F.col("new_total_czk")))
    priced = F.col("kind") == PRICE_CHANGE
    marks = changes.where(F.col("kind").isin(PRICE_CHANGE, NEW)).select(
        "run_seq",
        "listing_key",
        F.when(priced, 1).otherwise(2).alias("_priority"),
        F.when(priced, moved).otherwise(C.NOTE_NEW).alias("change_note"),
        priced.alias("is_changed"),
    )
    if watched_changes is not None:
        marks = marks.unionByName(
            watched_changes.select(
                "run_seq", "listing_key", F.lit(0).alias("_priority"), moved.alias("change_note"),
                F.lit(False).alias("is_changed"),
            )
        )
    return marks.groupBy("run_seq", "listing_key").agg(
        F.min_by("change_note", "_priority").alias("change_note"), F.max("is_changed").alias("is_changed")
    )


def change_notes(changes: DataFrame, watched_changes: DataFrame | None = None) -> DataFrame:
    return change_marks(changes, watched_changes).drop("is_changed")


def with_change_notes(listings: DataFrame, notes: DataFrame) -> DataFrame:
    return listings.join(notes, ["run_seq", "listing_key"], "left")


def with_changed_flag(listings: DataFrame, changes: DataFrame) -> DataFrame:
    """Mark listings whose price changed in their run."""
    ids = changes.where(F.col("kind") == PRICE_CHANGE).select("run_seq", "listing_key", F.lit(True).alias("_hit"))
    joined = listings.join(ids.distinct(), ["run_seq", "listing_key"], "left")
    return joined.withColumn("is_changed", F.coalesce("_hit", F.lit(False))).drop("_hit")


# --------------------------------------------------------------------- history


def history_events(changes: DataFrame, watched_changes: DataFrame | None = None) -> DataFrame:
    """All events as one table, with their time `at` where the changes have it. Watched
    events come first in a run and carry no item; (run_seq, kind_order, ordinal, listing_key) orders the events totally."""
    order = F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair])
    fields = changes.schema["item"].dataType.names if "item" in changes.columns else []
    ordinal = F.col("item.ordinal") if "ordinal" in fields else F.lit(None).cast("bigint")
    events = changes.select(
        "*", F.lit(False).alias("is_watched"), order[F.col("kind")].alias("kind_order"), ordinal.alias("ordinal")
    )
    if watched_changes is not None:
        dated = [c for c in ("at",) if c in watched_changes.columns]
        events = events.unionByName(
            watched_changes.select(
                "run_seq", *dated, "listing_key", "old_total_czk", "new_total_czk",
                F.lit(PRICE_CHANGE).alias("kind"), F.lit(True).alias("is_watched"),
                F.lit(WATCHED_KIND_ORDER).alias("kind_order"),
            ),
            allowMissingColumns=True,
        )
    return events


def newest_events(events: DataFrame, cap: int = C.DEFAULTS.history_cap) -> DataFrame:
    """Newest first, at most `cap`: a top-k, so no full sort."""
    return events.orderBy(F.desc("run_seq"), "kind_order", "ordinal", "listing_key").limit(cap)


def history_line(kind: Column, key: Column, title: Column, shown: Column, old: Column, new: Column) -> Column:
    def cash(value):
        return X.money(value, SCREEN_GROUP)

    name = F.coalesce(X.non_empty(title), key)
    return (
        F.when(kind == NEW, F.concat(F.lit("New: "), name, F.lit(" — "), cash(shown)))
        .when(kind == REMOVED, F.concat(F.lit("Gone: "), name, F.lit(" — last seen at "), cash(shown)))
        .otherwise(F.concat(F.coalesce(X.non_empty(title), F.concat(F.lit("#"), key)), F.lit(": "), cash(old), F.lit(" → "), cash(new)))
    )


def with_history_lines(events: DataFrame) -> DataFrame:
    item = F.col("item")
    return events.withColumn(
        "line",
        history_line(
            F.col("kind"), F.col("listing_key"), item["title"],
            F.coalesce(item["total_czk"], item["price_czk"]),
            F.coalesce("old_total_czk", "old_price_czk"),
            F.coalesce("new_total_czk", "new_price_czk"),
        ),
    )


def live_or_archived(events: DataFrame, current: DataFrame) -> DataFrame:
    """Each event with the listing as it is now, or as the event recorded it."""
    fields = events.schema["item"].dataType.fields
    live = current.select(
        "listing_key",
        F.struct(
            *[(F.col(f.name) if f.name in current.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        ).alias("_live"),
    )
    joined = events.join(live, "listing_key", "left")
    return joined.withColumn("is_live", F.col("_live").isNotNull()).withColumn(
        "item", F.coalesce("_live", "item")
    ).drop("_live")


# ----------------------------------------------------------------------- marts


def mart_listings(listings: DataFrame, changes: DataFrame, watched_changes: DataFrame | None = None) -> DataFrame:
    """Listings of the committed runs with everything a reader sees."""
    marked = listings.join(change_marks(changes, watched_changes), ["run_seq", "listing_key"], "left")
    return display_columns(marked.withColumn("is_changed", F.coalesce("is_changed", F.lit(False))))


def display_columns(df: DataFrame) -> DataFrame:
    floor = F.concat(F.col("floor_number").cast("string"), F.lit("/"), F.coalesce(F.col("floors_total").cast("string"), F.lit("?")))

    def yes_no(name):
        return F.when(F.col(name), C.YES).when(~F.col(name), C.NO).otherwise(C.UNSTATED)

    return df.select(
        "*",
        costs.shown_total(F.col("total_czk"), F.col("price_czk"), F.col("transaction_type"),
                          F.col("fees_missing"), SCREEN_GROUP).alias("shown_total"),
        costs.cost_lines().alias("cost_lines"),
        F.when(F.col("transaction_type") == C.RENT, "rent").otherwise("sale").alias("type_label"),
        yes_no("garage").alias("garage_label"),
        yes_no("parking").alias("parking_label"),
        F.coalesce(floor, F.lit("—")).alias("floor_label"),
        X.label(F.col("source"), C.SOURCE_BADGES).alias("source_badge"),
        F.coalesce(X.label(F.col("source"), C.SOURCE_NAMES), F.lit(C.SOURCE_NAMES[C.MAIN_SOURCE])).alias("source_name"),
    )


def watched_items(states: DataFrame, watchlist: DataFrame, notes: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """Watched states as display rows. The type shown is always rent; the real one is kept beside it."""
    p = F.col("payload")
    joined = states.join(watchlist.select("listing_key", "url"), "listing_key", "left").join(
        notes, ["run_seq", "listing_key"], "left"
    )
    last_known = F.when(
        ~F.col("active") & F.col("last_active_at").isNotNull(),
        F.concat(
            F.lit(C.NOTE_LAST_KNOWN),
            F.date_format(
                F.to_utc_timestamp("last_active_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"
            ),
        ),
    )
    same = [
        "title", "disposition", "total_czk", "fees_czk", "fees_missing", "fees_source", "electricity_czk",
        "electricity_estimated", "garage", "parking", "floor_area_sqm", "price_czk_per_sqm", "floor_number",
        "floors_total", "locality", "city_part", "street", "description", "seller_name", "thumb", "lat", "lon",
    ]
    return joined.select(
        "run_seq",
        "listing_key",
        F.lit(True).alias("is_seed"),
        F.lit(C.RENT).alias("transaction_type"),
        p["transaction_type"].alias("actual_transaction_type"),
        p["rent_czk"].alias("price_czk"),
        *[p[name].alias(name) for name in same],
        F.coalesce(p["images"], F.array().cast("array<string>")).alias("images"),
        F.coalesce(p["street"] == cfg.focus_street, F.lit(False)).alias("is_focus_street"),
        F.lit(False).alias("approx_location"),
        "url",
        "active",
        F.coalesce("change_note", last_known).alias("change_note"),
    )


def map_layer(approx: Column, watched: Column, tx: Column) -> Column:
    return (
        F.when(F.coalesce(approx, F.lit(False)), "approx")
        .when(F.coalesce(watched, F.lit(False)), "watched")
        .when(tx == C.RENT, "rent")
        .otherwise("sale")
    )


def mart_map(items: DataFrame) -> DataFrame:
    """Rows that have both coordinates, with the layer they are drawn on."""
    return items.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn(
        "layer", map_layer(F.col("approx_location"), F.col("is_seed"), F.col("transaction_type"))
    )


def map_centre(items: DataFrame) -> DataFrame:
    """The first located row, watched rows first."""
    return (
        items.where(F.col("lat").isNotNull())
        .orderBy(F.when(F.col("is_seed"), 0).otherwise(1), "ordinal", "listing_key")
        .limit(1)
    )


def watched_then_listed(watched: DataFrame, listings: DataFrame) -> DataFrame:
    """All items, watched first; `priority` tells which."""
    return watched.withColumn("priority", F.lit(0)).unionByName(
        listings.withColumn("priority", F.lit(1)), allowMissingColumns=True
    )


def lookup(items: DataFrame, key: str) -> DataFrame:
    """The item of a key; a watched one hides a listed one. The key filter reaches both scans."""
    return items.where(F.col("listing_key") == key).orderBy("priority").limit(1)


def preferred_items(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`lookup` for every key at once."""
    keys = keys or ["listing_key"]
    rest = [c for c in items.columns if c not in keys]
    best = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), "priority").alias("_row"))
    return best.select(*keys, "_row.*").select(*items.columns)


# --------------------------------------------------------------------- queries


def query_listings(
    mart: DataFrame,
    tx: str | None = None,
    disposition: str | None = None,
    source: str | None = None,
    focus_only: bool = False,
    text: str | None = None,
    sort_key: str = "price_czk_per_sqm",
    descending: bool = False,
    text_columns: tuple[str, ...] = ("title", "city_part", "locality"),
    tie: tuple[str, ...] = ("ordinal", "listing_key"),
) -> DataFrame:
    """Facets, search and sort as one filter and one sort. An empty facet does not restrict.

    Nulls sort as the smallest value; equal rows keep their order of arrival.
    """
    rows = mart
    for column, wanted in (("transaction_type", tx), ("disposition", disposition), ("source", source)):
        if wanted:
            rows = rows.where(F.col(column) == wanted)
    if focus_only:
        rows = rows.where("is_focus_street")
    if text:
        needle = text.lower()
        hit = F.lit(False)
        for column in text_columns:
            hit = hit | F.coalesce(F.lower(column).contains(needle), F.lit(False))
        rows = rows.where(hit)
    order = F.col(sort_key).desc_nulls_last() if descending else F.col(sort_key).asc_nulls_first()
    return rows.orderBy(order, *tie)


def same_street(mart: DataFrame) -> DataFrame:
    return mart.where("is_focus_street")
