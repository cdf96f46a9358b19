"""Second portal: listings are nodes somewhere inside the page's nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.functions import costs
from offerwatch.functions import text as X
from offerwatch.functions.geo import within_radius
from offerwatch.operators.dedup import keep_last, keep_last_in_first_place
from offerwatch.schemas import conform
from offerwatch.sources.pages import embedded_state, pages_of, result_ordinal

_NODES = "array<struct<path array<int>, node variant>>"


def json_depth(text: Column) -> Column:
    """Deepest nesting of a JSON text: escapes and strings go, brackets are counted."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(seen, bracket):
        now = seen["now"] + F.when(bracket.isin("{", "["), 1).when(bracket.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(seen["most"], now).alias("most"))

    return F.aggregate(brackets, start, count, lambda seen: seen["most"])


def _children(found: Column) -> Column:
    """The values of an object or the elements of a list; a scalar has none."""
    node = found["node"]
    values = F.coalesce(
        F.map_values(node.try_cast("map<string,variant>")),
        node.try_cast("array<variant>"),
        F.array().cast("array<variant>"),
    )
    return F.transform(
        values, lambda v, i: F.struct(F.concat(found["path"], F.array(i)).alias("path"), v.alias("node"))
    )


def nodes_of_types(state: Column, depth: Column, types: tuple[str, ...]) -> Column:
    """Every object of the given types anywhere in the document, in pre-order.

    One fold per page: round n looks at the nodes n levels down and gathers their
    children, for as many rounds as this page is deep. Matches are searched too.
    The path (positions from the root; the fields of an object in key order)
    sorts the result into pre-order.
    """
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), state.alias("node")))
    start = F.struct(root.alias("level"), F.array().cast(_NODES).alias("found"))

    def descend(seen, _):
        hits = F.filter(
            seen["level"], lambda p: F.try_variant_get(p["node"], "$.__typename", "string").isin(*types)
        )
        return F.struct(
            F.flatten(F.transform(seen["level"], _children)).cast(_NODES).alias("level"),
            F.concat(seen["found"], hits).cast(_NODES).alias("found"),
        )

    rounds = F.sequence(F.lit(1), F.greatest(depth, F.lit(1)))
    return F.aggregate(rounds, start, descend, lambda seen: seen["found"])


def with_nodes(pages: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Add `nodes`: the page's matching nodes. Pages without a state or a status of 200 go."""
    raw = pages.where(F.col("status") == 200).withColumn(
        "_json", F.regexp_extract("body", C.EMBEDDED_STATE, 1)
    )
    typed = raw.withColumn("_state", F.try_parse_json("_json")).where(F.col("_state").isNotNull())
    typed = typed.withColumn("_depth", json_depth(F.col("_json"))).drop("body", "_json")
    return typed.withColumn("nodes", nodes_of_types(F.col("_state"), F.col("_depth"), types)).drop(
        "_state", "_depth"
    )


def of_type(nodes: Column, name: str) -> Column:
    return F.filter(nodes, lambda p: F.try_variant_get(p["node"], "$.__typename", "string") == name)


def with_image_urls(df: DataFrame) -> DataFrame:
    """Add `urls`: map<image id, struct<thumb, main>> from a page's nodes.

    Images and the adverts that refer to them lie on the same page, so the
    reference is resolved inside the row and needs no join.
    """

    def url_for(fields: Column, wanted: str, unwanted: str | None) -> Column:
        def match(entry):
            hit = entry["key"].startswith(C.IMAGE_URL_KEY) & entry["key"].contains(wanted)
            if unwanted:
                hit = hit & ~entry["key"].contains(unwanted)
            return hit & (F.schema_of_variant(entry["value"]) == "STRING")

        urls = F.filter(F.map_entries(fields), match)
        return F.try_variant_get(F.element_at(F.concat(F.array(F.lit(None)), urls), -1)["value"], "$", "string")

    def entry(p):
        fields = p["node"].try_cast("map<string,variant>")
        return F.named_struct(
            F.lit("id"), F.try_variant_get(p["node"], "$.id", "string"),
            F.lit("path"), p["path"],
            F.lit("urls"), F.named_struct(
                F.lit("thumb"), url_for(fields, C.THUMB_FILTER, None),
                F.lit("main"), url_for(fields, C.MAIN_FILTER, C.THUMB_FILTER),
            ),
        )

    images = F.transform(of_type(F.col("nodes"), C.IMAGE_NODE), entry)
    listed = df.withColumn("_images", F.array_sort(F.filter(images, lambda e: e["id"].isNotNull())))
    # an id seen again replaces the earlier one: keep the last of each run of equal ids
    last = F.filter(
        "_images", lambda e, i: ~F.get("_images", i + 1)["id"].eqNullSafe(e["id"])
    )
    pairs = F.transform(last, lambda e: F.struct(e["id"], e["urls"]))
    return listed.withColumn("urls", F.map_from_entries(pairs)).drop("_images")


def adverts(pages: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """Adverts on listing pages that are wanted, nearby and active, in the listing schema."""
    read = with_nodes(pages_of(pages, C.NODE_SOURCE, "search"), (C.ADVERT_NODE, C.IMAGE_NODE))
    # variants cannot be sorted: their places in the list are, by path
    indexed = F.transform("nodes", lambda p, i: F.struct(
        p["path"].alias("path"), i.alias("i"), F.try_variant_get(p["node"], "$.__typename", "string").alias("type")))
    in_order = F.array_sort(F.filter(indexed, lambda p: p["type"] == C.ADVERT_NODE))
    read = with_image_urls(read).select(
        "run_id",
        "run_seq",
        "tx",
        "page_no",
        F.col("urls").alias("_urls"),
        F.posexplode(F.transform(in_order, lambda o: F.get(F.col("nodes"), o["i"])["node"])).alias("_pos", "a"),
    )

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("a", path, kind)

    rows = read.select(
        "run_id",
        "run_seq",
        field("$.id", "string").alias("_id"),
        X.label(field("$.disposition", "string"), C.DISPOSITION_ENUM).alias("disposition"),
        F.when(field("$.offerType", "string") == C.RENT_OFFER_TYPE, C.RENT).otherwise(C.SALE).alias("transaction_type"),
        field("$.price", "bigint").alias("price_czk"),
        field("$.surface", "double").alias("floor_area_sqm"),
        # a whole number with a point keeps it in the title, as it stands in the page
        F.when(F.schema_of_variant(field("$.surface", "variant")).rlike("^(DECIMAL|DOUBLE|FLOAT)"), field("$.surface", "double").cast("string"))
        .otherwise(field("$.surface", "string"))
        .alias("_surface"),
        field("$.gps.lat", "double").alias("lat"),
        field("$.gps.lng", "double").alias("lon"),
        # absent counts as active, an explicit null does not
        F.coalesce(costs.tristate(field("$.active", "variant")), field("$.active", "variant").isNull()).alias("_active"),
        F.coalesce(costs.tristate(field("$.archived", "variant")), F.lit(False)).alias("_archived"),
        X.non_empty(field("$.uri", "string")).alias("_uri"),
        F.try_element_at("_urls", F.regexp_replace(field("$.mainImage.__ref", "string"), "(?s)^[^:]*:", "")).alias("_image"),
        result_ordinal(C.NODE_SOURCE, F.col("tx"), F.col("page_no"), F.col("_pos")).alias("ordinal"),
    ).where(
        F.col("disposition").isin(*cfg.dispositions)
        & within_radius(F.col("lat"), F.col("lon"), cfg.centre, cfg.radius_km)
        & F.col("_active")
        & ~F.col("_archived")
    )
    thumb, main = X.non_empty(F.col("_image.thumb")), X.non_empty(F.col("_image.main"))
    picture = F.coalesce(main, thumb)
    surface = F.when(F.col("floor_area_sqm") != 0, F.col("_surface")).otherwise("")
    cost = costs.finalize(
        F.col("price_czk"), F.lit(None).cast("bigint"), F.col("transaction_type"),
        F.col("floor_area_sqm"), cfg.electricity_estimate,
    )
    listed = rows.select(
        "run_id",
        "run_seq",
        F.concat(F.lit(C.NODE_KEY_PREFIX), F.coalesce("_id", F.lit("None"))).alias("listing_key"),
        F.lit(C.NODE_SOURCE).alias("source"),
        F.concat(X.tx_title(F.col("transaction_type")), F.lit(" bytu "), F.col("disposition"), F.lit(" "),
                 F.coalesce(surface, F.lit("")), F.lit(" m²")).alias("title"),
        "disposition",
        "transaction_type",
        "price_czk",
        "floor_area_sqm",
        "lat",
        "lon",
        F.lit(cfg.node_locality).alias("locality"),
        F.lit(cfg.locality_label).alias("city_part"),
        F.concat(F.lit(C.NODE_DETAIL_URL), F.col("_uri")).alias("url"),
        F.coalesce(thumb, main).alias("thumb"),
        F.when(picture.isNotNull(), F.array(picture)).otherwise(F.array().cast("array<string>")).alias("images"),
        *[value.alias(name) for name, value in cost.items()],
        "ordinal",
    )
    return keep_last_in_first_place(conform(listed), ["run_id", "run_seq", "listing_key"])


def advert_details(pages: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """One-time fee and description per detail page, from its most complete advert node."""
    read = with_nodes(pages_of(pages, C.NODE_SOURCE, "detail"), (C.ADVERT_NODE,))

    def sized(p):
        return F.struct(
            (-F.size(F.map_keys(p["node"].try_cast("map<string,variant>")))).alias("fewer"),
            p["path"].alias("path"),
            F.try_variant_get(p["node"], "$.fee", "bigint").alias("fee"),
            F.try_variant_get(p["node"], "$.description", "string").alias("description"),
        )

    # most fields first, then pre-order
    read = read.withColumn("_best", F.get(F.array_sort(F.transform("nodes", sized)), F.lit(0)))
    out = read.select(
        "run_id",
        "run_seq",
        "listing_key",
        "fetched_at",
        F.col("_best.fee").alias("admin_fee_czk"),
        X.truncate(X.non_empty(F.col("_best.description")), cfg.max_text).alias("description"),
    )
    return keep_last(out, ["run_id", "run_seq", "listing_key"], ["fetched_at"])
