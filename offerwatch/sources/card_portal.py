"""Third portal: listings are cards in the HTML of the results page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.functions import costs, html
from offerwatch.functions import text as X
from offerwatch.operators.dedup import keep_last_in_first_place
from offerwatch.schemas import conform
from offerwatch.sources.pages import pages_of, result_ordinal


def cards(pages: DataFrame) -> DataFrame:
    """One row per card of a results page."""
    read = pages_of(pages, C.CARD_SOURCE, "search").where(F.col("status") == 200)
    return read.select(
        "run_id", "run_seq", "tx", "page_no", F.posexplode(html.segments(F.col("body"))).alias("_pos", "card")
    )


def card_listings(carded: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """Cards of the wanted dispositions in the wanted locality, in the listing schema."""

    def piece(pattern: str):
        return html.plain_text(F.regexp_extract("card", pattern, 1))

    rows = carded.withColumn("url", X.non_empty(F.regexp_extract("card", C.CARD_LINK, 1))).where(
        F.col("url").isNotNull()
    )
    rows = rows.withColumn("_title", piece(C.CARD_TITLE)).withColumn("_info", piece(C.CARD_INFO))
    found = X.non_empty(F.regexp_extract("_title", C.CARD_DISPOSITION, 1))
    rows = rows.withColumn("disposition", F.lower(F.replace(found, F.lit(" "), F.lit("")))).where(
        F.col("disposition").isin(*cfg.dispositions)
        & (F.col("_info").contains(cfg.locality_label) | F.col("_title").contains(cfg.locality_label))
    )
    hex_id = X.non_empty(F.regexp_extract("url", C.CARD_ID, 1))
    area = X.title_area(F.col("_title"), C.CARD_AREA)
    rows = rows.select(
        "run_id",
        "run_seq",
        F.concat(F.lit(C.CARD_KEY_PREFIX), F.coalesce(hex_id, X.last_path_segment(F.col("url")))).alias("listing_key"),
        "url",
        "disposition",
        F.when(F.col("tx") == C.RENT, C.RENT).otherwise(C.SALE).alias("transaction_type"),
        X.digits_only(piece(C.CARD_PRICE)).alias("price_czk"),
        area.alias("floor_area_sqm"),
        F.coalesce(X.non_empty(F.col("_info")), F.lit(cfg.locality_label)).alias("locality"),
        html.first_hosted_image(F.col("card")).alias("thumb"),
        result_ordinal(C.CARD_SOURCE, F.col("tx"), F.col("page_no"), F.col("_pos")).alias("ordinal"),
    )
    whole = F.when(F.col("floor_area_sqm") != 0, F.col("floor_area_sqm").cast("bigint").cast("string"))
    cost = costs.finalize(
        F.col("price_czk"), F.lit(None).cast("bigint"), F.col("transaction_type"),
        F.col("floor_area_sqm"), cfg.electricity_estimate,
    )
    listed = rows.select(
        "*",
        F.lit(C.CARD_SOURCE).alias("source"),
        F.lit(cfg.locality_label).alias("city_part"),
        F.concat(X.tx_title(F.col("transaction_type")), F.lit(" bytu "), F.col("disposition"), F.lit(" "),
                 F.coalesce(whole, F.lit("")), F.lit(" m²")).alias("title"),
        F.array_compact(F.array("thumb")).alias("images"),
        *[value.alias(name) for name, value in cost.items()],
    )
    return keep_last_in_first_place(conform(listed), ["run_id", "run_seq", "listing_key"])
