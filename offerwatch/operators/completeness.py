"""Was a run's search read to its end?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C


def search_completeness(searched: DataFrame, by: list[str]) -> DataFrame:
    """Per search: pages, rows, stated total and whether it is complete.

    Complete means: all pages readable, none empty, no offset served twice, no
    page missing in between, and the last page reaches the stated total. A
    missing total with rows counts as reached.
    """
    rows = F.size("results") if "results" in searched.columns else F.col("n_results")
    sized = searched.withColumn("_rows", rows)
    limit = F.coalesce(
        F.nullif("page_limit", F.lit(0)), F.nullif(F.col("_rows").cast("bigint"), F.lit(0)), F.lit(C.DEFAULT_PAGE_LIMIT)
    )
    reached = F.col("page_no") * limit >= F.coalesce("total", F.lit(0))
    per_search = sized.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.max("page_no").cast("bigint").alias("last_page"),
        F.sum("_rows").alias("rows_seen"),
        F.max("total").alias("total"),
        F.min((F.col("_rows") > 0) & (F.col("outcome") == "ok")).alias("_all_read"),
        F.max(F.col("outcome") == "fatal").alias("fatal"),
        F.max(reached).alias("_reached"),
        F.countDistinct(F.coalesce("page_offset", F.lit(-1))).alias("_offsets"),
    )
    complete = (
        F.col("_all_read")
        & F.col("_reached")
        & (F.col("_offsets") == F.col("pages"))
        & (F.col("last_page") == F.col("pages"))
    )
    return per_search.select(*by, "pages", "rows_seen", "total", "fatal", complete.alias("complete"))


def run_gate(searched: DataFrame, detail_outcomes: DataFrame | None = None) -> DataFrame:
    """Per run: may it be committed? Every transaction type has to be complete, and no
    page may have answered with an error that must stop the run."""
    per_search = search_completeness(searched, ["run_id", "tx"])
    gate = per_search.groupBy("run_id").agg(
        (F.sum(F.when(F.col("complete"), 1).otherwise(0)) == len(C.TX_TYPES)).alias("_searched"),
        F.max("fatal").alias("_fatal"),
    )
    ok = F.col("_searched") & ~F.col("_fatal")
    if detail_outcomes is None:
        return gate.select("run_id", ok.alias("may_commit"))
    stopped = detail_outcomes.groupBy("run_id").agg(F.max(F.col("outcome") == "fatal").alias("_stopped"))
    return gate.join(stopped, "run_id", "left").select(
        "run_id", (ok & ~F.coalesce("_stopped", F.lit(False))).alias("may_commit")
    )


def complete_sources(pages: DataFrame, main_may_commit: bool = True) -> DataFrame:
    """source: those of one run that were read to their end.

    A portal that did not land a page, or one of whose search pages was not
    answered or carries none of its portal's marks, may have more listings than
    were seen. The main portal is judged by its own gate.
    """
    search = pages.where((F.col("kind") == "search") & F.col("source").isin(C.NODE_SOURCE, C.CARD_SOURCE))
    has_marks = F.when(F.col("source") == C.NODE_SOURCE, F.col("body").rlike(C.EMBEDDED_STATE)).otherwise(F.lower("body").contains("<main"))
    readable = F.coalesce((F.col("status") == 200) & has_marks, F.lit(False))
    others = search.groupBy("source").agg(F.min(readable).alias("_read")).where("_read").select("source")
    main = pages.sparkSession.createDataFrame([(C.MAIN_SOURCE,)] if main_may_commit else [], "source string")
    return main.unionByName(others)
