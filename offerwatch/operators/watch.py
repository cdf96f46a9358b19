"""Individually watched listings: the list itself, and their state across failed reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.functions import text as X
from offerwatch.functions.costs import comparison_value
from offerwatch.operators.diff import with_neighbours

# Runs per block of carry_forward's scan.
RUNS_PER_BLOCK = 512


# ------------------------------------------------------------------ watch list


def read_edits(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable edits, rejects) of rows (op, arg, ts).

    An addition needs a URL ending in a numeric id; a removal takes that or a
    bare id. Ids are numbers, so leading zeros do not make a different key.
    """
    arg = X.trim_space(F.col("arg"))
    from_url = X.listing_id_from_url(arg)
    bare = F.when(F.col("op") == "remove", F.when(arg.rlike(r"^\d+$"), arg))
    key = F.regexp_replace(F.coalesce(bare, from_url), r"^0+(?=\d)", "")
    read = edits.select("op", arg.alias("url"), "ts", key.alias("listing_key"))
    usable = F.col("listing_key").isNotNull() & F.col("op").isin("add", "remove")
    usable = F.coalesce(usable, F.lit(False))
    return read.where(usable), read.where(~usable).drop("listing_key")


def add_to_watchlist(watchlist: DataFrame, additions: DataFrame) -> DataFrame:
    """Idempotent: a key already listed keeps its URL; the first of repeated additions counts."""
    first = additions.groupBy("listing_key").agg(F.min_by("url", "ts").alias("url"))
    fresh = first.join(watchlist.select("listing_key"), "listing_key", "left_anti")
    return watchlist.select("listing_key", "url").unionByName(fresh)


def remove_from_watchlist(watchlist: DataFrame, removals: DataFrame) -> DataFrame:
    """Idempotent: removing what is not listed changes nothing."""
    return watchlist.join(removals.select("listing_key"), "listing_key", "left_anti")


def apply_edits(watchlist: DataFrame, edits: DataFrame) -> DataFrame:
    """A mixed batch of edits: per key, only what follows its last removal matters."""
    per_key = edits.groupBy("listing_key").agg(
        F.max(F.when(F.col("op") == "remove", F.col("ts"))).alias("_removed")
    )
    additions = (
        edits.where(F.col("op") == "add")
        .join(per_key, "listing_key")
        .where(F.col("_removed").isNull() | (F.col("ts") > F.col("_removed")))
    )
    removals = per_key.where(F.col("_removed").isNotNull())
    return add_to_watchlist(remove_from_watchlist(watchlist, removals), additions)


def reads_of_list(listed: DataFrame, reads: DataFrame) -> DataFrame:
    """One read per run and listing on the list (run_id, run_seq, listing_key, url, fetched_at).

    A page that did not land could not be read. The list's URL counts, its
    fetched_at is the time of the run. A read of something not on the list is
    dropped.
    """
    keys = [c for c in ("run_id", "run_seq", "listing_key") if c in reads.columns]
    landed = reads.select(
        *keys, "outcome", F.col("fetched_at").alias("_at"), "error", "payload", F.lit(True).alias("_landed")
    )
    both = listed.join(landed, keys, "left")
    absent = F.concat_ws(": ", "url", F.lit(C.ERROR_NO_ANSWER))
    return both.select(
        *keys,
        "url",
        F.when(F.col("_landed"), F.col("_at")).otherwise(F.col("fetched_at")).alias("fetched_at"),
        F.when(F.col("_landed"), F.col("outcome")).otherwise("unreadable").alias("outcome"),
        F.when(F.col("_landed"), F.col("error")).otherwise(absent).alias("error"),
        "payload",
    )


# --------------------------------------------------------------- carry-forward


def carry_forward(reads: DataFrame, block: int = RUNS_PER_BLOCK, along: tuple[str, ...] = ()) -> DataFrame:
    """State of every watched listing after every run.

    `reads` has one row per run_seq and listing_key: outcome (ok, gone,
    unreadable), fetched_at, error, payload (null unless ok). A failed read keeps
    the last known state and notes the error; a 404 turns it inactive and keeps
    the details and when it was last seen active. Leaving the watch list for a
    run drops the state.

    Everything a state holds is the last of something: the last start of a watch
    period, the last ok read, the last readable one. These are prefix scans, made
    in two levels so that no task holds a listing's whole history: rows are
    windowed within blocks of runs, each block sends one summary row on, and a
    window over the summaries brings in what earlier blocks ended with.

    Columns of the reads named in `along` stay with their state, so that nobody
    has to join the reads to it again.
    """
    home = F.floor(F.col("run_seq") / block)
    # one run of overlap shows the first row of a block whether the run before is there
    spread = reads.withColumn(
        "_block", F.explode(F.array_distinct(F.array(home, F.floor((F.col("run_seq") + 1) / block))))
    )
    by_block = Window.partitionBy("listing_key", "_block").orderBy("run_seq")
    at_home = F.col("_block") == home
    spread = spread.withColumn(
        "_starts", F.coalesce(F.col("run_seq") - F.lag("run_seq").over(by_block) != 1, F.lit(True))
    )
    read = F.struct("outcome", "fetched_at", "error")
    values = {
        "_start": F.when(F.col("_starts"), read),
        "_ok": F.when(F.col("outcome") == "ok", F.struct("fetched_at", "payload")),
        "_read": F.when(F.col("outcome") != "unreadable", read),
    }
    marked = spread.select(
        "*",
        *[
            F.when(at_home & v.isNotNull(), F.struct(F.col("run_seq").alias("seq"), v.alias("value"))).alias(f"{n}_here")
            for n, v in values.items()
        ],
    )
    upto = by_block.rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select(
        "run_seq", "listing_key", "outcome", "fetched_at", "error", "_block", *along,
        *[F.last(f"{n}_here", ignorenulls=True).over(upto).alias(f"{n}_in") for n in values],
    ).where(at_home)
    ends = local.groupBy("listing_key", "_block").agg(
        F.max_by(F.struct(*[f"{n}_in" for n in values]), "run_seq").alias("_end")
    )
    earlier = Window.partitionBy("listing_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "listing_key",
        "_block",
        *[F.last(F.col(f"_end.{n}_in"), ignorenulls=True).over(earlier).alias(f"{n}_before") for n in values],
    )
    seen = local.join(carried, ["listing_key", "_block"]).select(
        "run_seq", "listing_key", "outcome", "fetched_at", "error", *along,
        *[F.coalesce(f"{n}_in", f"{n}_before").alias(n) for n in values],
    )

    # what was seen before the current watch period does not count
    def current(name: str) -> Column:
        return F.when(F.col(f"{name}.seq") >= F.col("_start.seq"), F.col(f"{name}.value"))

    seen = seen.withColumn("_ok_now", current("_ok")).withColumn("_read_now", current("_read"))
    failed = (F.col("outcome") == "unreadable") & (F.col("run_seq") > F.col("_start.seq"))
    start = F.col("_start.value")
    never_read = F.col("_read_now").isNull()
    return seen.select(
        "run_seq",
        "listing_key",
        "outcome",
        F.coalesce(F.col("_read_now.outcome") == "ok", F.lit(False)).alias("active"),
        F.when(never_read, start["fetched_at"]).otherwise(F.col("_read_now.fetched_at")).alias("fetched_at"),
        F.when(never_read, start["error"]).otherwise(F.col("_read_now.error")).alias("error"),
        F.when(F.col("_read_now.outcome") == "gone", F.col("_ok_now.fetched_at")).alias("last_active_at"),
        F.when((start["outcome"] == "unreadable") & F.col("_ok_now").isNull(), F.lit(True)).alias("unavailable"),
        F.when(failed, F.col("error")).alias("fetch_error"),
        F.when(failed, F.col("fetched_at")).alias("fetch_error_at"),
        F.col("_ok_now.payload").alias("payload"),
        *along,
    )


STATE_COLUMNS = [
    "run_seq", "listing_key", "outcome", "active", "fetched_at", "error", "last_active_at",
    "unavailable", "fetch_error", "fetch_error_at", "payload",
]


def carry_on(previous: DataFrame, reads: DataFrame, first: int) -> DataFrame:
    """States of the runs from `first` on, given the states of the run before and all reads since.

    A state is written as the one or two reads that lead to it and put in front
    of the new ones, so any number of runs is one pass of `carry_forward`.
    """
    columns = ["run_seq", "listing_key", "outcome", "fetched_at", "error", "payload"]
    none = F.lit(None)

    def as_read(run: int, outcome: str, at: Column, error: Column, payload: Column) -> Column:
        parts = (F.lit(run).cast("bigint"), F.lit(outcome), at, error.cast("string"), payload.cast(reads.schema["payload"].dataType))
        return F.struct(*[v.alias(c) for c, v in zip([c for c in columns if c != "listing_key"], parts, strict=True)])

    active, seen = F.col("active"), F.col("last_active_at").isNotNull()
    at, error, payload = F.col("fetched_at"), F.col("error"), F.col("payload")
    lead = (
        F.when(active, none)
        .when(seen, as_read(first - 2, "ok", F.col("last_active_at"), none, payload))
        .when(F.col("unavailable"), as_read(first - 2, "unreadable", at, error, none))
    )
    last = F.when(active, as_read(first - 1, "ok", at, none, payload)).otherwise(as_read(first - 1, "gone", at, error, none))
    before = previous.select("listing_key", F.explode(F.filter(F.array(lead, last), lambda r: r.isNotNull())).alias("r"))
    both = reads.select(*columns).unionByName(before.select("listing_key", "r.*"))
    return carry_forward(both).where(F.col("run_seq") >= first)


def carry_step(previous: DataFrame, reads: DataFrame) -> DataFrame:
    """One run: this run's reads merged onto the state after the run before."""
    before = previous.select("listing_key", F.struct(*[c for c in STATE_COLUMNS if c != "listing_key"]).alias("p"))
    both = reads.join(before, "listing_key", "left")
    known = F.col("p").isNotNull()
    ok, gone, failed = (F.col("outcome") == o for o in ("ok", "gone", "unreadable"))
    kept = failed & known

    def merged(name: str, fresh: Column) -> Column:
        return F.when(kept, F.col(f"p.{name}")).otherwise(fresh)

    was_active_at = F.when(F.col("p.active"), F.col("p.fetched_at"))
    return both.select(
        "run_seq",
        "listing_key",
        "outcome",
        merged("active", ok).alias("active"),
        merged("fetched_at", F.col("fetched_at")).alias("fetched_at"),
        merged("error", F.when(~ok, F.col("error"))).alias("error"),
        merged("last_active_at", F.when(gone, F.coalesce("p.last_active_at", was_active_at))).alias("last_active_at"),
        F.when(ok, F.lit(None)).when(known, F.col("p.unavailable")).when(failed, F.lit(True)).alias("unavailable"),
        F.when(kept, F.col("error")).alias("fetch_error"),
        F.when(kept, F.col("fetched_at")).alias("fetch_error_at"),
        F.when(ok, F.col("payload")).otherwise(F.col("p.payload")).alias("payload"),
    )


def watched_changes(states: DataFrame) -> DataFrame:
    """Cost changes of watched listings that are active now, against the run before.

    Old records without an electricity flag compare on a price watched records do
    not have, so they compare as null.
    """
    now = states.select(
        "run_seq",
        "listing_key",
        "active",
        F.col("payload.total_czk").alias("total_czk"),
        comparison_value(
            F.col("payload.total_czk"), F.col("payload.electricity_estimated"), F.lit(None).cast("bigint")
        ).alias("cmp"),
    )
    seen = with_neighbours(now, ["listing_key"], ["total_czk", "cmp"])
    return seen.where(
        F.col("active") & (F.col("prev_seq") == F.col("run_seq") - 1) & ~F.col("cmp").eqNullSafe(F.col("prev_cmp"))
    ).select("run_seq", "listing_key", F.col("prev_total_czk").alias("old_total_czk"), F.col("total_czk").alias("new_total_czk"))
