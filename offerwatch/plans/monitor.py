"""A monitoring run: landed pages to listings, changes, statistics and marts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerwatch import config as C
from offerwatch import schemas
from offerwatch.operators import completeness, diff, enrich, stats, watch
from offerwatch.operators.dedup import keep_last_in_first_place
from offerwatch.plans import marts
from offerwatch.plans.store import Store
from offerwatch.sources import card_portal, main_portal, node_portal
from offerwatch.sources.pages import in_region

WATCH_STATE = T.StructType(
    schemas.struct(
        "run_seq bigint, listing_key string, outcome string, active boolean, fetched_at timestamp, error string, "
        "last_active_at timestamp, unavailable boolean, fetch_error string, fetch_error_at timestamp"
    ).fields
    + [T.StructField("payload", schemas.WATCHED_PAYLOAD)]
)

WATCHED_READS = T.StructType(
    schemas.struct(
        "run_id string, run_seq bigint, listing_key string, url string, fetched_at timestamp, outcome string, error string"
    ).fields
    + [T.StructField("payload", schemas.WATCHED_PAYLOAD)]
)

WATCHED_CHANGES = schemas.struct(
    "run_seq bigint, listing_key string, old_total_czk bigint, new_total_czk bigint, at timestamp"
)

#: How far back the newest events of a run reach: runs with events, newest first; `whole` if there are no others.
HISTORY_REACH = schemas.struct("run_seq bigint, whole boolean").add("runs", T.ArrayType(schemas.struct("run_seq bigint, events bigint")))

RUN_KEY = ["run_id", "run_seq", "listing_key"]


class IncompleteRun(RuntimeError):
    """The main portal was not read to its end; nothing of the run may be committed."""


def main_listings(searched: DataFrame, details: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """Main portal: search results, completed and located. Only these get centroid coordinates."""
    found = keep_last_in_first_place(
        schemas.conform(main_portal.search_listings(searched, cfg)), RUN_KEY
    )
    return enrich.fill_coordinates(enrich.enrich(found, details, cfg), ["run_id", "run_seq"], cfg)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources in one schema; rows without a source name belong to the main portal.
    Keys carry their portal's prefix, so they cannot collide."""
    rows = schemas.conform(sources[0])
    for other in sources[1:]:
        rows = rows.unionByName(schemas.conform(other))
    return rows.withColumn("source", F.coalesce("source", F.lit(C.MAIN_SOURCE)))


def listings_from_pages(pages: DataFrame, cfg: C.MonitorConfig = C.DEFAULTS) -> DataFrame:
    """Listings of all runs among the pages."""
    pages = in_region(pages, cfg.region)
    return union_sources(
        main_listings(main_portal.search_pages(pages), main_portal.details(pages, cfg), cfg),
        enrich.add_details(node_portal.adverts(pages, cfg), node_portal.advert_details(pages, cfg), cfg),
        card_portal.card_listings(card_portal.cards(pages), cfg),
    )


def edit_watchlist(store: Store, edits: DataFrame) -> DataFrame:
    """Apply a batch of edits (op, arg, ts) to the stored list; returns the ones that cannot be used."""
    usable, rejects = watch.read_edits(edits)
    store.edit_watchlist(lambda listed: watch.apply_edits(listed, usable))
    return rejects


def run(
    store: Store,
    pages: DataFrame,
    run_id: str,
    generated_at: datetime,
    cfg: C.MonitorConfig = C.DEFAULTS,
) -> int:
    """Process one landed run and commit it; returns its number.

    Each table is written once and later steps read the written one, so a lost
    executor never means parsing pages again. The stored watch list says what is
    watched: every listing on it has a read in every run, landed or not.

    Raises IncompleteRun if the main portal was not read to its end, and
    RunInProgress if another landing has the next number.
    """
    run_seq = store.claim_run(run_id)
    landed = pages.where(F.col("run_id") == run_id).withColumn("run_seq", F.lit(run_seq).cast("bigint"))
    landed = in_region(landed, cfg.region)

    searched = main_portal.search_pages(landed)
    store.write_run("search_pages", searched, run_seq)
    searched = store.of_run("search_pages", searched.schema, run_seq)
    details = main_portal.details(landed, cfg)
    store.write_run("details", details, run_seq)
    details = store.of_run("details", details.schema, run_seq)
    listed = store.watchlist().select(
        F.lit(run_id).alias("run_id"), F.lit(run_seq).cast("bigint").alias("run_seq"), "listing_key", "url",
        F.lit(generated_at).cast("timestamp").alias("fetched_at"),
    )
    reads = schemas.conform(watch.reads_of_list(listed, main_portal.watched_reads(landed, cfg)), WATCHED_READS, {})
    store.write_run("watched_reads", reads, run_seq)
    reads = store.of_run("watched_reads", WATCHED_READS, run_seq)

    outcomes = details.select("run_id", "outcome").unionByName(reads.select("run_id", "outcome"))
    gate = completeness.run_gate(searched, outcomes).first()
    if gate is None or not gate["may_commit"]:
        store.release_run(run_seq)
        raise IncompleteRun(run_id)

    listings = union_sources(
        main_listings(searched, details, cfg),
        enrich.add_details(node_portal.adverts(landed, cfg), node_portal.advert_details(landed, cfg), cfg),
        card_portal.card_listings(card_portal.cards(landed), cfg),
    )
    store.write_run("listings", listings, run_seq)
    store.write_run(
        "source_states",
        diff.step_source_states(store.of_run("source_states", diff.SOURCE_STATE, run_seq - 1), completeness.complete_sources(landed), run_seq),
        run_seq,
    )
    recent = store.of_runs("listings", schemas.LISTING, run_seq - diff.ABSENCES, run_seq)
    current = store.of_run("listings", schemas.LISTING, run_seq)

    states = watch.carry_step(store.of_run("watched", WATCH_STATE, run_seq - 1), reads)
    store.write_run("watched", states, run_seq)
    two_runs = store.of_runs("watched", WATCH_STATE, run_seq - 1, run_seq)
    moved = watch.watched_changes(two_runs).withColumn("at", F.lit(generated_at).cast("timestamp"))
    store.write_run("watched_changes", moved, run_seq)
    watched_changes = store.of_run("watched_changes", WATCHED_CHANGES, run_seq)

    times = store.runs().unionByName(
        store.spark.range(1).select(
            F.lit(run_id).alias("run_id"),
            F.lit(run_seq).cast("bigint").alias("run_seq"),
            F.lit(generated_at).cast("timestamp").alias("generated_at"),
        )
    )
    events = diff.stamp_times(new_events(store, run_seq, run_seq, cfg.strict), times)
    dated = events.withColumn("is_watched", F.lit(False)).withColumn("at", F.lit(generated_at))
    changes = schemas.conform(dated, schemas.CHANGES, {})
    store.write_run("changes", changes, run_seq)
    changes = store.of_run("changes", schemas.CHANGES, run_seq)
    store.write_run("history_reach", history_reach(store, changes, watched_changes, run_seq, cfg.history_cap), run_seq)
    waiting = diff.pending_strict(store.read_or_empty("listings", schemas.LISTING), store.of_run("source_states", diff.SOURCE_STATE, run_seq)) if cfg.strict else diff.pending(recent, run_seq)
    store.write_run("pending", waiting, run_seq)

    per_type = stats.price_stats(current, ["run_seq", "transaction_type"], "price_czk_per_sqm")
    run_stats = stats.wide_stats(per_type.withColumn("run_seq", F.lit(run_seq)), [])
    store.write_run("run_stats", run_stats, run_seq)
    per_kind = stats.events_per_kind(
        changes.select("run_seq", "kind").unionByName(
            waiting.select(F.lit(run_seq).cast("bigint").alias("run_seq"), F.lit("pending").alias("kind"))
        )
    ).select("run_seq", F.lit("events").alias("what"), F.col("kind").alias("name"), F.col("events").alias("n"))
    per_source = stats.rows_per_source(current, ["run_seq", "source"]).select(
        "run_seq", F.lit("listings").alias("what"), F.col("source").alias("name"), F.col("listings").alias("n")
    )
    store.write_run("mart_counts", per_kind.unionByName(per_source), run_seq)

    write_marts(store, current, changes, watched_changes, reads, run_seq, cfg)
    store.commit(run_seq, generated_at, run_id)
    return run_seq


def new_events(store: Store, first: int, last: int, strict: bool) -> DataFrame:
    """Events of the stored runs first..last, from these and the runs before that they depend on."""
    if not strict:
        return diff.diff_new_runs(store.of_runs("listings", schemas.LISTING, first - diff.ABSENCES, last), first, last)
    states = store.of_runs("source_states", diff.SOURCE_STATE, first, last)
    return diff.diff_new_runs_strict(store.read_or_empty("listings", schemas.LISTING), states, first, last)


def write_marts(store, current, changes, watched_changes, reads, run_seq, cfg) -> None:
    listed = marts.mart_listings(current, changes, watched_changes)
    store.write_run("mart_listings", listed, run_seq)
    listed = store.of_run("mart_listings", listed.schema, run_seq)
    stored = store.of_run("watched", WATCH_STATE, run_seq)
    notes = marts.change_notes(changes, watched_changes)
    watched = marts.watched_items(stored, reads.select("listing_key", "url"), notes, cfg)
    store.write_run("mart_watched", watched, run_seq)
    watched = store.of_run("mart_watched", watched.schema, run_seq)
    items = marts.watched_then_listed(watched, listed.drop("cost_lines"))
    store.write_run("mart_map", marts.mart_map(items), run_seq)
    newest = newest_history(store, run_seq, cfg.history_cap).withColumn("event_run_seq", F.col("run_seq"))
    # only the items of these events, at most the cap, are looked up
    wanted = items.join(newest.select("listing_key").distinct(), "listing_key", "left_semi")
    shown = marts.live_or_archived(marts.with_history_lines(newest), marts.preferred_items(wanted))
    store.write_run("mart_history", shown, run_seq)


def _cut(runs: Column, cap: int) -> Column:
    """The newest of `runs` that hold `cap` events together, or all if they hold fewer."""
    start = F.struct(F.lit(0).cast("bigint").alias("held"), F.slice(runs, 1, 0).alias("kept"))

    def add(so_far, run):
        kept = F.when(so_far["held"] < cap, F.concat(so_far["kept"], F.array(run))).otherwise(so_far["kept"])
        return F.struct((so_far["held"] + run["events"]).alias("held"), kept.alias("kept"))

    return F.aggregate(runs, start, add, lambda so_far: so_far["kept"])


def history_reach(store: Store, changes: DataFrame, watched_changes: DataFrame, run_seq: int, cap: int) -> DataFrame:
    """The reach of a run from that of the run before and its own number of events: a row of at most `cap` runs.

    The first run has no events before it. A store whose earlier runs have no
    reach stored starts with one that is not whole.
    """
    own = changes.select("run_seq").unionByName(watched_changes.select("run_seq")).agg(F.count(F.lit(1)).alias("events"))
    kind = HISTORY_REACH["runs"].dataType
    here = F.when(F.col("events") > 0, F.array(F.struct(F.lit(run_seq).cast("bigint").alias("run_seq"), "events")))
    before = store.of_run("history_reach", HISTORY_REACH, run_seq - 1).select("whole", "runs")
    every = F.concat(F.coalesce(here, F.array()).cast(kind), F.coalesce("runs", F.array().cast(kind)))
    whole = F.coalesce("whole", F.lit(run_seq == 1)) & (F.size(_cut(every, cap)) == F.size(every))
    return own.join(before, F.lit(True), "left").select(F.lit(run_seq).cast("bigint").alias("run_seq"), whole.alias("whole"), _cut(every, cap).alias("runs"))


def newest_history(store: Store, run_seq: int, cap: int) -> DataFrame:
    """The newest events up to a run, out of all that were ever stored.

    The run's stored reach tells which runs hold them; no older folder is
    opened. Where it falls short (the cap was raised since, or the run is older
    than reaches are), a top-k over narrow columns of all runs tells it.
    """

    def events(first: int, *columns: str) -> DataFrame:
        changes = store.of_runs("changes", schemas.CHANGES, first, run_seq).drop("is_watched")
        watched = store.of_runs("watched_changes", WATCHED_CHANGES, first, run_seq)
        found = marts.history_events(changes, watched)
        return marts.newest_events(found.select(*columns) if columns else found, cap)

    reach = store.of_run("history_reach", HISTORY_REACH, run_seq).select("whole", _cut(F.col("runs"), cap).alias("runs")).first()
    if reach and (reach["whole"] or sum(r["events"] for r in reach["runs"]) >= cap):
        return events(min((r["run_seq"] for r in reach["runs"]), default=run_seq))
    first = events(1, "run_seq", "kind_order", "ordinal", "listing_key").agg(F.min("run_seq")).first()[0]
    return events(first or run_seq)
