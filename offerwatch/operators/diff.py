"""What changed from run to run.

A listing is removed only after two absences in a row, so every event of a run
is decided by the listing's own sightings at most two runs away. That makes the
fold over runs a bounded-neighbourhood question: one window pass answers it for
the whole history, and a new run needs nothing but the two runs before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerwatch.functions.costs import comparison_value
from offerwatch.operators.dedup import union_preferring

# Absences in a row after which a listing counts as removed.
ABSENCES = 2

# Runs per window group. A group holds at most this many rows plus the overlap,
# however long a listing's history or however large its share of all rows.
RUNS_PER_GROUP = 512

PRICE_CHANGE, NEW, REMOVED = "price_change", "new", "removed"
KIND_ORDER = {PRICE_CHANGE: 1, NEW: 2, REMOVED: 3}
WATCHED_KIND_ORDER = 0

DIFF_COLUMNS = [
    "run_seq", "kind", "listing_key",
    "old_price_czk", "new_price_czk", "old_total_czk", "new_total_czk",
    "first_seen_seq", "missing_since_seq", "removed_since_seq", "item",
]


def item_of(df: DataFrame) -> Column:
    """All columns of a listing row as one struct."""
    return F.struct(*df.columns).alias("item")


def with_comparison(listings: DataFrame, strict: bool = False) -> DataFrame:
    """Add `cmp`, and `failed` in strict mode: the listing's detail page could not be
    loaded, so its total lacks the costs that page would have added."""
    value = comparison_value(F.col("total_czk"), F.col("electricity_estimated"), F.col("price_czk"))
    rows = listings.withColumn("cmp", value)
    return rows.withColumn("failed", F.coalesce("enrich_failed", F.lit(False))) if strict else rows


def _differs(new: str, old: str, strict: bool) -> Column:
    """Do two sightings differ? In strict mode a failed one is compared on the bare price.
    `new` and `old` are formats for the two sides' column names."""

    def unequal(name: str) -> Column:
        return ~F.col(new.format(name)).eqNullSafe(F.col(old.format(name)))

    if not strict:
        return unequal("cmp")
    failed = F.col(new.format("failed")) | F.col(old.format("failed"))
    return F.when(failed, unequal("price_czk")).otherwise(unequal("cmp"))


def _carried(strict: bool) -> list[str]:
    return ["price_czk", "total_czk", "cmp", *(["failed"] if strict else [])]


def with_neighbours(sightings: DataFrame, keys: list[str], carry: list[str], seq: str = "run_seq") -> DataFrame:
    """Add the previous sighting's `carry` columns (prev_*), its run and the next run.

    `sightings` has one row per key and run. Runs are cut into groups and the rows
    at a group's edges are repeated in the neighbouring group, so the window
    partitions stay small and still see every neighbour that matters. A
    neighbour further away than that may show as null, which means the same.
    """
    home = F.floor(F.col(seq) / RUNS_PER_GROUP)
    groups = F.array_distinct(
        F.array(
            home,
            F.floor((F.col(seq) - ABSENCES) / RUNS_PER_GROUP),
            F.floor((F.col(seq) + ABSENCES) / RUNS_PER_GROUP),
        )
    )
    spread = sightings.withColumn("_group", F.explode(groups))
    by_run = Window.partitionBy(*keys, "_group").orderBy(seq)
    seen = spread.select(
        "*",
        F.lag(seq).over(by_run).alias("prev_seq"),
        F.lead(seq).over(by_run).alias("next_seq"),
        *[F.lag(c).over(by_run).alias(f"prev_{c}") for c in carry],
    )
    return seen.where(F.col("_group") == home).drop("_group")


def _as_events(seen: DataFrame, seq: str, last: Column, strict: bool = False) -> DataFrame:
    """Zero to two events per sighting: new or price change in its run, removed two runs later."""
    run, prev, nxt = F.col(seq), F.col("prev_seq"), F.col("next_seq")
    near = F.coalesce(run - prev <= ABSENCES, F.lit(False))
    nothing = F.lit(None).cast("bigint")

    def event(kind, at, old_price, new_price, old_total, new_total, first, missing, removed):
        return F.struct(
            at.alias("event_seq"), F.lit(kind).alias("kind"),
            old_price.alias("old_price_czk"), new_price.alias("new_price_czk"),
            old_total.alias("old_total_czk"), new_total.alias("new_total_czk"),
            first.alias("first_seen_seq"), missing.alias("missing_since_seq"),
            removed.alias("removed_since_seq"),
        )

    changed = event(
        PRICE_CHANGE, run, F.col("prev_price_czk"), F.col("price_czk"),
        F.col("prev_total_czk"), F.col("total_czk"), nothing, nothing, nothing,
    )
    new = event(NEW, run, nothing, nothing, nothing, nothing, run, nothing, nothing)
    gone = event(REMOVED, run + ABSENCES, nothing, nothing, nothing, nothing, nothing, run + 1, run + ABSENCES)
    events = F.array_compact(
        F.array(
            F.when(near & _differs("{}", "prev_{}", strict), changed).when(~near & (run > 1), new),
            F.when((F.coalesce(nxt, last + 1) - run > ABSENCES) & (run + ABSENCES <= last), gone),
        )
    )
    return seen.select("*", F.inline(events))


def diff_runs(
    listings: DataFrame,
    last_run: Column | int | None = None,
    strict: bool = False,
    with_item: bool = True,
) -> DataFrame:
    """All events of a history of listings (one row per run_seq and listing_key).

    `last_run` is the last committed run; left out, it is the last run with rows.
    The stamps are run numbers here; `stamp_times` turns them into times. The item
    of an event holds all columns of `listings`, which travel through the shuffle:
    select what is wanted first, or leave the item out.
    """
    if last_run is None:
        last = listings.agg(F.max("run_seq")).scalar()
    else:
        last = last_run if isinstance(last_run, Column) else F.lit(last_run)
    rows = with_comparison(listings, strict)
    base = rows.select(
        "listing_key", "run_seq", *_carried(strict), *([item_of(listings)] if with_item else [])
    )
    seen = with_neighbours(base, ["listing_key"], _carried(strict))
    events = _as_events(seen.withColumn("_last", last), "run_seq", F.col("_last"), strict)
    return _finish(events, with_item)


def _finish(events: DataFrame, with_item: bool) -> DataFrame:
    renamed = {"run_seq": F.col("event_seq")}
    return events.select(
        *[renamed.get(c, F.col(c)).alias(c) for c in DIFF_COLUMNS if with_item or c != "item"]
    )


def diff_new_runs(listings: DataFrame, first_new: int, last_run: int, **options) -> DataFrame:
    """Events of the runs first_new..last_run only, from those runs and the two before.

    Equal to the matching part of the whole history's diff; with `listings`
    partitioned by run_seq, only those runs are read.
    """
    window = listings.where(F.col("run_seq").between(first_new - ABSENCES, last_run))
    return diff_runs(window, last_run, **options).where(F.col("run_seq").between(first_new, last_run))


def dense_calendar(source_runs: DataFrame) -> DataFrame:
    """source, run_seq, source_seq: the complete runs of each source, numbered from 1 without gaps."""
    in_order = Window.partitionBy("source").orderBy("run_seq")
    return source_runs.select("source", "run_seq").distinct().withColumn("source_seq", F.row_number().over(in_order).cast("bigint"))


def diff_by_source(listings: DataFrame, calendar: DataFrame, with_item: bool = True) -> DataFrame:
    """Diff over each source's own dense run numbers, mapped back to runs.

    Rows of runs that the calendar does not name for their source are left out.
    """
    in_order = Window.partitionBy("source").orderBy("source_seq")
    calendar = calendar.select(
        "source",
        "run_seq",
        "source_seq",
        F.max("source_seq").over(Window.partitionBy("source")).alias("_last"),
        # the runs an event of this one can name: one and two complete runs later
        *[F.lead("run_seq", n).over(in_order).alias(f"_run{n}") for n in (1, 2)],
    )
    rows = with_comparison(listings, strict=True)
    base = rows.select(
        "source", "listing_key", "run_seq", *_carried(True), *([item_of(listings)] if with_item else [])
    ).join(calendar, ["source", "run_seq"])
    seen = with_neighbours(base, ["source", "listing_key"], _carried(True), "source_seq")
    events = _as_events(seen, "source_seq", F.col("_last"), strict=True)

    def run_of(name: str) -> Column:
        later = F.col(name) - F.col("source_seq")
        return F.when(later == 0, F.col("run_seq")).when(later == 1, F.col("_run1")).when(later == 2, F.col("_run2"))

    stamps = ("event_seq", "first_seen_seq", "missing_since_seq", "removed_since_seq")
    events = events.withColumns({name: run_of(name) for name in stamps}).drop("run_seq")
    return _finish(events, with_item)


def diff_runs_strict(listings: DataFrame, source_runs: DataFrame, with_item: bool = True) -> DataFrame:
    """Diff that compares a source only over the runs in which it was read completely.

    `source_runs(source, run_seq)` lists those runs. Each source gets its own
    dense run numbers, the same closed form runs on them, and the result is
    mapped back; a source that failed for two runs no longer looks like a mass
    removal.
    """
    return diff_by_source(listings, dense_calendar(source_runs), with_item)


#: What a run knows of each source: how many complete runs it had so far, and the last of them, newest first.
SOURCE_STATE = T.StructType(
    [
        T.StructField("run_seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_seq", T.LongType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("recent", T.ArrayType(T.LongType())),
    ]
)


def step_source_states(before: DataFrame, complete: DataFrame, run_seq: int) -> DataFrame:
    """States of the sources at a run, from those at the run before and the `complete` sources (source) of this one."""
    run = F.lit(run_seq).cast("bigint")
    now = complete.select("source").distinct().withColumn("_now", F.lit(True))
    both = before.select("source", "source_seq", "recent").join(now, "source", "full_outer")
    read = F.coalesce("_now", F.lit(False))
    past = F.coalesce("recent", F.array().cast("array<bigint>"))
    return both.select(
        run.alias("run_seq"),
        "source",
        (F.coalesce("source_seq", F.lit(0)) + read.cast("bigint")).alias("source_seq"),
        read.alias("complete"),
        F.when(read, F.slice(F.concat(F.array(run), past), 1, ABSENCES + 1)).otherwise(past).alias("recent"),
    )


def source_states(source_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """States of the sources at each of `runs` (run_seq) at once; `source_runs(source, run_seq)` are the complete ones."""
    calendar = dense_calendar(source_runs)
    in_order = Window.partitionBy("source").orderBy("run_seq")
    past = [F.col("run_seq"), *[F.lag("run_seq", n).over(in_order) for n in range(1, ABSENCES + 1)]]
    known = calendar.withColumn("_recent", F.array_compact(F.array(*past)))
    last = runs.agg(F.max("run_seq")).scalar()
    since = calendar.groupBy("source").agg(F.min("run_seq").alias("_first")).where(F.col("_first") <= last)
    every = since.select("source", F.explode(F.sequence("_first", last)).alias("run_seq")).join(runs.select("run_seq"), "run_seq", "left_semi")
    states = every.join(known, ["source", "run_seq"], "left")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return states.select(
        "run_seq",
        "source",
        F.last("source_seq", ignorenulls=True).over(so_far).alias("source_seq"),
        F.col("source_seq").isNotNull().alias("complete"),
        F.last("_recent", ignorenulls=True).over(so_far).alias("recent"),
    )


def calendar_of(states: DataFrame) -> DataFrame:
    """source, run_seq, source_seq of all complete runs that the states of some runs name."""
    runs = states.select("source", "source_seq", F.posexplode("recent").alias("_age", "run_seq"))
    return runs.select("source", "run_seq", (F.col("source_seq") - F.col("_age")).alias("source_seq")).distinct()


def diff_new_runs_strict(listings: DataFrame, states: DataFrame, first_new: int, last_run: int, with_item: bool = True) -> DataFrame:
    """Events of the runs first_new..last_run only, each source over its own complete runs.

    `states` are the sources' states at these runs. They name the runs that
    matter: of each source those among the new ones and the two complete ones
    before, however long ago. With `listings` partitioned by run_seq, no other
    run is read. Equal to the matching part of `diff_runs_strict`.
    """
    calendar = calendar_of(states.where(F.col("run_seq").between(first_new, last_run)))
    wanted = [r["run_seq"] for r in calendar.select("run_seq").distinct().collect()]  # the new runs and two for each source at most
    events = diff_by_source(listings.where(F.col("run_seq").isin(wanted)), calendar, with_item)
    return events.where(F.col("run_seq").between(first_new, last_run))


def pending(listings: DataFrame, last_run: Column | int | None = None) -> DataFrame:
    """Listings missing from the last run only: candidates for removal, with their run."""
    if last_run is None:
        last = listings.agg(F.max("run_seq")).scalar()
    else:
        last = last_run if isinstance(last_run, Column) else F.lit(last_run)
    recent = listings.withColumn("_last", last).where(F.col("run_seq") >= F.col("_last") - 1)
    present = recent.where(F.col("run_seq") == F.col("_last")).select("listing_key")
    missing = recent.where(F.col("run_seq") == F.col("_last") - 1).join(present, "listing_key", "left_anti")
    return missing.withColumn("missing_since_seq", F.col("_last")).drop("_last")


def pending_strict(listings: DataFrame, states: DataFrame) -> DataFrame:
    """As `pending`, each source between its last two complete runs; `states` are those of the last run.

    A source that was not read in the last run has nothing new to wait for.
    """
    calendar = calendar_of(states.where("complete"))
    last = F.max("source_seq").over(Window.partitionBy("source"))
    ages = calendar.withColumn("_age", last - F.col("source_seq")).where("_age < 2").drop("source_seq")
    wanted = [r["run_seq"] for r in ages.select("run_seq").distinct().collect()]  # two for each source at most
    recent = listings.where(F.col("run_seq").isin(wanted)).join(ages, ["source", "run_seq"])
    present = recent.where("_age = 0").select("source", "listing_key")
    missing = recent.where("_age = 1").join(present, ["source", "listing_key"], "left_anti")
    now = ages.where("_age = 0").select("source", F.col("run_seq").alias("missing_since_seq"))
    return missing.join(now, "source").select(*listings.columns, "missing_since_seq")


def diff_pair(
    previous: DataFrame, pending_before: DataFrame, current: DataFrame, run_seq: Column | int, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """One step: (changes, pending) of `current` against the run before and its pending rows.

    All three are listing tables with one row per key. Pending rows replace
    previous rows of the same key.
    """
    names = [c for c in current.columns if c in previous.columns]
    before = union_preferring(
        previous.select(*names).withColumn("_pending", F.lit(False)),
        pending_before.select(*[c for c in names if c in pending_before.columns],
                              F.lit(True).alias("_pending")),
        ["listing_key"],
    )
    compared = [c for c in _carried(strict) if c != "total_czk"]
    old = with_comparison(before, strict).select(
        "listing_key", F.struct(*names).alias("old"), *[F.col(c).alias(f"old_{c}") for c in compared], "_pending"
    )
    new = with_comparison(current, strict).select(
        "listing_key", F.struct(*names).alias("new"), *[F.col(c).alias(f"new_{c}") for c in compared]
    )
    both = old.join(new, "listing_key", "full_outer")
    run = (run_seq if isinstance(run_seq, Column) else F.lit(run_seq)).cast("bigint")
    kind = (
        F.when(F.col("old").isNull(), NEW)
        .when(F.col("new").isNull() & F.col("_pending"), REMOVED)
        .when(F.col("new").isNotNull() & _differs("new_{}", "old_{}", strict), PRICE_CHANGE)
    )
    tagged = both.withColumn("kind", kind)

    def only(wanted: str, value: Column) -> Column:
        return F.when(F.col("kind") == wanted, value)

    changes = tagged.where(F.col("kind").isNotNull()).select(
        run.alias("run_seq"),
        "kind",
        "listing_key",
        only(PRICE_CHANGE, F.col("old.price_czk")).alias("old_price_czk"),
        only(PRICE_CHANGE, F.col("new.price_czk")).alias("new_price_czk"),
        only(PRICE_CHANGE, F.col("old.total_czk")).alias("old_total_czk"),
        only(PRICE_CHANGE, F.col("new.total_czk")).alias("new_total_czk"),
        only(NEW, run).alias("first_seen_seq"),
        only(REMOVED, run - 1).alias("missing_since_seq"),
        only(REMOVED, run).alias("removed_since_seq"),
        F.coalesce("new", "old").alias("item"),
    )
    waiting = both.where(F.col("new").isNull() & ~F.col("_pending")).select(
        "old.*", run.alias("missing_since_seq")
    )
    return changes, waiting


def stamp_times(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Replace the run-number stamps by the times of those runs."""
    for name in ("first_seen", "missing_since", "removed_since"):
        times = runs.select(F.col("run_seq").alias(f"{name}_seq"), F.col("generated_at").alias(name))
        changes = changes.join(times, f"{name}_seq", "left").drop(f"{name}_seq")
    return changes
