"""Incremental form: committed runs arrive as a stream.

Absence can only be known once a run is complete, so it is the manifest that
drives removal, not a watermark. A run's events depend on its own rows and
those of the two runs before it; the listings table is all the state there is,
and replaying a run rewrites the same partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from offerwatch import schemas
from offerwatch.config import DEFAULTS, MonitorConfig
from offerwatch.operators import diff, watch
from offerwatch.plans import monitor
from offerwatch.plans.monitor import WATCH_STATE, WATCHED_READS
from offerwatch.plans.store import Store


def _new_span(batch: DataFrame) -> tuple[int, int] | None:
    low, high = batch.agg(F.min("run_seq"), F.max("run_seq")).first()
    return None if low is None else (low, high)


LANDED, INCOMPLETE, COMMITTED, GIVEN_UP = "landed", "incomplete", "committed", "given_up"

#: The queue is a log: each row is a step of a run, the last one says how it stands.
QUEUE = schemas.struct("run_id string, generated_at timestamp, step bigint, state string, tries bigint")


def run_queue(store: Store) -> DataFrame:
    """How each landed run stands: run_id, generated_at, step, state, tries."""
    steps = store.read_or_empty("run_queue", QUEUE)
    last = steps.groupBy("run_id").agg(F.max_by(F.struct("generated_at", "step", "state", "tries"), "step").alias("_last"))
    return last.select("run_id", "_last.*")


def _log(store: Store, steps: DataFrame) -> None:
    steps.select(*[F.col(f.name).cast(f.dataType) for f in QUEUE.fields]).coalesce(1).write.mode("append").parquet(store.path("run_queue"))


def enqueue(store: Store, landed: DataFrame) -> None:
    """Put landings (run_id, generated_at) at the end of the queue; those that are in it or committed are left alone."""
    known = run_queue(store).select("run_id").unionByName(store.runs().select("run_id"))
    fresh = landed.groupBy("run_id").agg(F.min("generated_at").alias("generated_at")).join(known, "run_id", "left_anti")
    _log(store, fresh.withColumns({"step": F.lit(0), "state": F.lit(LANDED), "tries": F.lit(0)}))


def work_queue(store: Store, pages: DataFrame, cfg: MonitorConfig = DEFAULTS, patience: int = 3, on_incomplete=None) -> None:
    """Process the open runs in order, each tested again however often it was incomplete.

    An incomplete run keeps later ones waiting, since each is compared with the
    one before, but not for ever: at the `patience`th try it is given up and the
    next one takes its number. `on_incomplete` is told each time.
    """
    done = {r["run_id"] for r in store.runs().select("run_id").join(run_queue(store), "run_id", "left_semi").collect()}
    open_ = run_queue(store).where(F.col("state").isin(LANDED, INCOMPLETE)).orderBy("generated_at", "run_id").collect()
    for row in open_:
        tries = row["tries"] + 1
        try:
            if row["run_id"] not in done:  # one that was committed just before its job died is only noted
                monitor.run(store, pages, row["run_id"], row["generated_at"], cfg)
            state = COMMITTED
        except monitor.IncompleteRun:
            state = GIVEN_UP if tries >= patience else INCOMPLETE
            if on_incomplete:
                on_incomplete(row["run_id"])
        step = (row["run_id"], row["generated_at"], row["step"] + 1, state, tries)
        _log(store, store.spark.createDataFrame([step], QUEUE))
        if state == INCOMPLETE:
            return


def stream_runs(
    store: Store,
    pages: DataFrame,
    landed_path: str,
    checkpoint: str,
    cfg: MonitorConfig = DEFAULTS,
    patience: int = 3,
    on_incomplete=None,
) -> StreamingQuery:
    """The periodic job: queue every run that has landed since the last time, then work on all open ones.

    `landed_path` holds one row (run_id, run_seq, generated_at) per finished
    landing. A run that is already queued or committed is skipped, so a replayed
    batch does no harm; open runs are tested again each time the job is called,
    whether anything new has landed or not.
    """
    landed = store.spark.readStream.schema(schemas.RUNS).parquet(landed_path)

    def process(batch: DataFrame, _batch_id: int) -> None:
        enqueue(store, batch)

    writer = landed.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    work_queue(store, pages, cfg, patience, on_incomplete)
    return query


def stream_changes(
    store: Store,
    checkpoint: str,
    out_table: str = "changes",
    runs_per_batch: int | None = None,
    strict: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """Write the changes of every newly committed run to `out_table`; `strict` as in the settings of a market."""
    reader = store.spark.readStream.schema(schemas.RUNS)
    if runs_per_batch:
        reader = reader.option("maxFilesPerTrigger", runs_per_batch)
    manifest = reader.parquet(store.path("runs"))

    def process(batch: DataFrame, _batch_id: int) -> None:
        span = _new_span(batch)
        if span is None:
            return
        first, last = span
        events = monitor.new_events(store, first, last, strict)
        store.write_runs(out_table, diff.stamp_times(events, store.runs()))

    writer = manifest.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_watch_states(
    store: Store,
    checkpoint: str,
    out_table: str = "watched_states",
    reads_schema: T.StructType = WATCHED_READS,
    state_schema: T.StructType = WATCH_STATE,
    runs_per_batch: int | None = None,
) -> StreamingQuery:
    """Carry watched states forward: all runs of a batch in one job, from the states of the run before it."""
    reader = store.spark.readStream.schema(schemas.RUNS)
    if runs_per_batch:
        reader = reader.option("maxFilesPerTrigger", runs_per_batch)
    manifest = reader.parquet(store.path("runs"))

    def process(batch: DataFrame, _batch_id: int) -> None:
        span = _new_span(batch)
        if span is None:
            return
        first, last = span
        before = store.of_run(out_table, state_schema, first - 1)
        reads = store.of_runs("watched_reads", reads_schema, first, last)
        store.write_runs(out_table, watch.carry_on(before, reads, first))

    writer = manifest.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
