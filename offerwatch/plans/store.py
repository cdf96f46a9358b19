"""Run store: parquet tables partitioned by run, made visible by a manifest row.

A run's partitions are written first and its row in `runs` last. Readers only
see runs the manifest lists, so a run that died half-way is invisible and can
simply be written again over its own partitions. Numbers of runs and versions of
the watch list are given out by markers that only one writer can make.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerwatch import schemas
from offerwatch.plans import markers


def run_name(generated_at: datetime) -> str:
    """Compact UTC name of a run; a time without a zone is local, as Spark takes it."""
    return generated_at.astimezone(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


class RunInProgress(RuntimeError):
    """Another landing has the next run number and has not committed it."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read_or_empty(self, table: str, schema: T.StructType) -> DataFrame:
        """The whole table as it lies there; one that was never written is empty."""
        try:
            # a partition column comes back last; item structs rely on the schema's order
            return self.spark.read.schema(schema).parquet(self.path(table)).select(*schema.names)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return schemas.empty(self.spark, schema)

    # ------------------------------------------------------------------ writing

    def write_run(self, table: str, df: DataFrame, run_seq: int) -> None:
        """Write one run's partition; writing it again replaces it."""
        df.drop("run_seq").write.mode("overwrite").parquet(f"{self.path(table)}/run_seq={run_seq}")

    def write_runs(self, table: str, df: DataFrame) -> None:
        """Write the partitions of all runs in `df`, replacing those and no others.

        Rebalancing first gathers a run's rows into few files and still splits a
        run that is much larger than the rest.
        """
        (
            df.hint("rebalance", F.col("run_seq"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_seq")
            .parquet(self.path(table))
        )

    def claim_run(self, run_id: str) -> int:
        """The number of the run after the last committed one, for the landing `run_id` alone.

        A number is given once: of two writers at once one gets it, and the other
        is told whose it is and comes again when that run is committed. A landing
        that died half-way gets its number again. `release_run` gives it back.
        """
        while True:
            run_seq = (self.last_run() or 0) + 1
            if markers.put_if_absent(self.spark, self.path("run_claims"), run_seq, run_id):
                if (self.last_run() or 0) < run_seq:
                    return run_seq
                continue  # committed between the look and the claim, by a writer that knows no claims
            owner = markers.read(self.spark, self.path("run_claims"), run_seq)
            if owner == run_id:
                return run_seq
            if owner is not None and (self.last_run() or 0) < run_seq:
                raise RunInProgress(run_seq, owner)

    def release_run(self, run_seq: int) -> None:
        markers.remove(self.spark, self.path("run_claims"), run_seq)

    def commit(self, run_seq: int, generated_at: datetime | None = None, run_id: str | None = None) -> None:
        """Make a run visible. Its name is its time unless the landing gave it one."""
        generated_at = generated_at or datetime.now(timezone.utc)
        row = self.spark.range(1).select(
            F.lit(run_id or run_name(generated_at)).alias("run_id"), F.lit(generated_at).cast("timestamp").alias("generated_at")
        )
        self.write_run("runs", row, run_seq)

    # ------------------------------------------------------------------ reading

    def runs(self) -> DataFrame:
        return self.read_or_empty("runs", schemas.RUNS)

    def last_run(self) -> int | None:
        return self.runs().agg(F.max("run_seq")).first()[0]

    def committed(self, table: str, schema: T.StructType) -> DataFrame:
        """Rows of committed runs."""
        return self.read_or_empty(table, schema).join(self.runs().select("run_seq"), "run_seq", "left_semi").select(
            *schema.names
        )

    def of_runs(self, table: str, schema: T.StructType, first: int, last: int) -> DataFrame:
        """Rows of the runs first..last; other runs' folders are pruned."""
        return self.read_or_empty(table, schema).where(F.col("run_seq").between(first, last))

    def of_run(self, table: str, schema: T.StructType, run_seq: int | None) -> DataFrame:
        """Rows of one run."""
        if run_seq is None:
            return schemas.empty(self.spark, schema)
        return self.of_runs(table, schema, run_seq, run_seq)

    def latest(self, table: str, schema: T.StructType) -> DataFrame:
        """Rows of the last committed run; empty before the first."""
        return self.of_run(table, schema, self.last_run())

    # --------------------------------------------------------------- watch list

    def watchlist(self, version: int | None = None) -> DataFrame:
        """The list as of a version, or as it is now."""
        version = version or self.watchlist_version()
        if version is None:
            return schemas.empty(self.spark, schemas.WATCHLIST)
        written = markers.read(self.spark, self.path("watchlist_versions"), version)
        return self.read_or_empty(f"watchlist/{written}", schemas.WATCHLIST)

    def watchlist_version(self) -> int | None:
        return markers.last(self.spark, self.path("watchlist_versions"))

    def write_watchlist(self, watchlist: DataFrame) -> None:
        """Write the list as the newest version, whatever the one before holds."""
        self.edit_watchlist(lambda _: watchlist)

    def edit_watchlist(self, edit: Callable[[DataFrame], DataFrame]) -> int:
        """Make `edit` of the present list its next version; returns the version.

        The new list is written to a folder of its own, then its version is
        claimed. Who loses a version to another writer starts again from that
        one's list, so no edit is lost.
        """
        while True:
            before = self.watchlist_version()
            now = self.watchlist(before) if before else schemas.empty(self.spark, schemas.WATCHLIST)
            written, version = uuid.uuid4().hex, (before or 0) + 1
            edit(now).select(*schemas.WATCHLIST.names).write.parquet(f"{self.path('watchlist')}/{written}")
            if markers.put_if_absent(self.spark, self.path("watchlist_versions"), version, written):
                return version
