"""Session and working-folder helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = 8, app: str = "offerwatch", partitions: int | None = None) -> SparkSession:
    """A session for tests and the benchmark. On a cluster the caller brings its own."""
    partitions = partitions or (int(cores) if str(cores).isdigit() else 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # noting the call site of every column expression is over a third of the time that wide plans take to build
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach.

    It lies under the shared folder named by spark.checkpoint.dir. Where that is
    unset, a local session takes the warehouse; on a cluster that may be a folder
    of the driver alone, so there the setting is asked for.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/offerwatch/{name}-{uuid.uuid4().hex}"
