"""Session defaults shared by tests, bench and entry points."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the library expects.

    On a cluster the settings come from spark-submit; only the time zone and
    AQE matter for results and plans.
    """
    return (
        SparkSession.builder.master(master)
        .appName("barloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A local run has a handful of partitions already; merging them would
        # only take cores away.  On a cluster leave this on.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def pin_utc(spark: SparkSession) -> SparkSession:
    """All timestamps are zone-free UTC, so the session zone must be UTC too."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster.

    Reads ``spark.checkpoint.dir``.  Only a local session (one machine, as in
    tests) may leave it unset: a fresh folder is then made and recorded on the
    session.  On a cluster a machine-local folder would lose rows, so it is refused.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set(CHECKPOINT_CONF, path)
    return path


def cut_lineage(df, partition_by: list[str] | None = None):
    """Write ``df`` to the shared folder and read it back.

    Used where one expensive frame feeds several passes: the written copy
    survives lost executors and stops the plan from being computed twice.
    Files stay in the folder; the cluster's retention rule removes them.
    """
    import uuid

    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "tables", uuid.uuid4().hex)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
