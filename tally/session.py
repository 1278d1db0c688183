"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, partitions: int | None = None, app: str = "tally") -> SparkSession:
    """Build (or fetch) a session with the settings the library assumes.

    AQE stays on so shuffle partition counts adapt at run time; the UI is off
    because jobs here are batch and nothing may listen on a port.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if partitions:  # otherwise the cluster's own setting holds
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Executors read what others wrote there, so it has to be set unless the master
    is local; only local runs and tests get a scratch folder of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:  # already set (Spark appends its own sub-folder; never set it again)
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tally-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()
