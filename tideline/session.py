"""Session defaults. Sizes that depend on the cluster stay with AQE."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "tideline", **conf: str) -> SparkSession:
    """The active session, or a new one with UTC and RocksDB state."""
    if (found := SparkSession.getActiveSession()) is not None:
        return found
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names, which all executors and the driver share. Where it
    is unset and all run on one machine (tests) that is a temporary folder; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tideline-"))
    return df.checkpoint()
