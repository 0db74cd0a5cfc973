"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every operator here relies on. Timestamps are UTC instants; exchange-local days are
# derived with from_utc_timestamp. AQE re-plans joins from measured sizes and splits skewed
# join partitions, so a dimension is broadcast only when its size is known to be small.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Keyed state lies on the executors' disks and in the checkpoint, not in their heaps.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Settings only a new session can take. Recording the Python call site of every column expression
# would otherwise dominate plan building.
STATIC_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Checkpoint files go away with the DataFrames that own them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "ledgertide", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**STATIC_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that someone else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the reliable folder the cluster names.

    Only a session without a configured folder (tests, local runs) gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ledgertide-checkpoint-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
