"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch of texts.
TEXT_BATCH_BYTES = 2 << 20


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quillspark", **extra: str) -> SparkSession:
    """Build or get a session. On a cluster pass neither master nor partition count:
    spark-submit supplies the first and AQE coalesces the default of the second."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster. Only a local session, which has one
    machine by definition, may fall back to a temporary folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current:
        return current
    if configured:
        context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


@contextmanager
def arrow_batches(spark: SparkSession, size: int = TEXT_BATCH_BYTES) -> Iterator[None]:
    """What runs inside passes batches of about so many bytes to Python, not 10 000 rows of any length, so that neither
    side holds buffers in proportion to the texts. A row stays whole. A size that the user has set holds."""
    before = spark.conf.get(ARROW_BYTES, None)
    if before is None:
        spark.conf.set(ARROW_BYTES, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_BYTES)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing df once to the shared checkpoint folder and reading it back. Unlike
    checkpoint() this computes df a single time; lost executors read it again from there."""
    target = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
