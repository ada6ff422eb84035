"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


BATCH_ROWS, BATCH_BYTES = 256, 8 << 20  # of an Arrow batch of pages


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "pagesift") -> SparkSession:
    """Local session for tests and benches; on a cluster use the ambient session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # one page per Arrow row: cap batches by rows and by bytes so a batch
        # of very large pages still fits in a Python worker
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; on a local master a scratch one is set if
    there is none, on any other it has to be configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    master = getattr(sc, "master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="pagesift-ckpt-")  # tests / local runs only
    sc.setCheckpointDir(path)
    return path


def bounded_batches(spark: SparkSession) -> None:
    """Lower the rows and bytes of an Arrow batch to ``BATCH_ROWS`` and ``BATCH_BYTES`` where the session has
    Spark's defaults: a row is a whole page here, and a Python worker holds a batch several times over."""
    for key, default, bound in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(bound))


def materialize(df, tag: str = "stage"):
    """Cut lineage: write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Unlike ``checkpoint()`` on an unpersisted plan this computes the input
    once; the files survive the loss of any executor.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/pagesift-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
