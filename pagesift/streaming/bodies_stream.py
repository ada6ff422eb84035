"""Length-rule bodies over a stream of page files.

Cleaning, the fold and node text are per-row and stateless, so the batch
operators apply unchanged to a ``readStream`` of pages; no watermark or
state is needed. Output goes to any sink (``foreachBatch`` for exactly-once
writes into a table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pagesift.operators import bodies as B
from pagesift.operators import dom as D

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def stream_pages(spark: SparkSession, folder: str, glob: str = "pages*.parquet",
                 max_files: int = 1) -> DataFrame:
    return (spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", glob).parquet(folder))


def rule_bodies_stream(pages: DataFrame) -> DataFrame:
    """Streaming DataFrame of (page_id, body) from the length rules alone."""
    return B.rule_bodies(D.page_events(D.clean_pages(pages)))


def model_bodies_stream(pages: DataFrame, extractor, out_path: str, checkpoint: str):
    """Bodies from a fitted ``BodyExtractor`` for a stream of pages.

    Each micro-batch is an ordinary DataFrame, scored by the extractor's
    one-pass ``transform`` and appended to a parquet table partitioned by
    batch id; a replayed batch overwrites its own partition, so output is
    exactly once. Returns the started ``StreamingQuery``."""
    from pyspark.sql import functions as F

    def write_batch(df: DataFrame, batch_id: int) -> None:
        out = extractor.transform(df).withColumn("batch_id", F.lit(batch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(out_path))

    return (pages.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint).start())
