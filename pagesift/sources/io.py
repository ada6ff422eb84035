"""Sources and sinks as Spark readers/writers.

* ``read_tables`` — the parquet test tables.
* ``read_html_folder`` — IO-01..IO-03: a folder of ``*.html`` files whose
  stem is the base64 of the URL, read whole-file by the text source.
* ``read_gold_lines`` — IO-04/IO-05: text files with one Python dict literal
  per line (lines not starting with '{' are ignored), parsed by
  ``from_json`` (single quotes accepted), never evaluated.
* vectors, labels, normalisation parameters, bodies — IO-06..IO-11.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("pages", "documents", "labels")

GOLD_SCHEMA = T.StructType([
    T.StructField("Filename", T.StringType()),
    T.StructField("Body text", T.StringType()),
    T.StructField("Website", T.StringType()),
])


#: The order of gold lines.
_LINE = ("source", "file", "block", "line_no")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has cores.

    Large inputs are split by the file source into many partitions and pass
    through untouched; a small file with one row group would otherwise run
    every narrow per-page step (entity decoding, the fold) in a single task.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("pages", "documents") else df


def read_html_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """IO-01..03: (page_id, key, url, html) from ``folder/*.html``; url = base64-decoded stem.

    ``page_id`` is a 64-bit hash of the stem (stable across re-reads and
    partitionings); ``key`` is kept as the exact identity (with 1e9 pages the
    chance of any 64-bit collision is about 3%)."""
    # as arguments: text() sets wholetext itself and would put an option back to false
    df = (spark.read.text(folder, wholetext=True, pathGlobFilter="*.html", recursiveFileLookup=recursive)
          .select(F.col("value").alias("html"), F.input_file_name().alias("path")))
    key = F.regexp_extract(F.col("path"), r"([^/]+)\.html$", 1)
    url = F.try_validate_utf8(F.try_to_binary(key, F.lit("base64")).cast("string"))  # null: the stem is no coded URL
    return df.select(F.xxhash64(key).alias("page_id"), key.alias("key"), url.alias("url"), "html")


def read_gold_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """IO-04/05: (filename, body_text, website, source, file, block, line_no, line); unparsable lines are dropped
    here and reported by ``bad_gold_lines``.

    ``source`` (place among ``paths``), ``file``, ``block`` (offset of the split in its file) and ``line_no`` (rises
    within a split) order the lines as they stand in the files, however the scan cuts and deals these."""
    parts = []
    for i, p in enumerate(paths):
        t = spark.read.text(p).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                                      F.col("_metadata.file_block_start").alias("block"))
        t = t.withColumn("line_no", F.monotonically_increasing_id()).withColumn("source", F.lit(i))
        parts.append(t)
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.filter(F.col("line").startswith("{"))
    # what a printed dict may hold and JSON may not: \xHH escapes and a bare None
    as_json = F.regexp_replace("line", r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    as_json = F.regexp_replace(as_json, r"""(['"](?:Website|Filename|Body text)['"]\s*:\s*)None(?=\s*[,}])""", "$1null")
    j = F.from_json(as_json, GOLD_SCHEMA, {"allowSingleQuotes": "true", "mode": "PERMISSIVE",
                                           "allowBackslashEscapingAnyCharacter": "true"})
    return df.select(j.alias("g"), *_LINE, "line").select(
        F.col("g.Filename").alias("filename"), F.col("g.`Body text`").alias("body_text"),
        F.col("g.Website").alias("website"), *_LINE, "line")


def bad_gold_lines(gold: DataFrame) -> DataFrame:
    """Lines that start with '{' but do not parse as a gold record (quarantine)."""
    return gold.filter(F.col("filename").isNull()).select(*_LINE, "line")


def first_gold_per_key(gold: DataFrame) -> DataFrame:
    """J-01/W-05: the first line per filename wins (by source, file and place in the file)."""
    order = F.struct(*_LINE)
    g = gold.filter(F.col("filename").isNotNull()).groupBy("filename").agg(
        F.min_by(F.struct("body_text", "website"), order).alias("g"))
    return g.select("filename", "g.body_text", "g.website")


def write_gold_lines(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", website: str = "") -> None:
    """The inverse of ``read_gold_lines``: one printed Python dict per line."""
    def run(batches):
        for b in batches:
            lines = [str({"Website": website, "Filename": k, "Body text": t}) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    documents.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_vectors_csv(vectors: DataFrame, path: str, key: str = "term") -> None:
    """IO-06: CSV with the vector as a JSON list."""
    vectors.select(F.col("term").alias(key), F.to_json("vector").alias("vector")) \
           .write.mode("overwrite").option("header", True).csv(path)


def read_vectors_csv(spark: SparkSession, path: str, key: str = "term") -> DataFrame:
    """IO-07: keys stay strings (no 'nan'/'null' coercion), vectors parsed as array<double>."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("vector", T.StringType())])
    df = spark.read.option("header", True).option("nullValue", "\u0000").schema(schema).csv(path)
    return df.select(F.col(key).alias("term"), F.from_json("vector", "array<double>").alias("vector"))


def write_labels_tsv(labels: DataFrame, path: str, per_page: bool = False) -> None:
    """IO-08: label rows as TSV (page_id, index, text, label).

    The default writes one dataset whose files are cut by Spark tasks; one
    folder per page (``per_page=True``, the original layout) is only sensible
    for small corpora — with millions of pages it creates millions of
    directories."""
    out = labels.select("page_id", F.col("idx").alias("index"), F.col("content").alias("text"), "label")
    w = out.write.mode("overwrite").option("sep", "\t").option("header", True)
    (w.partitionBy("page_id") if per_page else w).csv(path)


def save_params(params: DataFrame, path: str) -> None:
    """IO-09: the one-row normalisation parameters as parquet."""
    params.coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bodies(bodies: DataFrame, path: str) -> None:
    """IO-11."""
    bodies.write.mode("overwrite").parquet(path)
