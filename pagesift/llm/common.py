"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* only the named columns are read (``select`` first), so extra columns, also
  ones that share a name with an internal column, never reach the plan;
* a null text counts as an empty text, a null id is kept in the result;
* repeated rows are separate rows unless an operator says otherwise;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift.session import ensure_checkpoint_dir

#: The six ASCII white-space characters that separate words, as a Java/RE2 class body.
WORD_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: ``df`` as a table in the shared folder; it survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else (``lower`` changes further letters, so only all-ASCII texts go there)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, upper, upper.lower())))


def is_held_out(id_col: Column) -> Column:
    """The fixed fold: crc32 of the id as text is divisible by 5 (a null id is not held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 7,
                  id_col: str = "doc_id", text_col: str = "text", max_chars: int = 200_000_000) -> list:
    """A bounded sample of labelled training rows: at most ``per_class`` of each label and
    ``max_chars`` of text, half of it for each label, as ``(text, label, id)`` tuples on the driver.

    Held-out rows, null ids, null labels and null texts are left out. The rows
    are those with the smallest seeded hash of their id, so reruns agree; both
    bounds hold before a text leaves the executors. Of rows that repeat an id
    the smaller label and the smaller text count.
    """
    ids = (labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
           .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out(F.col("id")))
           .groupBy("id").agg(F.min("y").alias("y")))
    order = F.xxhash64(F.lit(seed), F.col("id"))
    picked = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(order, "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = picked.collect()  # at most 2 * per_class ids
    if not rows:
        return []
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["id"], r["y"]) for r in rows], "id long, y int")
    texts = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
             .join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")))
    texts = written(texts, "labelled")
    before = Window.partitionBy("y").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, 0)  # per_class rows at most
    within = texts.withColumn("chars", F.sum(F.char_length("text")).over(before)).where(F.col("chars") <= max_chars // 2)
    out = sorted(((r["text"], r["y"], r["id"]) for r in within.select("text", "y", "id").collect()), key=lambda r: r[2])
    drop_written(texts)
    return out


def text_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow string column, nulls as empty texts."""
    return [t or "" for t in column.to_pylist()]


def slices(batches, rows: int = 256, max_bytes: int | None = None):
    """Arrow batches cut into slices of a few rows, so that a batch of very long texts stays small;
    with ``max_bytes`` into slices of about so many bytes (one row at least) instead."""
    for b in batches:
        step = rows if max_bytes is None else max(1, b.num_rows * max_bytes // max(max_bytes, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


class Recent(dict):
    """A bounded memo: ``compute(key)`` of the keys asked for lately. When ``limit`` keys have
    come together they become the old generation, and the one before that is forgotten."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def per_worker(key: tuple, make):
    """``make()``, kept by the Python worker until it is asked for something else. The package's
    functions are pickled by value, so a module's own variables are new in every task; this store is
    the process's. It holds one object: a worker goes from stage to stage, and what an earlier
    stage has kept would only add up."""
    store = sys.__dict__.setdefault("_pagesift_kept", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]
