"""Exact top-k search by tiled matrix products.

Candidates are dealt by a hash of their id into shards and queries into
blocks, both of a bounded number of rows. Every (shard, block) pair is one
tile: a group that holds one shard and one block, multiplies them and keeps
each query's k best of that shard by partial selection. The lists of a query
are then merged as a tree of ``FAN_IN``-way merges, so no group ever holds more
than ``FAN_IN * k`` entries.

Vectors are integers (``floor(scale * x)``), so scores are exact: the product
runs in float32 while all sums stay below 2**24, in float64 below 2**53, and
in Python integers beyond (clipped to 2**63 - 1 either way); only the rows with large
components are multiplied that way, not the tile they stand in.

Defined cases: vectors that are null, or hold null or non-finite components
(also ones that are not finite once scaled), and rows without id take no part; shorter vectors count as padded with zeros;
a query never meets rows that carry its own id; rows that repeat a query come
out once each; ties go to the smaller id; fewer candidates than k: all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_ROWS = 8192
FAN_IN = 16
_SUB = 512
_LISTS = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("times", pa.int64()), ("shard", pa.int64()),
                    ("best", pa.list_(pa.struct([("down", pa.int64()), ("id", pa.int64())])))])


def usable(vector: Column, scale: float = 1.0) -> Column:
    """True where a vector is not null and all its components are finite numbers, also after scaling."""
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < inf) & (F.abs(x.cast("double")) < inf))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _matrix(column: pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    rows = column.combine_chunks()
    lengths = np.diff(rows.offsets.to_numpy()) if len(rows) else np.zeros(0, int)
    flat = np.floor(scale * rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(rows), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two integer-valued matrices."""
    tops = np.abs(q).max(axis=1, initial=0), np.abs(c).max(axis=1, initial=0)
    top = float(tops[0].max(initial=0)) * float(tops[1].max(initial=0)) * q.shape[1]
    if top < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if top < 2**53:
        return (q @ c.T).astype(np.int64)
    limit = np.sqrt(2.0**53 / max(1, q.shape[1])) * (1 - 1e-9)
    out = np.zeros((len(q), len(c)), np.int64)
    small, large = zip(*((np.flatnonzero(t < limit), np.flatnonzero(t >= limit)) for t in tops))
    out[np.ix_(small[0], small[1])] = (q[small[0]] @ c[small[1]].T).astype(np.int64)
    every = np.arange(len(c))
    for rows, cols in ((large[0], every), (small[0], large[1])):
        if len(rows) and len(cols):
            out[np.ix_(rows, cols)] = _whole(q[rows], c[cols])
    return out


def _whole(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The products in Python integers, clipped to 2**63 - 1 either way."""
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(whole, 1 - 2**63, 2**63 - 1).astype(np.int64)


def _tile(k: int, scale: float):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not queries.num_rows:  # a side without rows may come without columns
            return pa.Table.from_pylist([], schema=_LISTS)
        lists: list[list[dict]] = []
        if candidates.num_rows:
            order = np.argsort(candidates["id"].to_numpy(), kind="stable")  # ties: smaller id first
            candidates = candidates.take(pa.array(order))
            sides = candidates["vector"], queries["query_vector"]
            width = max(int(np.diff(v.combine_chunks().offsets.to_numpy()).max(initial=0)) for v in sides)
            c, q = (_matrix(v, width, scale) for v in sides)
            c_ids, q_ids = candidates["id"].to_numpy(), queries["query_id"].to_numpy()
            for at in range(0, len(q), _SUB):
                scores = _products(q[at:at + _SUB], c)
                for row, own in zip(scores, q_ids[at:at + _SUB]):
                    others = np.flatnonzero(c_ids != own)
                    row = row[others]
                    if len(row) > k:  # keep all that tie with the k-th, then the smaller ids
                        kth = np.partition(row, len(row) - k)[len(row) - k]
                        near = np.flatnonzero(row >= kth)
                        near = near[np.argsort(-row[near], kind="stable")][:k]
                    else:
                        near = np.argsort(-row, kind="stable")
                    lists.append([{"down": -int(row[i]), "id": int(c_ids[others[i]])} for i in near])
        else:
            lists = [[] for _ in range(queries.num_rows)]
        return pa.table([queries["query"], queries["query_id"], queries["times"], queries["shard"],
                         pa.array(lists, _LISTS.field("best").type)], schema=_LISTS)
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0,
           id_col: str = "vec_id", vector_col: str = "embedding",
           shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, id, score``: the k best rows for every row of ``vectors`` that
    ``is_query`` (a condition on the id, named ``id``) selects."""
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
            .where(F.col("id").isNotNull() & usable(F.col("vector"), scale)))
    n, n_queries = rows.select(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / block_rows))
    candidates = (rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
                  .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    queries = (rows.where(is_query).groupBy(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
               .agg(F.count(F.lit(1)).alias("times")).withColumn("query", F.xxhash64("query_id", "query_vector"))
               .withColumn("block", F.pmod(F.col("query"), F.lit(blocks)))
               .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    tile = ["shard", "block"]
    lists = (candidates.groupBy(*tile).cogroup(queries.groupBy(*tile))
             .applyInArrow(_tile(k, scale), "query long, query_id long, times long, shard long, "
                                            "best array<struct<down:long,id:long>>"))
    while shards > 1:
        shards = math.ceil(shards / FAN_IN)
        lists = (lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
                 .groupBy("query", "query_id", "times", "shard")
                 .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")))
    # a query that rows repeat comes out as often
    lists = lists.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return (lists.select("query_id", F.posexplode("best").alias("nth", "hit"))
            .select("query_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("hit.id").alias("id"),
                    (-F.col("hit.down")).alias("score")))
