"""Skew-aware equi-join: split hot keys across tasks without relying on AQE.

``hot_keys`` counts rows per key with partial aggregation and keeps keys
above a threshold; the result is bounded by ``rows / min_rows`` and is
joined as a broadcast. ``salted_join`` then spreads each hot key of the
large side over ``buckets`` salts (by a hash of a row id) and replicates the
matching rows of the other side ``buckets`` times; cold keys keep salt 0,
so nothing else is replicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Keys carrying at least ``min_rows`` rows (at most rows/min_rows of them)."""
    return df.groupBy(key).count().filter(F.col("count") >= min_rows).select(key, F.lit(True).alias("_hot"))


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, row_id: str,
                buckets: int = 32, how: str = "inner") -> DataFrame:
    """``big ⋈ small`` on ``key``; rows of hot keys are spread over ``buckets`` tasks."""
    hb = F.broadcast(hot)
    b = big.join(hb, key, "left")
    # null keys meet nothing; in an outer join they would otherwise all go to one task
    b = b.withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(F.col(row_id)), F.lit(buckets)))
                     .otherwise(F.lit(0)).cast("int")).drop("_hot")
    s = small.join(hb, key, "left")
    s = s.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(buckets - 1)))
                                        .otherwise(F.array(F.lit(0))))).drop("_hot")
    return b.join(s, [key, "_salt"], how).drop("_salt")
