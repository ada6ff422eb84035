"""Deterministic stratified folds and class weights (W-03, A-07, T-03).

A node's fold is ``rank % k`` where ``rank`` orders the nodes of one label
by md5(seed#key). The rank is computed without a window partitioned by
label (that would put a whole class into one task). The leading hex digits
of the hash give a bucket that is monotone in the hash and uniform by
construction, so ``repartition(label, bucket)`` spreads every label over
all tasks without a sampling pass. Inside a partition rows are sorted by
(label, bucket, hash); a row's rank is its offset inside its (label,
bucket) run plus the sizes of the earlier buckets of its label, taken from
a count table bounded by labels x buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift import config as C
from pagesift.config import Options
from pagesift.session import materialize


def fold_hash(seed: int, *keys: str):
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified_folds(df: DataFrame, label: str = "label", keys=("page_id", "pos"),
                     opts: Options = Options(), n_buckets: int | None = None) -> DataFrame:
    """Add ``fold`` in [0, n_folds): per label, folds differ in size by at most one.

    The sorted table with its row ids is written once to the shared
    checkpoint folder and read twice (counts, then ranks): both reads see the
    same ids even if AQE coalesces the repartition differently between runs,
    and the upstream pipeline is not run twice.

    Rows without a label (a page whose gold text is null) get no fold and are left out.
    """
    k = opts.n_folds
    if opts.fold_group:
        df = materialize(df.filter(F.col(label).isNotNull()), "grouped")  # read for the groups' counts and again for the folds
        # merged: paths repeat, so nodes that a broadcast's threshold lets pass by their bytes on disk may not fit the
        # driver. Written, since a fit reads the folds several times and the join would move all rows each time
        folds = group_folds(df, label, opts).select(opts.fold_group, "fold")
        return materialize(df.hint("merge").join(folds, opts.fold_group), "folds")
    spark = df.sparkSession
    n = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    h = fold_hash(opts.seed, *keys)
    bucket = F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32) * n).cast("int")
    s = (df.withColumn("_h", h).withColumn("_b", bucket)
           .repartition(label, "_b")
           .sortWithinPartitions(label, "_b", "_h", *keys)
           .withColumn("_m", F.monotonically_increasing_id()))
    s = materialize(s, "folds")
    cnt = s.groupBy(label, "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))  # labels x buckets rows
    out = s.join(F.broadcast(cnt.select(label, "_b", "_m0", "_off")), [label, "_b"])
    rank = F.col("_off") + (F.col("_m") - F.col("_m0"))
    return out.withColumn("fold", F.pmod(rank, F.lit(k)).cast("int")).drop("_h", "_b", "_m", "_m0", "_off")


def group_folds(df: DataFrame, label: str = "label", opts: Options = Options()) -> DataFrame:
    """Whole groups (pages) dealt to folds by their label counts: (group, n_pos, n_rows, fold).

    The groups stand by positive rows, those with the same number by rows, rising
    for even numbers and falling for odd ones, and every ``n_folds``
    consecutive ones go to different folds, in an order that turns by one from
    block to block. Two folds differ within a block by its range at most, and the
    blocks' ranges add up to no more than the whole way along the order: so their
    positive rows differ by at most the largest group's, and their rows by at
    most the sum of the steps in rows from each group to the next.

    The rank needs no task with all groups: they are range partitioned, and a
    group's rank is its place in its partition plus the sizes of the earlier ones.
    """
    k, by = opts.n_folds, opts.fold_group or "page_id"
    order = [F.col("n_pos"), F.when(F.col("n_pos") % 2 == 0, F.col("n_rows")).otherwise(-F.col("n_rows")), F.col("_h"), F.col(by)]
    per = df.groupBy(by).agg(F.sum(F.col(label).cast("bigint")).alias("n_pos"), F.count("*").alias("n_rows"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = (per.withColumn("_h", fold_hash(opts.seed, by)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
         .withColumn("_m", F.monotonically_increasing_id()))
    s = materialize(s.withColumn("_p", F.shiftright("_m", 33)), "group-ranks")
    sizes = s.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))  # a row for each partition
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_p", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    rank = F.col("_off") + F.col("_m") - F.col("_m0")
    turned = rank + F.floor(rank / k).cast("bigint")
    return (s.join(F.broadcast(sizes), "_p").withColumn("fold", F.pmod(turned, F.lit(k)).cast("int"))
            .select(by, "n_pos", "n_rows", "fold"))


def pos_weight_expr(pos, neg, how: str = "share"):
    """T-03: weight of the positive class; 'share' = neg/(pos+neg) as the reference, 'ratio' = neg/pos."""
    if how == "ratio":
        return neg.cast("double") / F.nullif(pos, F.lit(0)).cast("double")
    return neg.cast("double") / F.nullif(pos + neg, F.lit(0)).cast("double")


def fold_weights(folded: DataFrame, opts: Options = Options()) -> DataFrame:
    """A-07: for each fold k, counts and positive weight of the training part (folds != k)."""
    per = folded.groupBy("fold").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    tot = per.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    j = per.crossJoin(F.broadcast(tot))  # one row
    pos = F.col("tp") - F.col("p")
    neg = (F.col("tn") - F.col("n")) - pos
    return j.select("fold", pos.alias("n_pos"), neg.alias("n_neg"),
                    pos_weight_expr(pos, neg, opts.pos_weight).alias("pos_weight"))


def weight_col(label_col, pw):
    return F.when(label_col == 1, pw).otherwise(F.lit(1.0))


N_FOLDS = C.N_FOLDS
