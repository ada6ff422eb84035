"""Binary F1, weighted log-loss and per-fold reports (A-11..A-13, T-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS_P = 1e-7


def f1_expr(label: Column, pred: Column) -> Column:
    """A-11: 2tp / (2tp + fp + fn); 0 when there is nothing to score."""
    tp = F.sum(F.when((label == 1) & (pred == 1), 1).otherwise(0))
    fp = F.sum(F.when((label == 0) & (pred == 1), 1).otherwise(0))
    fn = F.sum(F.when((label == 1) & (pred == 0), 1).otherwise(0))
    den = 2 * tp + fp + fn
    return F.when(den == 0, F.lit(0.0)).otherwise((2 * tp).cast("double") / den)


def bce_expr(label: Column, prob: Column, pos_weight: Column) -> Column:
    """A-12: mean of -(w*y*ln p + (1-y)*ln(1-p)) over rows (p clipped to [1e-7, 1-1e-7])."""
    p = F.when(prob.isNotNull(), F.least(F.greatest(prob, F.lit(EPS_P)), F.lit(1 - EPS_P)))  # least skips nulls
    y = label.cast("double")
    return F.avg(-(pos_weight * y * F.log(p) + (1 - y) * F.log(1 - p)))


def fold_report(scored: DataFrame) -> DataFrame:
    """A-13: ``fold, train_loss, val_loss, f1, n_val, pos_weight`` of every fold and, with a null fold, their
    means (``n_val``: their sum).

    ``scored`` has a row for each node and model: the ``fold`` that the model
    has not seen, ``held_out`` (the node is in it), label, prob, pred, and the
    weight ``pos_weight`` of positive nodes. One aggregation, then a rollup
    over its few rows.
    """
    y, out = F.col("label"), F.col("held_out")
    loss = lambda part: bce_expr(y, F.when(part, F.col("prob")), F.col("pos_weight"))  # null rows do not count
    per = scored.groupBy("fold").agg(
        loss(~out).alias("train_loss"), loss(out).alias("val_loss"),
        f1_expr(F.when(out, y), F.when(out, F.col("pred"))).alias("f1"),
        F.count(F.when(out, 1)).alias("n_val"), F.max("pos_weight").alias("pos_weight"))
    return per.rollup("fold").agg(*[F.avg(c).alias(c) for c in ("train_loss", "val_loss", "f1")],
                                  F.sum("n_val").alias("n_val"), F.avg("pos_weight").alias("pos_weight"))
