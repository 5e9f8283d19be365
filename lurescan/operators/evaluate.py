"""Evaluation and thresholds.

Every count-based metric starts from one ``groupBy(y, p).count()`` — a
partial+final aggregation whose result has at most classes^2 rows — and the
rest is algebra on that tiny frame.  The threshold sweep buckets every
probability once (comparison with a literal array of the thresholds inside
the row), so the 81-point curve costs one pass, not 81.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 (scikit-learn's zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def pair_counts(df: DataFrame, y: str = "label", p: str = "pred") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """(cls, tp, support, predicted, precision, recall, f1) for every class seen in y or p."""
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0)
    both = counts.select(F.explode(F.array(
        F.struct(F.col("y").alias("cls"), hit.cast("long").alias("tp"), F.col("n").cast("long").alias("support"), zero.cast("long").alias("predicted")),
        F.struct(F.col("p").alias("cls"), zero.cast("long").alias("tp"), zero.cast("long").alias("support"), F.col("n").cast("long").alias("predicted")),
    )).alias("c")).select("c.*")
    j = both.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    prec = _div(F.col("tp"), F.col("predicted"))
    rec = _div(F.col("tp"), F.col("support"))
    f1 = _div(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return j.select("*", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def accuracy(df: DataFrame, y: str = "label", p: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def prf_for(counts: DataFrame, positive) -> DataFrame:
    """Precision / recall / F1 / support of one chosen positive class."""
    pc = per_class(counts).where(F.col("cls") == F.lit(positive))
    return pc.select(F.lit(positive).alias("positive"), "precision", "recall", "f1", "support")


def report(counts: DataFrame) -> DataFrame:
    """classification_report: per-class rows, then accuracy, macro avg and weighted avg.

    Columns (row, precision, recall, f1, support); the accuracy row carries
    the accuracy in ``f1`` and nulls in precision / recall, as the text report does.
    """
    pc = per_class(counts)
    total = F.sum("support")
    agg = pc.agg(
        F.sum("tp").alias("tp"), total.alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        _div(F.sum(F.col("precision") * F.col("support")), total).alias("wp"),
        _div(F.sum(F.col("recall") * F.col("support")), total).alias("wr"),
        _div(F.sum(F.col("f1") * F.col("support")), total).alias("wf"),
    )
    rows = pc.select(F.col("cls").cast("string").alias("row"), "precision", "recall", "f1", "support")
    acc = agg.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), _div(F.col("tp"), F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    macro = agg.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), F.col("n").alias("support"))
    weighted = agg.select(F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def confusion_matrix(df: DataFrame, classes: list, y: str = "label", p: str = "pred") -> DataFrame:
    """Counts actual x predicted; one column per predicted class, missing -> 0."""
    m = df.groupBy(F.col(y).alias("actual")).pivot(p, classes).count()
    return m.select("actual", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"pred_{c}")
                                for c in classes])


def log_loss(df: DataFrame, y: str = "label", prob: str = "p", eps: float = 1e-7) -> DataFrame:
    """Mean binary cross-entropy, probabilities clipped to [eps, 1 - eps] (Keras' default)."""
    q = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1.0 - eps))
    yy = F.col(y).cast("double")
    return df.agg(F.avg(-(yy * F.log(q) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - q))).alias("log_loss"))


def thresholds(start: float = 0.1, stop: float = 0.9, num: int = 81) -> list[float]:
    """np.linspace values, exactly."""
    return [float(x) for x in np.linspace(start, stop, num)]


def threshold_sweep(df: DataFrame, y: str = "label", prob: str = "p", ts: list[float] | None = None) -> DataFrame:
    """F1 of ``p >= t`` for every threshold, in one pass; ``is_best`` marks the first maximum.

    Each row is bucketed once: b = number of thresholds <= p, so row counts
    as predicted positive for exactly the thresholds with index < b.
    """
    ts = ts or thresholds()
    arr = F.array(*[F.lit(t) for t in ts])
    b = F.size(F.filter(arr, lambda t: t <= F.col(prob)))
    hist = df.groupBy(b.alias("b")).agg(F.sum(F.col(y).cast("long")).alias("pos"),
                                        F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    # bucket ids 0..len(ts); threshold i counts the buckets above i (reverse running sums)
    grid = spark.range(len(ts) + 1).select(F.col("id").alias("i"))
    j = grid.join(F.broadcast(hist), F.col("b") == F.col("i"), "left").select(
        "i", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce(F.col("n") - F.col("pos"), F.lit(0)).alias("neg"))
    above = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)  # len(ts) + 1 rows
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = j.select("i", F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp"),
                 F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp"),
                 F.sum("pos").over(everything).alias("P"))
    s = s.where(F.col("i") < len(ts)).select(
        "i", F.element_at(arr, (F.col("i") + 1).cast("int")).alias("threshold"),
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        (F.col("P") - F.col("tp")).cast("long").alias("fn"))
    f1 = _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    s = s.withColumn("f1", f1)
    w = Window.orderBy(F.desc("f1"), F.asc("i"))  # len(ts) rows
    return s.withColumn("is_best", (F.row_number().over(w) == 1))


def argmax_class(scores: Column) -> Column:
    """Index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
