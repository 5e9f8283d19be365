"""Linear SVM for several classes, one against one, with coupled probabilities.

Every pair of classes has a linear SVM fitted on the rows of the two; its margin
votes for one of them, and the class with most votes (ties: the smaller) is the
prediction.  Each pair also has a sigmoid (Platt, 1999, with his smoothed
targets), fitted on margins of rows that the pair's SVM did not see, so it gives
r_ij, the probability of i among i and j.  The r_ij of a row are coupled into class
probabilities by the second method of Wu, Lin and Weng (2004): the p with
sum 1 that minimises the squares of r_ji p_i - r_ij p_j over all pairs.

Fits are Spark ML fits on filtered rows, some at a time; their number follows from
the classes and folds.  Scoring adds columns to the rows: no join, no shuffle.
"""

from __future__ import annotations

from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.operators import models as MD

#: Pair probabilities are kept this far from 0 and 1, so that the coupled system has one solution.
CLIP = 1e-7
#: A fit's tasks read this many rows or more: an iteration is one pass, and over few rows its tasks are mostly overhead.
TASK_ROWS = 4096


def couple(r: np.ndarray, n_classes: int) -> np.ndarray:
    """(rows, pairs i < j) probabilities of i among i and j -> (rows, classes) probabilities with sum 1."""
    r = np.clip(r, CLIP, 1 - CLIP)
    m = np.zeros((len(r), n_classes + 1, n_classes + 1))
    for p, (i, j) in enumerate(combinations(range(n_classes), 2)):
        of_i, of_j = r[:, p], 1 - r[:, p]
        m[:, i, i] += of_j ** 2
        m[:, j, j] += of_i ** 2
        m[:, i, j] = m[:, j, i] = -of_i * of_j
    m[:, n_classes, :n_classes] = m[:, :n_classes, n_classes] = 1
    rhs = np.zeros((len(r), n_classes + 1, 1))
    rhs[:, n_classes] = 1
    p = np.maximum(np.linalg.solve(m, rhs)[:, :n_classes, 0], 0)
    return p / p.sum(axis=1, keepdims=True)


def votes(margins: Column, n_classes: int) -> Column:
    """Class with most votes over the margins of the pairs i < j (positive: i); ties go to the smaller class."""
    pairs = list(combinations(range(n_classes), 2))
    count = [sum((F.when((margins[p] > 0) == (c == i), 1).otherwise(0) for p, (i, j) in enumerate(pairs) if c in (i, j)), F.lit(0))
             for c in range(n_classes)]
    most = F.greatest(*count) if n_classes > 1 else count[0]
    return F.coalesce(*[F.when(x == most, F.lit(c)) for c, x in enumerate(count)])


def _sigmoid(oof: DataFrame):
    """Platt's sigmoid over (y, margin): each row counts with his target t as positive and 1 - t as negative."""
    n = {r["y"]: r["n"] for r in oof.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    t = F.when(F.col("y") == 1, (n.get(1.0, 0) + 1) / (n.get(1.0, 0) + 2)).otherwise(1 / (n.get(0.0, 0) + 2))
    both = oof.select("margin", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), t.alias("w")),
                                                  F.struct(F.lit(0.0).alias("y"), (1 - t).alias("w")))).alias("s"))
    rows = VectorAssembler(inputCols=["margin"], outputCol="m").transform(both.select("margin", "s.y", "s.w"))
    return LogisticRegression(featuresCol="m", labelCol="y", weightCol="w", maxIter=100, tol=MD.LOGREG_TOL).fit(rows)


class OneVsOneSVM:
    """Fitted pairs: ``svms`` and (slope, intercept) of the ``sigmoids``, in the order (0, 1), (0, 2), ..., (1, 2), ..."""

    def __init__(self, n_classes: int, svms: list, sigmoids: list):
        self.n_classes, self.svms, self.sigmoids = n_classes, svms, sigmoids

    def margins(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margins``: one per pair, positive for the pair's smaller class."""
        keep, names = df.columns, []
        for p, model in enumerate(self.svms):
            m = model.copy()
            m.setRawPredictionCol(f"_raw{p}").setPredictionCol(f"_pred{p}")
            df = m.transform(df)
            names.append(vector_to_array(f"_raw{p}")[1])
        return df.select(*keep, F.array(*names).alias("margins"))

    def predict(self, df: DataFrame, id_col: str = "msg_id") -> DataFrame:
        """(id, label, pred, proba): the vote and the coupled probabilities."""
        slope, shift = (np.array(v) for v in zip(*self.sigmoids))
        n = self.n_classes

        @F.pandas_udf("array<double>")
        def coupled(margins: pd.Series) -> pd.Series:
            if not len(margins):
                return pd.Series([], dtype=object)
            z = np.stack(margins.to_numpy()) * slope + shift
            return pd.Series(list(couple(1 / (1 + np.exp(-np.clip(z, -700, 700))), n)))

        out = self.margins(df.select(id_col, "label", MD.FEATURES))
        return out.select(id_col, "label", votes(F.col("margins"), n).cast("int").alias("pred"), coupled("margins").alias("proba"))


def fit_one_vs_one(train: DataFrame, n_classes: int, weighted: bool = False, c: float = 1.0, fold_col: str = "fold",
                   parallelism: int = 8) -> OneVsOneSVM:
    """Fit all pairs on (label 0..n-1, features, fold[, weight]) rows.

    Weights are those of the whole table (class_weight='balanced'); the penalty C
    is that of a sum of losses over the pair's rows.  A class without rows, or with
    rows in one fold only, is an error, as its pairs cannot be fitted.
    """
    weight = F.col("weight") if weighted else F.lit(1.0)
    cells = train.groupBy(F.col("label").cast("int").alias("label"), F.col(fold_col).alias("fold")).agg(
        F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")).collect()  # one row a class and fold
    total = {(r["label"], r["fold"]): r["w"] for r in cells}
    count = {(r["label"], r["fold"]): r["n"] for r in cells}
    folds = sorted({f for _, f in total})
    for cls in range(n_classes):
        if sum((cls, f) in total for f in folds) < 2:
            raise ValueError(f"class {cls} needs rows in at least two folds")
    pairs = list(combinations(range(n_classes), 2))

    def svm(job):
        (i, j), out = job
        rows = train.where(F.col("label").isin(i, j))
        rows = rows if out is None else rows.where(F.col(fold_col) != out)
        used = [key for key in total if key[0] in (i, j) and key[1] != out]
        loss = sum(total[key] for key in used)
        rows = rows.coalesce(max(1, sum(count[key] for key in used) // TASK_ROWS))
        est = MD.estimator("svm_linear", weighted=weighted, n_rows=1, c=c * max(loss, 1e-12))
        return est.fit(rows.withColumn("label", (F.col("label") == i).cast("double")))

    jobs = [(p, out) for p in pairs for out in (None, *folds)]
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        fitted = dict(zip(jobs, pool.map(inheritable_thread_target(train.sparkSession)(svm), jobs)))
    sigmoids = []
    for i, j in pairs:
        oof = None
        for f in folds:
            rows = train.where(F.col("label").isin(i, j) & (F.col(fold_col) == f))
            part = fitted[(i, j), f].transform(rows).select(
                (F.col("label") == i).cast("double").alias("y"), vector_to_array("rawPrediction")[1].alias("margin"))
            oof = part if oof is None else oof.unionByName(part)
        s = _sigmoid(oof)
        sigmoids.append((float(s.coefficients[0]), float(s.intercept)))
    return OneVsOneSVM(n_classes, [fitted[p, None] for p in pairs], sigmoids)
