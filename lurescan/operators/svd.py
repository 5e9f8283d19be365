"""Uncentred truncated SVD of a long-form weight matrix.

Randomised subspace iteration (Halko, Martinsson and Tropp, 2011) on X^T X: a
d x l matrix Q (d terms, l = k + ``OVERSAMPLE``) is multiplied by X^T X a few
times.  A task forms its part of X^T (X Q) from its rows in numpy; the parts
are summed FAN at a time in levels, so the driver gets a few d x l matrices (bounded by
vocabulary cap x l) and never a d x d one.  Its own algebra is a QR of d x l
and an eigendecomposition of l x l.  Signs are fixed: the largest loading of
each component, by absolute value, is positive.

Documents without any vocabulary term are zero rows, as in any projection.
Not PCA: no centring.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescan.operators.joins import lookup_join
from lurescan.session import scoped_cache

OVERSAMPLE, ITERATIONS, FAN = 10, 6, 8


def matrix_rows(weights: DataFrame, ids: DataFrame, id_col: str, vocab: DataFrame) -> tuple[DataFrame, int]:
    """((id, js, ws) for every row of ``ids``, number of terms); terms are numbered in order of name."""
    terms = vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("j"))  # the capped vocabulary
    d = terms.count()
    w = lookup_join(weights, terms, "term", how="inner", max_rows=max(1, d))
    entries = w.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("j", "weight"))).alias("e"))
    rows = ids.select(id_col).join(entries, id_col, "left").select(
        id_col, F.coalesce(F.transform("e", lambda x: x["j"]), F.array().cast("array<int>")).alias("js"),
        F.coalesce(F.transform("e", lambda x: x["weight"]), F.array().cast("array<double>")).alias("ws"))
    return rows, d


def gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X^T X Q, summed over tasks in levels of FAN parts, by partition id.

    Every task writes its whole d x l part, however few rows it has, so the rows
    are read in one partition a core at most.
    """
    sc = rows.sparkSession.sparkContext
    rows = rows.coalesce(sc.defaultParallelism)
    shared = sc.broadcast(q)
    d, width = q.shape

    def part(batches):
        acc = np.zeros((d, width))
        for batch in batches:
            for js, ws in zip(batch["js"], batch["ws"]):
                if len(js):
                    acc[js] += ws[:, None] * (ws @ shared.value[js])[None, :]
        yield pd.DataFrame({"p": [TaskContext.get().partitionId()], "m": [acc.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(d * width)
        for m in frame.sort_values("p")["m"]:  # at most FAN of them, always in the same order
            total += np.frombuffer(m)
        return pd.DataFrame({"p": [int(frame["p"].min()) // FAN], "m": [total.tobytes()]})

    # the key of a part is its partition, so that a task run again sends it to the same sum
    parts, count = rows.select("js", "ws").mapInPandas(part, "p int, m binary"), rows.rdd.getNumPartitions()
    while True:
        parts, count = parts.groupBy(F.floor(F.col("p") / FAN)).applyInPandas(add, "p int, m binary"), -(-count // FAN)
        if count <= FAN:
            break
    out = np.zeros((d, width))
    for r in sorted(parts.collect(), key=lambda r: r["p"]):  # at most FAN matrices of d x l
        out += np.frombuffer(r["m"]).reshape(d, width)
    shared.unpersist()
    return out


def loadings(rows: DataFrame, d: int, k: int, seed: int = 42) -> np.ndarray:
    """d x k right singular vectors, signs fixed."""
    width = min(d, k + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    for _ in range(ITERATIONS):
        q = np.linalg.qr(gram_times(rows, q))[0]
    small = q.T @ gram_times(rows, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    v = q @ vectors[:, np.argsort(values)[::-1][:min(k, width)]]
    top = np.abs(v).argmax(axis=0)
    return v * np.where(v[top, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def project(rows: DataFrame, v: np.ndarray, id_col: str) -> DataFrame:
    """(id, x): every row times the loadings."""
    shared = rows.sparkSession.sparkContext.broadcast(v)  # d x k, bounded by the vocabulary cap

    def run(batches):
        for batch in batches:
            x = [np.round(w @ shared.value[j], 6) if len(j) else np.zeros(shared.value.shape[1])
                 for j, w in zip(batch["js"], batch["ws"])]
            yield pd.DataFrame({id_col: batch[id_col], "x": x})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"{id_col} {kind}, x array<double>")


def truncated_svd(weights: DataFrame, ids: DataFrame, id_col: str, vocab: DataFrame, k: int) -> DataFrame:
    """(id, component, value) of every row of ``ids`` for the top ``k`` right singular vectors."""
    rows, d = matrix_rows(weights, ids, id_col, vocab)
    rows = scoped_cache(rows)
    out = project(rows, loadings(rows, d, k), id_col)
    return out.select(id_col, F.posexplode("x").alias("component", "value")).withColumn("component", F.col("component").cast("long"))
