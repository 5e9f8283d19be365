"""Deterministic splits, folds and shuffles.

Random draws are md5 keys of ``seed|id``; ranks come from the skew-safe
``rank_by_hash``.  Quotas are exact (the same row counts as the library
defaults the scripts rely on).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescan.operators.ranking import hash_key, rank_by_hash, rank_in_groups


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Seeded shuffle: every row gets its position in the shuffled order."""
    return rank_by_hash(df, id_col, hash_key(seed, id_col), rank_col="position")


def split_random(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the ceil(test_size * n) rows first in the seeded order."""
    n = df.count()
    n_test = math.ceil(test_size * n)
    r = rank_by_hash(df, id_col, hash_key(seed, id_col), rank_col="_r", n_rows=n)
    return r.withColumn("is_test", (F.col("_r") <= n_test).cast("int")).drop("_r")


def class_quotas(df: DataFrame, label_col: str, test_size: float) -> DataFrame:
    """(label, n, n_train, n_test) per class.

    Train quotas are floor(n_c * n_train / n) plus one for the classes with the
    largest remainders (ties: smaller label first); test gets the rest, so the
    totals are exactly n_train = n - ceil(test_size * n) and n_test.
    """
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    w_all = Window.partitionBy()
    total = F.sum("n").over(w_all)
    n_test = F.ceil(total * F.lit(test_size))
    n_train = total - n_test
    cont = F.col("n") * n_train / total
    q = counts.select(label_col, "n", cont.alias("_cont"), n_train.alias("_ntrain"))
    q = q.withColumn("_floor", F.floor("_cont")).withColumn("_rem", F.col("_cont") - F.col("_floor"))
    q = q.withColumn("_need", F.col("_ntrain") - F.sum("_floor").over(w_all))
    q = q.withColumn("_pos", F.row_number().over(Window.orderBy(F.desc("_rem"), F.col(label_col))))
    q = q.withColumn("n_train", (F.col("_floor") + (F.col("_pos") <= F.col("_need")).cast("long")).cast("long"))
    return q.select(label_col, F.col("n").cast("long").alias("n"), "n_train",
                    (F.col("n") - F.col("n_train")).cast("long").alias("n_test"))


def split_stratified(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test`` with exact per-class quotas; within a class the seeded order decides."""
    quotas = class_quotas(df, label_col, test_size).select(label_col, "n_test")
    r = rank_by_hash(df, id_col, hash_key(seed, id_col), partition_cols=[label_col], rank_col="_r",
                     per_group=quotas)
    return r.withColumn("is_test", (F.col("_r") <= F.col("n_test")).cast("int")).drop("_r", "n_test")


def kfold_stratified(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int | None = 42) -> DataFrame:
    """Adds ``fold`` in [0, k): every class spread evenly over the folds.

    ``seed=None`` is the unshuffled form: rows dealt in id order.
    """
    if seed is None:
        r = rank_in_groups(df, [label_col], [id_col], rank_col="_r")
    else:
        r = rank_by_hash(df, id_col, hash_key(seed, id_col), partition_cols=[label_col], rank_col="_r")
    return r.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r")


def validation_split(df: DataFrame, id_col: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``is_val``: the last ``fraction`` of the rows in the seeded order (Keras' validation_split)."""
    n = df.count()
    split_at = int(n * (1 - fraction))
    r = rank_by_hash(df, id_col, hash_key(seed, id_col), rank_col="_r", n_rows=n)
    return r.withColumn("is_val", (F.col("_r") > split_at).cast("int")).drop("_r")
