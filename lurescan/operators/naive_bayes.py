"""Multinomial naive Bayes in long form.

With smoothing alpha and vocabulary size V, the log posterior of class c for
a document with in-vocabulary term counts tf_t and length L = sum tf_t is

    log P(c) + L * (log alpha - log(n_c + alpha V)) + sum_{t: n_ct > 0} tf_t (log(n_ct + alpha) - log alpha)

so only the observed (term, class) pairs are ever materialised.  Fit: class
document counts and (term, class) counts, partial+final aggregations.
Predict: (doc, term, tf) rows join the sparse (term, class) weights (broadcast
behind the size check), one grouped sum per (doc, class), plus the per-class
constant; the class axis comes from the fitted classes (a model parameter of
C rows), attached by explode; argmax with ties to the smaller class.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescan.operators.joins import lookup_join


class LongFormNB:
    def __init__(self, classes: DataFrame, weights: DataFrame, vocab: DataFrame, class_ids: list[int]):
        self.classes = classes      # (cls, log_prior, log_norm)
        self.weights = weights      # (term, cls, w) for observed pairs
        self.vocab = vocab          # (term)
        self.class_ids = class_ids  # fitted classes (model parameter)


def fit(train_tc: DataFrame, train_docs: DataFrame, vocab: DataFrame, id_col: str = "msg_id",
        label_col: str = "label", alpha: float = 1.0) -> LongFormNB:
    vocab = vocab.select("term")
    v = vocab.count()  # vocabulary size: one number
    docs = train_docs.select(id_col, F.col(label_col).alias("cls"))
    n_docs = docs.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    tc = lookup_join(train_tc, vocab, "term", how="inner").join(docs, id_col)
    n_ct = tc.groupBy("term", "cls").agg(F.sum("tf").alias("n_ct"))
    n_c = n_ct.groupBy("cls").agg(F.sum("n_ct").alias("n_c"))
    total = F.sum("n").over(Window.partitionBy())  # over the C class rows
    classes = (n_docs.join(n_c, "cls", "left")
               .select("cls", F.log(F.col("n") / total).alias("log_prior"),
                       (F.lit(math.log(alpha)) - F.log(F.coalesce("n_c", F.lit(0)) + alpha * v)).alias("log_norm")))
    weights = n_ct.select("term", "cls", (F.log(F.col("n_ct") + alpha) - F.lit(math.log(alpha))).alias("w"))
    class_ids = sorted(r["cls"] for r in n_docs.select("cls").collect())  # C values
    return LongFormNB(classes, weights, vocab, class_ids)


def predict(model: LongFormNB, test_tc: DataFrame, test_docs: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """(id, pred) by maximum posterior."""
    tcv = lookup_join(test_tc, model.vocab, "term", how="inner")
    length = tcv.groupBy(id_col).agg(F.sum("tf").alias("L"))
    sparse = lookup_join(tcv, model.weights, "term", how="inner").groupBy(id_col, "cls").agg(
        F.sum(F.col("tf") * F.col("w")).alias("s"))
    base = (test_docs.select(id_col).join(length, id_col, "left")
            .withColumn("cls", F.explode(F.array(*[F.lit(c) for c in model.class_ids]))))
    base = lookup_join(base, model.classes, "cls", how="inner")
    scored = base.join(sparse, [id_col, "cls"], "left").select(
        id_col, "cls",
        (F.col("log_prior") + F.coalesce("L", F.lit(0)) * F.col("log_norm") + F.coalesce("s", F.lit(0.0))).alias("score"))
    best = scored.groupBy(id_col).agg(F.max_by("cls", F.struct(F.col("score"), -F.col("cls"))).alias("pred"))
    return best.select(id_col, F.col("pred").cast("int").alias("pred"))
