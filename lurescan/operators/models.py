"""Models, ensembles and tuning on Spark ML.

Fits are Spark ML estimators (distributed); the driver only orchestrates
them (fold loops, grid points) and never iterates over data rows.  Where
the scripts' estimator has no Spark counterpart the re-aimed form is named:
RBF kernel -> random Fourier features + LinearSVC; SVC probability -> Platt
scaling on out-of-fold margins; f1_macro -> a small evaluator over the
(y, p) count table.
"""

from __future__ import annotations

import random
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.operators import evaluate as EV
from lurescan.operators import forest as FO
from lurescan.operators.vectorize import sklearn_tokens
from lurescan.session import ensure_checkpoint_dir, scoped_cache

FEATURES = "features"


# ---------------------------------------------------------------- features

#: Spark's own bound for a vectoriser without a cap.
NO_CAP = 1 << 18


def vocabulary(df: DataFrame, text_col: str = "text", size: int | None = None) -> list[str]:
    """The ``size`` most frequent terms (ties by term), the same for every partitioning of ``df``.

    Counts are aggregated by term and the top is taken on the executors; only
    the capped list, which a vectoriser model holds on the driver anyway, is
    brought there.
    """
    terms = df.select(F.explode(sklearn_tokens(text_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = terms.orderBy(F.desc("n"), F.asc("term")).limit(size or NO_CAP)
    return [r["term"] for r in top.collect()]


def featurize(df: DataFrame, text_col: str = "text", vocab: int | None = 1000, bundle: str | None = "email",
              fit_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(``df`` with ``features`` for its text, feature names in vector order).

    Features are counts over a vocabulary fitted on ``fit_on`` (the train rows:
    no leakage) or on ``df``, then the hand-made features of ``bundle``; with
    ``bundle`` None counts only.
    """
    names = vocabulary(df if fit_on is None else fit_on, text_col, vocab)
    return with_features(df, names, text_col, bundle), names + (T.FEATURE_BUNDLES[bundle] if bundle else [])


def with_features(df: DataFrame, names: list[str], text_col: str = "text", bundle: str | None = "email") -> DataFrame:
    """``df`` with ``features`` for its text: counts of the terms ``names``, then the hand-made features of ``bundle``.

    Spark's assembler counts as non-deterministic, so a filter on the result is
    not moved below it: select rows first, or the texts of the others are worked out, too.
    """
    keep = [c for c in df.columns if c != text_col]
    extra = T.FEATURE_BUNDLES[bundle] if bundle else []
    made = T.message_features(F.col(text_col), bundle) if bundle else []
    cv = CountVectorizerModel.from_vocabulary(names, inputCol="_tok", outputCol="_bow")
    va = VectorAssembler(inputCols=["_bow", *extra], outputCol=FEATURES)
    base = df.select(*keep, *made, sklearn_tokens(text_col).alias("_tok"))
    return va.transform(cv.transform(base)).select(*keep, unnamed(FEATURES, len(names) + len(extra)))


def unnamed(col: str, size: int) -> Column:
    """The vector column with its size alone as metadata.

    A name a term in the schema is copied into every plan and every task of a fit,
    which has hundreds of jobs; the fits read the size only.
    """
    return F.col(col).alias(col, metadata={"ml_attr": {"num_attrs": size}})


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and cached: rows, order and partitions as they are, without lineage.

    Every job of a fit sends the whole lineage of its rows with its tasks; a
    fit has a job an iteration, so joins and vectorisers are left behind first.
    """
    ensure_checkpoint_dir(df.sparkSession)
    held = df.cache()
    out = scoped_cache(held.checkpoint(eager=True))
    held.unpersist()
    return out


def balanced_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``weight`` = n / (k * n_c) (class_weight='balanced')."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    st = c.agg(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k")).first()  # one row
    w = c.select(label_col, (F.lit(float(st["n"])) / (F.lit(st["k"]) * F.col("_nc"))).alias("weight"))
    return df.join(F.broadcast(w), label_col)  # one row per class


# ---------------------------------------------------------------- estimators

# convergence tolerances of the scripts' estimators (scikit-learn defaults: SVC 1e-3,
# LogisticRegression 1e-4); Spark's own default (1e-6) runs many more iterations
SVC_TOL = 1e-3
LOGREG_TOL = 1e-4
# tree node batching of Spark's own fits (few rows, see forest.py): each pass over the
# data splits as many open nodes (of all trees) as their split statistics fit in this
# budget, which every task of a pass holds.
FOREST_NODE_MB = 256
#: Settings of every deep tree and forest.  Rows keep the node they have reached: without that every
#: pass sends the trees so far to its tasks and leads each row from the root again, in every tree.
DEEP = {"maxMemoryInMB": FOREST_NODE_MB, "cacheNodeIds": True}


#: Depth of a tree without a limit: Spark's largest.
UNLIMITED_DEPTH = 30


#: A task of a linear fit reads this many rows or more; its pass is short, and its jobs are many.
TASK_ROWS = 8192
#: Trees and perceptrons do far more with a row.
HEAVY_ROWS = 1024


def fit_rows(df: DataFrame, n_rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` (cached) in the few partitions that a fit wants: ``task_rows`` rows or more each, at most one a core.

    Every pass of a fit sums, writes and merges its whole statistics once a partition
    (trees: features x bins x open nodes; perceptrons and linear models: a gradient),
    however few rows the partition has.  With a bounded number of partitions that
    part of a pass does not grow with the shuffle's partitions or the input.
    """
    n = df.count() if n_rows is None else n_rows
    return df.coalesce(max(1, min(df.sparkSession.sparkContext.defaultParallelism, n // task_rows)))


def fit(est, rows: DataFrame, n_rows: int):
    """``est`` fitted on ``rows`` (about ``n_rows``, from ``fit_rows``); linear models read them in fewer partitions.

    Trees and forests of many rows are grown by ``forest.fit``.
    """
    if isinstance(est, FO.ESTIMATORS):
        return FO.fit(est, rows, n_rows)
    linear = isinstance(est, (LinearSVC, LogisticRegression, OneVsRest))
    return est.fit(fit_rows(rows, n_rows) if linear else rows)


#: Fits of an ensemble that run at a time: the jobs of a fit are short and wait for each other.
PARALLEL_FITS = 4


def fit_all(jobs: list, n_rows: int) -> list:
    """Models of (estimator, rows) pairs, some fits at a time."""
    one = inheritable_thread_target(jobs[0][1].sparkSession)(lambda job: fit(*job, n_rows))
    with ThreadPool(min(PARALLEL_FITS, len(jobs))) as pool:
        return pool.map(one, jobs, chunksize=1)


def inverse_c(n_rows: int, c: float = 1.0) -> float:
    """Spark's regParam for a penalty C: the loss is a mean there and a sum in the scripts' library."""
    return 1.0 / (c * max(1, n_rows))


def estimator(name: str, n_features: int | None = None, n_classes: int = 2, weighted: bool = False, seed: int = 42,
              n_rows: int = 1, c: float = 1.0, max_depth: int = UNLIMITED_DEPTH, layers: tuple = (100,)):
    """A Spark ML estimator by the scripts' settings; ``n_rows`` (train rows) sets the penalty."""
    wc = {"weightCol": "weight"} if weighted else {}
    common = {"featuresCol": FEATURES, "labelCol": "label"}
    if name == "nb":
        return NaiveBayes(modelType="multinomial", smoothing=1.0, **common)
    if name == "logreg":
        return LogisticRegression(maxIter=1000, regParam=inverse_c(n_rows, c), family="auto", tol=LOGREG_TOL, **common, **wc)
    if name == "tree":
        return DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=1, impurity="gini", seed=seed,
                                      **DEEP, **common, **wc)
    if name == "forest":
        return RandomForestClassifier(numTrees=100, featureSubsetStrategy="sqrt", bootstrap=True, seed=seed,
                                      maxDepth=max_depth, **DEEP, **common, **wc)
    if name == "gbt":
        # 100 stages of depth-3 trees, step 0.1: the scripts' boosting defaults
        return GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, **common, **wc)
    if name == "svm_linear":
        svc = LinearSVC(maxIter=100, regParam=inverse_c(n_rows, c), tol=SVC_TOL, **common, **wc)
        return svc if n_classes == 2 else OneVsRest(classifier=svc, parallelism=min(n_classes, PARALLEL_FITS), **common, **wc)
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, *layers, n_classes], maxIter=300, seed=seed, **common)
    raise ValueError(name)


def prediction_frame(model, df: DataFrame, id_col: str = "msg_id") -> DataFrame:
    out = model.transform(df)
    cols = [id_col, "label", F.col("prediction").cast("int").alias("pred")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("proba"))
    return out.select(*cols)


# ---------------------------------------------------------------- RBF via random Fourier features

def scale_gamma(df: DataFrame, n_features: int, in_col: str = FEATURES) -> float:
    """1 / (d * variance of all entries of the matrix): the library's default."""
    x = df.select(vector_to_array(in_col).alias("x")).select(
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("q"))
    r = x.agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("n")).first()  # one row
    cells = max(1, r["n"] * n_features)
    var = (r["q"] or 0.0) / cells - ((r["s"] or 0.0) / cells) ** 2
    return 1.0 / (n_features * var) if var > 0 else 1.0


def random_fourier(df: DataFrame, n_features: int, gamma: float, n_components: int = 256,
                   seed: int = 42, in_col: str = FEATURES, out_col: str = FEATURES) -> DataFrame:
    """z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U[0, 2 pi) (Rahimi and Recht, 2007).

    W is a D x d parameter matrix fixed by the seed; it ships with the task
    closure (size set by the parameters, not by the data).
    """
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_components, n_features))
    b = rng.uniform(0.0, 2.0 * np.pi, size=n_components)
    scale = np.sqrt(2.0 / n_components)
    keep = [c for c in df.columns if c != in_col]
    arr = df.select(*keep, vector_to_array(in_col).alias("_x"))

    @F.pandas_udf("array<double>")
    def project(xs: pd.Series) -> pd.Series:
        x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, n_features))
        z = scale * np.cos(x @ w.T + b)
        return pd.Series(list(z))

    return arr.select(*keep, array_to_vector(project("_x")).alias(out_col))


# ---------------------------------------------------------------- Platt scaling

def platt_svm(train: DataFrame, test: DataFrame, fold_col: str = "fold", id_col: str = "msg_id", n_rows: int = 1,
              weighted: bool = False) -> DataFrame:
    """LinearSVC margins turned into probabilities by a logistic fit on out-of-fold margins."""
    svc = estimator("svm_linear", weighted=weighted, n_rows=n_rows)
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())  # k fold ids
    *fitted, final = fit_all([*((svc, train.where(F.col(fold_col) != f)) for f in folds), (svc, train)], n_rows)
    oof = None
    for f, m in zip(folds, fitted):
        part = m.transform(train.where(F.col(fold_col) == f)).select(
            id_col, "label", vector_to_array("rawPrediction")[1].alias("margin"))
        oof = part if oof is None else oof.unionByName(part)
    va = VectorAssembler(inputCols=["margin"], outputCol="m")
    lr = LogisticRegression(featuresCol="m", labelCol="label", maxIter=100, tol=LOGREG_TOL).fit(fit_rows(settled(va.transform(oof)), n_rows))
    scored = final.transform(test).select(id_col, "label", vector_to_array("rawPrediction")[1].alias("margin"))
    out = lr.transform(va.transform(scored))
    return out.select(id_col, "label", F.col("prediction").cast("int").alias("pred"),
                      vector_to_array("probability").alias("proba"))


# ---------------------------------------------------------------- ensembles

def vote_frames(frames: list[DataFrame], id_col: str = "msg_id") -> DataFrame:
    """Soft vote: mean class probabilities of several prediction frames, then the largest.

    The frames hold one row an id; they meet in one aggregation on the id.
    """
    every = None
    for f in frames:
        part = f.select(id_col, "label", F.posexplode("proba").alias("cls", "p"))
        every = part if every is None else every.unionByName(part)
    mean = every.groupBy(id_col, "label", "cls").agg(F.avg("p").alias("p"))
    out = mean.groupBy(id_col, "label").agg(F.sort_array(F.collect_list(F.struct("cls", "p"))).alias("s"))  # k classes
    out = out.select(id_col, "label", F.transform("s", lambda x: x["p"]).alias("proba"))
    return out.select(id_col, "label", EV.argmax_class(F.col("proba")).alias("pred"), "proba")


def class_scores(fitted, n_classes: int, i: int) -> tuple:
    """(fitted model with its own output columns, column of its class scores).

    Probabilities where the model has them (one class is left out of two, as it
    follows from the other), else its margins.
    """
    m = fitted.copy()
    for p, v in (("predictionCol", f"_bp{i}"), ("probabilityCol", f"_bq{i}"), ("rawPredictionCol", f"_br{i}")):
        if m.hasParam(p):
            m.set(m.getParam(p), v)
    arr = vector_to_array(f"_bq{i}" if m.hasParam("probabilityCol") else f"_br{i}")
    return m, F.slice(arr, 2, 1) if n_classes == 2 else arr


def stack(train: DataFrame, test: DataFrame, bases: list, meta, n_classes: int = 2,
          fold_col: str = "fold", id_col: str = "msg_id") -> DataFrame:
    """Stacking: out-of-fold class scores of the bases -> meta model; bases refit on all train rows.

    ``bases`` and ``meta`` are estimators.  Every train row is scored exactly
    once, by bases that did not see it; every class has a column (the second
    one only for two classes).  A ``weight`` column reaches the meta model.
    """
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())  # k fold ids
    more = ["weight"] if "weight" in train.columns else []

    def base_scores(fitted, frame, cols):
        parts, cur = [], frame
        for i, m in enumerate(fitted):
            m, part = class_scores(m, n_classes, i)
            cur = m.transform(cur)
            parts.append(part)
        return cur.select(id_col, "label", *cols, array_to_vector(F.concat(*parts)).alias(FEATURES))

    seen = [*(train.where(F.col(fold_col) != f) for f in folds), train]
    n_rows = train.count()
    every = fit_all([(b, rows) for rows in seen for b in bases], n_rows)
    fitted = [every[i:i + len(bases)] for i in range(0, len(every), len(bases))]
    oof = None
    for f, own in zip(folds, fitted):
        part = base_scores(own, train.where(F.col(fold_col) == f), more)
        oof = part if oof is None else oof.unionByName(part)
    return prediction_frame(fit(meta, fit_rows(settled(oof), n_rows, HEAVY_ROWS), n_rows), base_scores(fitted[-1], test, []), id_col)


# ---------------------------------------------------------------- tuning

class MacroF1Evaluator(Evaluator):
    """Unweighted mean of per-class F1, from one (y, p) count table."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.label_col, self.pred_col = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        counts = EV.pair_counts(dataset.select(F.col(self.label_col).cast("int").alias("label"),
                                               F.col(self.pred_col).cast("int").alias("pred")))
        return float(EV.per_class(counts).agg(F.avg("f1")).first()[0])

    def isLargerBetter(self) -> bool:
        return True


def evaluator_for(metric: str):
    if metric == "f1_macro":
        return MacroF1Evaluator()
    return MulticlassClassificationEvaluator(metricName=metric, labelCol="label")


def grid_search(est, grid, train: DataFrame, metric: str = "accuracy", fold_col: str = "fold",
                parallelism: int = 4):
    n_folds = train.select(fold_col).distinct().count()
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=evaluator_for(metric),
                        foldCol=fold_col, numFolds=n_folds, parallelism=parallelism, seed=42)
    return cv.fit(train)


def random_search(est, grid, n_iter: int, train: DataFrame, metric: str = "accuracy", fold_col: str = "fold",
                  parallelism: int = 4, seed: int = 42):
    """A seeded sample of ``n_iter`` points of the grid, cross-validated."""
    pts = list(grid)
    pick = random.Random(seed).sample(pts, min(n_iter, len(pts)))
    return grid_search(est, pick, train, metric, fold_col, parallelism)


def cross_val_scores(est, train: DataFrame, fold_col: str = "fold") -> DataFrame:
    """(fold, accuracy, f1_macro) per fold: fit on the other folds, score this one."""
    spark = train.sparkSession
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())  # k fold ids
    rows = []
    for f in folds:
        rest = train.where(F.col(fold_col) != f)
        m = fit(est, rest, rest.count())
        pred = m.transform(train.where(F.col(fold_col) == f)).select(
            F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))
        acc = EV.accuracy(pred).first()[0]
        f1m = EV.per_class(EV.pair_counts(pred)).agg(F.avg("f1")).first()[0]
        rows.append((int(f), float(acc), float(f1m)))
    return spark.createDataFrame(rows, "fold int, accuracy double, f1_macro double")


def param_grid(est, **values):
    b = ParamGridBuilder()
    for k, v in values.items():
        b = b.addGrid(est.getParam(k), v)
    return b.build()
