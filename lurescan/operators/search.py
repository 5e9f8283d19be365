"""Searches over whole pipelines, as an evaluation tree of shared prefixes.

A point of a search has settings for the vectoriser, for resampling and for the
classifier.  Points are grouped, fold by fold, by the settings of each stage in
turn, so that a prefix is fitted once a fold however many points share it: the
vectoriser on the fold's train rows, then resampling of these rows, then the
classifier.  The classifiers share more:

* naive Bayes: one table of class sums serves all smoothings;
* trees and forests: the splits of a tree do not depend on its depth limit or
  on how many rows a node needs to be split, and the trees of a forest do not
  depend on each other.  So one fit, as deep and with as many trees as any
  point of its group asks for, answers all of them: a row stops in a node at
  the point's depth, or where fewer rows than ``min_samples_split`` arrived.

Fits and transforms are Spark jobs; held-out rows are scored for all points of
a fit in one pass that returns counts of (point, label, prediction).  What
reaches the driver are vocabularies (``max_features`` terms), models and these
counts.
"""

from __future__ import annotations

import itertools
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.operators import forest as FO
from lurescan.operators import resample as RS
from lurescan.operators import vectorize as V
from lurescan.operators.models import DEEP, FEATURES, UNLIMITED_DEPTH, fit_rows
from lurescan.session import scratch_dir

ROWS_AT_ONCE = 256
#: Column of a vectoriser's words, worked out once for all folds.
WORDS = "_words"
POINT_COUNTS = "point int, label int, pred int, n long"


def grid(**values) -> list[dict]:
    """All points of a grid, the last setting fastest."""
    return [dict(zip(values, p)) for p in itertools.product(*values.values())]


def sampled(points: list[dict], n_iter: int, seed: int = 42, shared: tuple = (), per_group: int = 1) -> list[dict]:
    """``n_iter`` different points (all, if there are fewer), by a seeded draw.

    With ``shared`` settings the draw is by groups of points that agree in
    them, up to ``per_group`` points of each, so that points share fits.
    """
    rng = random.Random(seed)
    if not shared:
        return rng.sample(points, min(n_iter, len(points)))
    groups: dict[tuple, list[dict]] = {}
    for p in points:
        groups.setdefault(_key(p, shared), []).append(p)
    out = []
    for key in rng.sample(list(groups), len(groups)):
        if len(out) >= n_iter:
            break
        out += rng.sample(groups[key], min(per_group, n_iter - len(out), len(groups[key])))
    return out


def _key(point: dict, names) -> tuple:
    return tuple((n, point[n]) for n in names if n in point)


# ---------------------------------------------------------------- stages

class Vectorise:
    """Word n-gram counts or TF-IDF rows over the train rows' most frequent terms, and hand-made features.

    Settings: ``max_features``, ``ngram_max``.  ``tfidf`` False keeps counts.
    """

    settings = ("max_features", "ngram_max")

    def __init__(self, tfidf: bool = True, bundle: str | None = None, stop_words=(), id_col: str = "msg_id", text_col: str = "text"):
        self.tfidf, self.bundle, self.stop_words = tfidf, bundle, tuple(sorted(set(stop_words)))
        self.id_col, self.text_col = id_col, text_col
        self.largest: dict[int, int] = {}
        self._ranked: tuple | None = None

    def expect(self, points: list[dict]) -> None:
        """Points that will be asked for: the largest ``max_features`` of every ``ngram_max`` is ranked once a table."""
        self.largest = {}
        for p in points:
            n, size = p.get("ngram_max", 1), p.get("max_features", 1000)
            self.largest[n] = max(size, self.largest.get(n, 0))

    def words(self, df: DataFrame) -> DataFrame:
        """``df`` with its words and hand-made features in place of the text (worked out once, if the caller keeps it)."""
        if WORDS in df.columns:
            return df
        tok = V.sklearn_tokens(self.text_col)
        if self.stop_words:
            stop = F.array(*[F.lit(w) for w in self.stop_words])
            tok = F.filter(tok, lambda t: ~F.array_contains(stop, t))
        extra = T.message_features(F.col(self.text_col), self.bundle) if self.bundle else []
        return df.select(*[c for c in df.columns if c != self.text_col], *extra, tok.alias(WORDS))

    def _terms(self, train: DataFrame, max_features: int, ngram_max: int, grams) -> tuple[int, list]:
        """(rows, the first ``max_features`` terms): a smaller vocabulary is the head of a larger one of the same table."""
        if self._ranked is None or self._ranked[0] is not train or self._ranked[1] != ngram_max or self._ranked[2] < max_features:
            size, n = max(max_features, self.largest.get(ngram_max, 0)), train.count()
            top = V.vocabulary_topk(V.term_counts(grams(self.words(train)), self.id_col, F.col("_w")), n, size)
            terms = top.select("term", "df").orderBy(F.desc("total"), "term").collect()  # max_features rows
            self._ranked = (train, ngram_max, size, n, terms)
        return self._ranked[3], self._ranked[4][:max_features]

    def __call__(self, train: DataFrame, others: list[DataFrame], max_features: int = 1000, ngram_max: int = 1) -> list[DataFrame]:
        def grams(df):
            return df.withColumn("_w", V.ngrams(F.col(WORDS), 1, ngram_max))

        n, terms = self._terms(train, max_features, ngram_max, grams)
        extra = T.FEATURE_BUNDLES[self.bundle] if self.bundle else []
        cols = ["_c"]
        counts = CountVectorizerModel.from_vocabulary([r["term"] for r in terms] or ["\0"], inputCol="_w", outputCol="_c")
        stages = [counts]
        if self.tfidf:
            idf = [float(np.log((1 + n) / (1 + r["df"])) + 1) for r in terms] or [1.0]
            stages += [ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_c", outputCol="_t"),
                       Normalizer(p=2.0, inputCol="_t", outputCol="_u")]
            cols = ["_u"]
        stages.append(VectorAssembler(inputCols=cols + extra, outputCol=FEATURES))
        out = []
        for df in [train, *others]:
            df = self.words(df)
            keep = [c for c in df.columns if c != WORDS and c not in extra]
            df = grams(df)
            for s in stages:
                df = s.transform(df)
            out.append(df.select(*keep, FEATURES))
        return out


class Resample:
    """Random oversampling of the train rows inside the fold (setting ``resample``: ``oversample`` or None)."""

    settings = ("resample",)

    def __init__(self, id_col: str = "msg_id", label_col: str = "label", seed: int = 42):
        self.id_col, self.label_col, self.seed = id_col, label_col, seed

    def __call__(self, train: DataFrame, others: list[DataFrame], resample: str | None = None) -> list[DataFrame]:
        if resample == "oversample":
            ids = RS.oversample_random(train.select(self.id_col, self.label_col), self.id_col, self.label_col, self.seed)
            train = ids.select(self.id_col).join(train, self.id_col)
        elif resample is not None:
            raise ValueError(f"unknown resampling {resample!r}")
        return [train, *others]


# ---------------------------------------------------------------- classifiers

def dense(column: pa.StructArray, size: int) -> np.ndarray:
    """Rows of an Arrow column of ML vectors as a matrix."""
    kind, _, indices, values = (column.field(i) for i in range(4))
    out = np.zeros((len(column), size))
    sparse = kind.to_numpy(zero_copy_only=False) == 0
    values_at, indices_at = values.offsets.to_numpy(), indices.offsets.to_numpy()
    all_values, all_indices = values.values.to_numpy(), indices.values.to_numpy()
    for i in range(len(column)):
        v = all_values[values_at[i]:values_at[i + 1]]
        if sparse[i]:
            out[i, all_indices[indices_at[i]:indices_at[i + 1]]] = v
        else:
            out[i] = v
    return out


class _Classifier:
    """``fit(train, points)`` once for points with equal ``shared`` settings; ``scores(fitted, x, point)`` for a matrix."""

    def counts(self, fitted, held: DataFrame, points: dict[int, dict]) -> DataFrame:
        """(point, label, pred, n) of the held-out rows for every point, in one pass."""
        scores, size, shared = self.scores, fitted["size"], held.sparkSession.sparkContext.broadcast(fitted)

        def run(batches):
            total = Counter()
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(a, ROWS_AT_ONCE)
                    x, y = dense(part.column(1), size), part.column(0).to_pylist()
                    for k, s in scores(shared.value, x, points):
                        total.update(zip(itertools.repeat(k), y, s.argmax(axis=1).tolist()))
            if total:
                keys = list(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([total[k] for k in keys], pa.int64())],
                    ["point", "label", "pred", "n"])

        rows = held.select(F.col("label").cast("int").alias("label"), FEATURES)
        return rows.mapInArrow(run, POINT_COUNTS).groupBy("point", "label", "pred").agg(F.sum("n").alias("n"))

    def predict(self, fitted, rows: DataFrame, point: dict, id_col: str = "msg_id") -> DataFrame:
        """(id, label, pred) of rows for one point; ties go to the smaller class."""
        scores, size, shared = self.scores, fitted["size"], rows.sparkSession.sparkContext.broadcast(fitted)
        key = rows.schema[id_col].dataType.simpleString()

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(a, ROWS_AT_ONCE)
                    (_, s), = scores(shared.value, dense(part.column(2), size), {0: point})
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s.argmax(axis=1), pa.int32())],
                                                     ["id", "label", "pred"])

        picked = rows.select(F.col(id_col).alias("id"), F.col("label").cast("int").alias("label"), FEATURES)
        return picked.mapInArrow(run, f"id {key}, label int, pred int").withColumnRenamed("id", id_col)


class NaiveBayes(_Classifier):
    """Multinomial naive Bayes (setting ``alpha``): one table of class sums for all smoothings."""

    settings = ("alpha",)
    shared = ()

    def __init__(self, n_classes: int = 2):
        self.n_classes = n_classes

    def fit(self, train: DataFrame, points: list[dict]) -> dict:
        got = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col(FEATURES)).alias("s")).collect()
        size = len(got[0]["s"]) if got else 0
        sums, n = np.zeros((self.n_classes, size)), np.zeros(self.n_classes)
        for r in got:  # one row a class
            sums[int(r["label"])], n[int(r["label"])] = r["s"].toArray(), r["n"]
        return {"sums": sums, "n": n, "size": size}

    @staticmethod
    def scores(fitted, x, points):
        sums, n = fitted["sums"], fitted["n"]
        seen = n > 0
        for k, p in points.items():
            a = p["alpha"]
            weights = np.log(sums + a) - np.log(sums.sum(axis=1, keepdims=True) + a * sums.shape[1])
            prior = np.log(n + a) - np.log(n.sum() + a * seen.sum())
            yield k, np.where(seen, x @ weights.T + prior, -np.inf)


class Trees(_Classifier):
    """Decision trees, or forests with ``forest`` True.

    Settings: ``max_depth`` (None: Spark's largest), ``min_samples_split``, ``min_samples_leaf``, and for forests
    ``n_estimators``, ``max_features_split`` (sqrt, log2 or all), ``bootstrap``.  Only the last two and the leaf size change the trees.
    """

    settings = ("max_depth", "min_samples_split", "min_samples_leaf", "n_estimators", "max_features_split", "bootstrap")
    shared = ("min_samples_leaf", "max_features_split", "bootstrap")

    def __init__(self, forest: bool = False, n_classes: int = 2, class_weight: dict[int, float] | None = None, seed: int = 42):
        self.forest, self.n_classes, self.class_weight, self.seed = forest, n_classes, class_weight, seed

    def fit(self, train: DataFrame, points: list[dict]) -> dict:
        depth = max(p.get("max_depth") or UNLIMITED_DEPTH for p in points)
        common = {"featuresCol": FEATURES, "labelCol": "label", "maxDepth": depth, "impurity": "gini", "seed": self.seed,
                  "minInstancesPerNode": points[0].get("min_samples_leaf", 1), **DEEP}
        if self.class_weight:
            w = F.lit(1.0)
            for c, x in self.class_weight.items():
                w = F.when(F.col("label") == c, float(x)).otherwise(w)
            train, common = train.withColumn("weight", w), {**common, "weightCol": "weight"}
        if self.forest:
            est = RandomForestClassifier(numTrees=max(p.get("n_estimators", 100) for p in points),
                                         featureSubsetStrategy=points[0].get("max_features_split", "sqrt"),
                                         bootstrap=points[0].get("bootstrap", True), **common)
        else:
            est = DecisionTreeClassifier(**common)
        n = train.count()  # this also fills the cache in all tasks
        model = FO.fit(est, fit_rows(train, n), n)
        trees = grown_trees(model) if isinstance(model, FO.ForestModel) else read_trees(train.sparkSession, model)
        return {"trees": trees, "size": model.numFeatures}

    @staticmethod
    def scores(fitted, x, points):
        trees = fitted["trees"]
        stops: dict[tuple, list] = {}
        for k, p in points.items():
            stops.setdefault((p.get("max_depth") or UNLIMITED_DEPTH, p.get("min_samples_split", 2)), []).append((p.get("n_estimators") or len(trees), k))
        for (depth, rows), asked in stops.items():
            total, done = 0.0, 0
            for size, k in sorted(asked):
                for tree in trees[done:size]:
                    total = total + tree.shares(x, depth, rows)
                done = max(done, size)
                yield k, total


class Tree:
    """Nodes of one fitted tree in arrays; ``left`` is -1 in leaves."""

    def __init__(self, left, right, feature, threshold, rows, stats):
        self.left, self.right, self.feature = (np.asarray(x, np.int32) for x in (left, right, feature))
        self.threshold, self.rows = np.asarray(threshold, float), np.asarray(rows, np.int64)
        stats = np.asarray(stats, float)
        self.share = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
        self.depth = np.zeros(len(self.left), np.int8)
        now, depth = np.zeros(1, np.int64), 0
        while len(now):  # level by level
            self.depth[now] = depth
            inner = now[self.left[now] >= 0]
            now, depth = np.concatenate([self.left[inner], self.right[inner]]), depth + 1

    def shares(self, x: np.ndarray, depth: int, rows: int) -> np.ndarray:
        """Class shares in the node where each row of ``x`` stops."""
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while len(moving):
            node = at[moving]
            go = (self.left[node] >= 0) & (self.depth[node] < depth) & (self.rows[node] >= rows)
            moving, node = moving[go], node[go]
            lower = x[moving, self.feature[node]] <= self.threshold[node]
            at[moving] = np.where(lower, self.left[node], self.right[node])
        return self.share[at]


def read_trees(spark, model) -> list[Tree]:
    """The trees of a fitted model from its saved nodes (they are on the driver as the model is)."""
    path = scratch_dir(spark, "trees")
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    rows = saved.select("treeID", "nodeData.*") if "nodeData" in saved.columns else saved.withColumn("treeID", F.lit(0))
    trees: dict[int, list] = {}
    for r in rows.collect():
        trees.setdefault(r["treeID"], []).append(r)
    out = []
    for t in sorted(trees):
        nodes = sorted(trees[t], key=lambda r: r["id"])
        out.append(Tree(*([r[c] for r in nodes] for c in ("leftChild", "rightChild")), [r["split"]["featureIndex"] for r in nodes],
                        [(r["split"]["leftCategoriesOrThreshold"] or [0.0])[0] for r in nodes], [r["rawCount"] for r in nodes],
                        [r["impurityStats"] for r in nodes]))
    return out


def grown_trees(model: FO.ForestModel) -> list[Tree]:
    """The trees of a model of ``forest.fit``."""
    return [Tree(t["kid"], np.where(t["kid"] >= 0, t["kid"] + 1, -1), t["feature"],
                 np.where(t["kid"] >= 0, model.at[t["feature"], np.minimum(t["cut"], model.at.shape[1] - 1)], 0.0),
                 np.rint(t["stats"][:, -1]), t["stats"][:, :-1]) for t in model.trees]


# ---------------------------------------------------------------- scorers

def score(counts: dict[tuple[int, int], int], metric: str) -> float:
    """A metric from the counts of (label, prediction); f1, recall and precision are of class 1, 0 where undefined."""
    def ratio(a, b):
        return a / b if b else 0.0

    total = sum(counts.values())
    if metric == "accuracy":
        return ratio(sum(n for (y, p), n in counts.items() if y == p), total)
    classes = sorted({c for pair in counts for c in pair})

    def of(c):
        hit = counts.get((c, c), 0)
        real, said = (sum(n for pair, n in counts.items() if pair[i] == c) for i in (0, 1))
        return hit, real, said

    hit, real, said = of(1)
    if metric == "f1":
        return ratio(2 * hit, real + said)
    if metric == "recall":
        return ratio(hit, real)
    if metric == "precision":
        return ratio(hit, said)
    if metric == "f1_macro":
        return float(np.mean([ratio(2 * h, r + s) for h, r, s in map(of, classes)])) if classes else 0.0
    raise ValueError(f"unknown metric {metric!r}")


METRICS = ("accuracy", "f1", "recall", "precision", "f1_macro")


# ---------------------------------------------------------------- the search

class PipelineSearch:
    """Cross-validated search over points of (stages, classifier) settings.

    ``fitted`` counts the fits by (fold, stage, settings up to it); ``parallelism`` is the
    number of classifier fits under way at a time.
    """

    def __init__(self, stages: list, classifier, metric: str = "accuracy", fold_col: str = "fold", parallelism: int = 1):
        self.stages, self.classifier, self.metric = stages, classifier, metric
        self.fold_col, self.parallelism = fold_col, parallelism
        self.fitted: Counter = Counter()
        self.counts: dict[tuple[int, int], dict] = {}  # (point, fold) -> counts of (label, prediction)

    def run(self, train: DataFrame, points: list[dict]) -> PipelineSearch:
        """Scores every point on every fold of ``train``."""
        known = {n for s in [*self.stages, self.classifier] for n in s.settings}
        if unknown := {n for p in points for n in p} - known:
            raise ValueError(f"settings of no stage: {sorted(unknown)}")
        self.points, self.counts = points, {}
        self.folds = sorted(r[0] for r in train.select(self.fold_col).distinct().collect())  # k fold ids
        first = self.stages[0] if self.stages and isinstance(self.stages[0], Vectorise) else None
        if first:
            first.expect(points)
            train = first.words(train).cache()
        for fold in self.folds:
            rest, held = train.where(F.col(self.fold_col) != fold), train.where(F.col(self.fold_col) == fold)
            self._branch(fold, rest.drop(self.fold_col), [held.drop(self.fold_col)], dict(enumerate(points)), 0, ())
        if first:
            train.unpersist()
        return self

    def _branch(self, fold, train, others, points, depth, path) -> None:
        """The points below one prefix: its tables are held while its branches run."""
        if depth == len(self.stages):
            self._leaves(fold, train, others[0], points, path)
            return
        stage = self.stages[depth]
        for key, own in self._groups(points, stage.settings):
            self.fitted[fold, type(stage).__name__, path + key] += 1
            tables = [t.cache() for t in stage(train, others, **dict(key))]
            try:
                self._branch(fold, tables[0], tables[1:], own, depth + 1, path + key)
            finally:
                for t in tables:
                    t.unpersist()

    @staticmethod
    def _groups(points: dict[int, dict], names) -> list[tuple[tuple, dict[int, dict]]]:
        groups: dict[tuple, dict] = {}
        for i, p in points.items():
            groups.setdefault(_key(p, names), {})[i] = p
        return list(groups.items())

    def _leaves(self, fold, train, held, points, path) -> None:
        def leaf(group):
            key, own = group
            model = self.classifier.fit(train, list(own.values()))
            return key, self.classifier.counts(model, held, own).collect()  # points x classes^2 rows

        with ThreadPoolExecutor(self.parallelism) as pool:
            for key, rows in pool.map(leaf, self._groups(points, self.classifier.shared)):
                self.fitted[fold, type(self.classifier).__name__, path + key] += 1
                for i in points:
                    self.counts.setdefault((i, fold), {})
                for r in rows:
                    self.counts[r["point"], fold][r["label"], r["pred"]] = r["n"]

    def scores(self, i: int, metric: str | None = None) -> list[float]:
        """A point's score on every fold."""
        return [score(self.counts[i, f], metric or self.metric) for f in self.folds]

    def mean(self, i: int, metric: str | None = None) -> float:
        return round(float(np.mean(self.scores(i, metric))), 9)

    def best(self) -> int:
        """The number of the point with the best mean score; ties go to the earlier point."""
        return max(range(len(self.points)), key=lambda i: (self.mean(i), -i))

    def table(self, spark) -> DataFrame:
        """(point, fold, every metric) as a DataFrame."""
        rows = [(i, int(f), *(score(self.counts[i, f], m) for m in METRICS)) for i in range(len(self.points)) for f in self.folds]
        return spark.createDataFrame(rows, "point int, fold int, " + ", ".join(f"{m} double" for m in METRICS))

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """(msg_id, label, pred) of test rows by the best point, refitted on all train rows."""
        point = self.points[self.best()]
        rows, others = train.drop(self.fold_col), [test]
        for stage in self.stages:
            rows, *others = stage(rows, others, **dict(_key(point, stage.settings)))
        return self.classifier.predict(self.classifier.fit(rows, [point]), others[0], point)
