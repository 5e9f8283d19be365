"""Model, ensemble, tuning and scoring keys.

All fit on the train part of a stratified split (25 % test) with the
vocabulary fitted on train rows only, folds dealt inside the train part,
and report predictions for the test rows.  Vocabularies are taken by (count,
term), so they do not depend on how the table is partitioned.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, IDF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.functions.lexicon import NLTK_STOPWORDS
from lurescan.operators import evaluate as EV
from lurescan.operators import models as MD
from lurescan.operators import resample as RS
from lurescan.operators import search as SR
from lurescan.operators import splits as SP
from lurescan.operators import svd as SVD
from lurescan.operators import vectorize as V
from lurescan.plans.registry import register
from lurescan.session import scoped_cache, scratch_dir
from lurescan.sources import fixtures as FX

# the scripts' vectoriser sizes: the voting and tree scripts, the SVM and the kNN scripts
VOCAB = 1000
SVM_VOCAB = 10000
FOREST_VOCAB = 3000


def split_texts(spark, sf, three: bool = False):
    """Messages with ``is_test``: the split ranks (id, label) only and joins the flag once."""
    m = FX.m3(spark, sf) if three else FX.m2(spark, sf)
    flag = SP.split_stratified(m.select("msg_id", "label"), "msg_id", "label", 0.25, 42).select("msg_id", "is_test")
    return m.join(flag, "msg_id")


def prepared(spark, sf, three: bool = False, weighted: bool = False, k: int = 5, vocab: int | None = VOCAB,
             bundle: str | None = "email"):
    """(train, test, names, n_classes, n_train): featurised, train rows carry a stratified ``fold``."""
    sp = scoped_cache(split_texts(spark, sf, three))
    rows, asked = (sp.where(F.col("is_test") == t).drop("is_test") for t in (0, 1))
    feats, names = MD.featurize(rows, "text", vocab, bundle)
    test = MD.with_features(asked, names[:len(names) - len(T.FEATURE_BUNDLES.get(bundle, []))], "text", bundle)
    fold = SP.kfold_stratified(rows.select("msg_id", "label"), "msg_id", "label", k=k, seed=42)
    train = feats.join(fold.select("msg_id", "fold"), "msg_id")
    if weighted:
        train = MD.balanced_weights(train)
    # fits and searches read these many times: keep them
    train, test = MD.settled(train), scoped_cache(test)
    n = train.count()
    return MD.fit_rows(train, n, MD.HEAVY_ROWS), test, names, (3 if three else 2), n


def _out(df):
    cols = ["msg_id", "label", "pred"]
    if "proba" in df.columns:
        cols.append(F.round(F.col("proba")[1], 6).alias("p1"))
    return df.select(*cols)


def _fit_predict(name, three=False, weighted=False, vocab=VOCAB, bundle="email", **options):
    def q(spark, sf):
        train, test, names, k, n = prepared(spark, sf, three, weighted, vocab=vocab, bundle=bundle)
        est = MD.estimator(name, len(names), k, weighted=weighted, n_rows=n, **options)
        return _out(MD.prediction_frame(MD.fit(est, train, n), test))
    q.__name__ = f"model_{name}"
    return q


def _sql_nb():
    """Multinomial naive Bayes on counts with Spark's smoothed class prior, and its class-1 probability."""
    from lurescan.plans.q_splits import h48_sql, sql_quotas
    return FX.with_ctes(
        FX.SQL_M2, sql_quotas("m2", 0.25),
        "sp AS (SELECT m.msg_id, m.text, m.label, row_number() OVER (PARTITION BY m.label ORDER BY "
        + h48_sql(42, "m.msg_id") + ", m.msg_id) <= q.n - q.n_train AS is_test FROM m2 m JOIN quota q ON m.label = q.label)",
        "tc AS (SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest(regexp_extract_all(lower(text), "
        "'[\\p{L}\\p{N}_]{2,}')) AS term FROM sp) x GROUP BY msg_id, term)",
        "vocab AS (SELECT tc.term FROM tc JOIN sp ON tc.msg_id = sp.msg_id WHERE NOT sp.is_test GROUP BY tc.term "
        f"ORDER BY sum(tc.tf) DESC, tc.term LIMIT {VOCAB})",
        "nd AS (SELECT label AS cls, count(*) AS n FROM sp WHERE NOT is_test GROUP BY label)",
        "nct AS (SELECT sp.label AS cls, tc.term, sum(tc.tf) AS n_ct FROM tc JOIN sp ON tc.msg_id = sp.msg_id "
        "JOIN vocab ON tc.term = vocab.term WHERE NOT sp.is_test GROUP BY ALL)",
        "w AS (SELECT nd.cls, v.term, ln(coalesce(nct.n_ct, 0) + 1.0) - ln((SELECT sum(n_ct) FROM nct t WHERE t.cls = nd.cls) "
        "+ (SELECT count(*) FROM vocab)) AS w FROM nd CROSS JOIN vocab v LEFT JOIN nct ON nct.cls = nd.cls AND nct.term = v.term)",
        "sc AS (SELECT sp.msg_id, sp.label, nd.cls, ln(nd.n + 1.0) - ln((SELECT sum(n) FROM nd) + (SELECT count(*) FROM nd)) "
        "+ coalesce(sum(tc.tf * w.w), 0) AS s FROM sp CROSS JOIN nd LEFT JOIN tc ON tc.msg_id = sp.msg_id "
        "LEFT JOIN w ON w.term = tc.term AND w.cls = nd.cls WHERE sp.is_test GROUP BY sp.msg_id, sp.label, nd.cls, nd.n)") + (
        "SELECT msg_id, label, CAST(max(s) FILTER (cls = 1) > max(s) FILTER (cls = 0) AS INTEGER) AS pred, "
        "round(1 / (1 + exp(least(greatest(max(s) FILTER (cls = 0) - max(s) FILTER (cls = 1), -700), 700))), 6) AS p1 "
        "FROM sc GROUP BY msg_id, label")


register("model_nb", sql=_sql_nb())(_fit_predict("nb", bundle=None))
register("model_logreg")(_fit_predict("logreg", three=True, weighted=True))
register("model_tree")(_fit_predict("tree"))
register("model_forest", bench=True)(_fit_predict("forest", weighted=True, vocab=FOREST_VOCAB))
register("model_gbt")(_fit_predict("gbt"))
register("model_svm_linear")(_fit_predict("svm_linear", three=True, weighted=True, vocab=SVM_VOCAB))
register("model_mlp")(_fit_predict("mlp", layers=(128, 64)))


def model_knn_text(spark, sf, components: int = 100, neighbours: int = 5):
    """n-gram TF-IDF fitted on train -> SVD of the train rows -> cosine kNN vote for the test rows."""
    sp = scoped_cache(split_texts(spark, sf))
    train, test = (sp.where(F.col("is_test") == t).select("msg_id", "label", "text") for t in (0, 1))
    tfidf = V.NgramTfidf(n_max=2, max_features=5000, stop_words=NLTK_STOPWORDS).fit(train, "msg_id", "text")
    vocab = tfidf.idf.select("term")
    rows, d = SVD.matrix_rows(tfidf.transform(train, "msg_id", "text"), train, "msg_id", vocab)
    rows = scoped_cache(rows)
    v = SVD.loadings(rows, d, components)
    asked, _ = SVD.matrix_rows(tfidf.transform(test, "msg_id", "text"), test, "msg_id", vocab)
    refs = SVD.project(rows, v, "msg_id").join(train.select("msg_id", "label"), "msg_id")
    votes = RS.knn_vote(SVD.project(asked, v, "msg_id"), refs, neighbours, id_col="msg_id", vec_col="x")
    return test.select("msg_id", "label").join(votes.withColumnRenamed("pred_uniform", "pred"), "msg_id", "left")


register("model_knn_text")(model_knn_text)


def pipeline_smote_tomek(spark, sf):
    """Message features -> SMOTE and Tomek links on the train rows -> forest; test predictions."""
    sp = split_texts(spark, sf)
    names = T.FEATURE_BUNDLES["sms"]
    feats = sp.select("msg_id", "label", "is_test", *T.message_features(F.col("text"), "sms"))
    stats = V.standard_scale_stats(feats.where(F.col("is_test") == 0), names)
    scaled = scoped_cache(V.standard_scale(feats, stats).select(
        "msg_id", "label", "is_test", F.array(*[F.col(c).cast("double") for c in names]).alias("x")))
    train = scaled.where(F.col("is_test") == 0).drop("is_test")
    grown = RS.with_synthetic(train, RS.smote(train, "msg_id", "x", "label"), "msg_id", "x", "label")
    grown = RS.tomek_links(grown, "msg_id", "x", "label").select("label", array_to_vector("x").alias("features"))
    grown = MD.settled(grown)
    n = grown.count()
    model = MD.fit(MD.estimator("forest"), MD.fit_rows(grown, n, MD.HEAVY_ROWS), n)
    test = scaled.where(F.col("is_test") == 1).select("msg_id", "label", array_to_vector("x").alias("features"))
    return _out(MD.prediction_frame(model, test))


register("pipeline_smote_tomek")(pipeline_smote_tomek)


def model_svm_rbf(spark, sf):
    """RBF-kernel SVM re-aimed: random Fourier features (256, library's gamma) then a linear SVM."""
    train, test, names, _, n = prepared(spark, sf)
    d, gamma = len(names), MD.scale_gamma(train, len(names))
    m = MD.fit(MD.estimator("svm_linear", n_rows=n), MD.random_fourier(train, d, gamma), n)
    return _out(MD.prediction_frame(m, MD.random_fourier(test, d, gamma)))


register("model_svm_rbf")(model_svm_rbf)


def svm_probability(spark, sf):
    """Linear SVM with Platt-scaled probabilities from out-of-fold margins."""
    train, test, _, _, n = prepared(spark, sf)
    return _out(MD.platt_svm(train, test, n_rows=n))


register("svm_probability")(svm_probability)


def vote_soft(spark, sf):
    """Soft vote of naive Bayes, random forest and a linear SVM with probabilities, on counts."""
    train, test, names, k, n = prepared(spark, sf, bundle=None)
    frames = [MD.prediction_frame(MD.fit(MD.estimator(x, len(names), k, n_rows=n), train, n), test) for x in ("nb", "forest")]
    return _out(MD.vote_frames([*frames, MD.platt_svm(train, test, n_rows=n)]))


register("vote_soft")(vote_soft)


def vote_boosted(spark, sf):
    """Soft vote of a perceptron, a random forest and boosted trees."""
    train, test, names, k, n = prepared(spark, sf)
    return _out(MD.vote_frames([MD.prediction_frame(MD.fit(MD.estimator(x, len(names), k, n_rows=n), train, n), test)
                                for x in ("mlp", "forest", "gbt")]))


register("vote_boosted")(vote_boosted)


def stack_models(spark, sf):
    """Forest and logistic regression (5-fold out-of-fold) under a logistic meta model, class weights throughout."""
    train, test, names, k, n = prepared(spark, sf, weighted=True)
    bases = [MD.estimator(x, len(names), k, weighted=True, n_rows=n) for x in ("forest", "logreg")]
    return _out(MD.stack(train, test, bases, MD.estimator("logreg", 2, k, weighted=True, n_rows=n), k))


register("stack_models")(stack_models)


def stack_three(spark, sf):
    """Three classes: every class's score of the forest and the logistic base reaches the logistic meta model."""
    train, test, names, k, n = prepared(spark, sf, three=True)
    bases = [MD.estimator(x, len(names), k, n_rows=n, max_depth=20) for x in ("forest", "logreg")]
    return _out(MD.stack(train, test, bases, MD.estimator("logreg", 2 * k, k, n_rows=n), k))


register("stack_three")(stack_three)


def stack_svc_tree(spark, sf):
    """Linear SVC margins and tree probabilities under a forest meta model."""
    train, test, names, k, n = prepared(spark, sf)
    bases = [MD.estimator(x, len(names), k, n_rows=n) for x in ("svm_linear", "tree")]
    return _out(MD.stack(train, test, bases, MD.estimator("forest", 2, k), k))


register("stack_svc_tree")(stack_svc_tree)

PIPE_NAMES = T.FEATURE_BUNDLES["sms"]


def _message_rows(df, *keep):
    return df.select(*keep, V.sklearn_tokens("text").alias("tokens"),
                     *[c.cast("double") for c in T.message_features(F.col("text"), "sms")])


def fitted_pipeline(train, vocab: int | None = FOREST_VOCAB):
    """Counts -> idf -> assemble -> forest (depth unlimited), fitted on the given rows."""
    names = MD.vocabulary(train, "text", vocab)
    cv = CountVectorizerModel.from_vocabulary(names, inputCol="tokens", outputCol="tf")
    rows = MD.settled(cv.transform(_message_rows(train, "msg_id", "label")).drop("tokens").withColumn("tf", MD.unnamed("tf", len(names))))
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(rows)
    va = VectorAssembler(inputCols=["tfidf"] + PIPE_NAMES, outputCol="features")
    size = len(names) + len(PIPE_NAMES)
    ready = MD.settled(va.transform(idf.transform(rows)).select("label", MD.unnamed("features", size)))
    forest = RandomForestClassifier(numTrees=100, featureSubsetStrategy="sqrt", seed=42, labelCol="label",
                                    maxDepth=MD.UNLIMITED_DEPTH, **MD.DEEP)
    n = ready.count()
    return PipelineModel(stages=[cv, idf, va, MD.fit(forest, MD.fit_rows(ready, n, MD.HEAVY_ROWS), n)])


def pipeline_fit(spark, sf):
    """Tokens -> counts -> idf -> assemble -> forest, with oversampling applied to the train rows only."""
    sp = split_texts(spark, sf)
    train = RS.oversample_random(sp.where(F.col("is_test") == 0).drop("is_test"), "msg_id", "label", 42)
    test = sp.where(F.col("is_test") == 1).drop("is_test")
    out = fitted_pipeline(train).transform(_message_rows(test, "msg_id", "label"))
    return out.select("msg_id", "label", F.col("prediction").cast("int").alias("pred"),
                      F.round(vector_to_array("probability")[1], 6).alias("p1"))


register("pipeline_fit")(pipeline_fit)


def score_messages(spark, sf):
    """A pipeline fitted on the labelled messages, saved, loaded, and applied to every message of the table."""
    path = scratch_dir(spark, "model")
    fitted_pipeline(FX.m2(spark, sf)).write().overwrite().save(path)
    every = FX.table(spark, sf, "documents").select(F.col("doc_id").alias("msg_id"), "text", "lang", "source")
    out = PipelineModel.load(path).transform(_message_rows(every, "msg_id", "text", "lang", "source"))
    return out.select("msg_id", F.col("text").alias("body"), "lang", "source", F.col("prediction").cast("int").alias("prediction"))


register("score_messages")(score_messages)

# the scripts' grids; depth None is Spark's largest
TREE_GRID = {"max_depth": [None, 10, 20, 30], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]}
FOREST_GRID = {"max_features": [5000, 10000, 15000], "ngram_max": [2, 3], "n_estimators": [100, 200, 300, 400],
               "max_depth": [None, 10, 20, 30], "max_features_split": ["sqrt", "log2", "all"], "min_samples_split": [2, 5],
               "min_samples_leaf": [1, 2], "bootstrap": [True, False]}
FOREST_FITS = ("max_features", "ngram_max", "max_features_split", "min_samples_leaf", "bootstrap")
FOREST_WEIGHTS = {0: 1.0, 1: 5.0}


def folded_texts(spark, sf, k: int):
    """(train with ``fold``, test) message texts of the stratified split."""
    sp = scoped_cache(split_texts(spark, sf))
    train = sp.where(F.col("is_test") == 0).drop("is_test")
    fold = SP.kfold_stratified(train.select("msg_id", "label"), "msg_id", "label", k=k, seed=42).select("msg_id", "fold")
    return scoped_cache(train.join(fold, "msg_id")), sp.where(F.col("is_test") == 1).drop("is_test")


def grid_search_tree(spark, sf, values=TREE_GRID, metric: str = "accuracy"):
    """All 36 points of the scripts' tree grid, 5-fold, vectoriser inside the folds; test predictions of the best."""
    train, test = folded_texts(spark, sf, 5)
    found = SR.PipelineSearch([SR.Vectorise(bundle="email")], SR.Trees(), metric, parallelism=4).run(train, SR.grid(**values))
    return found.predict(train, test)


register("grid_search_tree")(grid_search_tree)


def random_search_forest(spark, sf, values=FOREST_GRID, n_iter: int = 20, metric: str = "f1", per_group: int = 10):
    """20 draws of the scripts' forest pipeline grid (2304 points), 4-fold; test predictions of the best.

    The vectoriser gives term counts, which need far fewer split candidates than
    weights that differ in every row (``SR.Vectorise()`` gives TF-IDF).  Drawn in groups of ``per_group`` points that share their fits:
    a forest answers for fewer trees, lower depths and larger splits, too.
    """
    train, test = folded_texts(spark, sf, 4)
    points = SR.sampled(SR.grid(**values), n_iter, shared=FOREST_FITS, per_group=per_group)
    forests = SR.Trees(forest=True, class_weight=FOREST_WEIGHTS)
    return SR.PipelineSearch([SR.Vectorise(tfidf=False, bundle="email")], forests, metric, parallelism=4).run(train, points).predict(train, test)


register("random_search_forest")(random_search_forest)


def cross_val_forest(spark, sf):
    """Accuracy, F1, recall, precision and macro F1 of a forest on each of five folds, vectoriser inside the folds."""
    train, _ = folded_texts(spark, sf, 5)
    point = {"max_features": VOCAB, "ngram_max": 1, "n_estimators": 100}
    found = SR.PipelineSearch([SR.Vectorise(tfidf=False, bundle="email")], SR.Trees(forest=True), parallelism=4).run(train, [point])
    return found.table(spark).drop("point")


register("cross_val_forest")(cross_val_forest)

# searches whose every number SQL can follow: naive Bayes over its smoothing, vectoriser inside the folds
ALPHAS = (0.1, 0.5, 1.0, 2.0, 5.0)
FOLDS = 5


def nb_folds(sp, alphas, k: int = FOLDS):
    """(fold, alpha, msg_id, label, pred): out-of-fold predictions, the vocabulary refitted without each fold."""
    train = sp.where(F.col("is_test") == 0).drop("is_test")
    fold = SP.kfold_stratified(train.select("msg_id", "label"), "msg_id", "label", k=k, seed=42).select("msg_id", "fold")
    train = scoped_cache(train.join(fold, "msg_id"))
    out = None
    for f in range(k):
        rest = train.where(F.col("fold") != f)
        feats, _ = MD.featurize(train, "text", VOCAB, None, fit_on=rest)
        feats = scoped_cache(feats)
        for a in alphas:
            model = MD.estimator("nb").setSmoothing(a).fit(feats.where(F.col("fold") != f))
            pred = MD.prediction_frame(model, feats.where(F.col("fold") == f)).select(
                F.lit(f).alias("fold"), F.lit(float(a)).alias("alpha"), "msg_id", "label", "pred")
            out = pred if out is None else out.unionByName(pred)
    return out


def fold_scores(pred):
    """(fold, alpha, accuracy, f1_macro) from one aggregation by class."""
    hit = (F.col("label") == F.col("pred")).cast("long")
    both = pred.select("fold", "alpha", F.explode(F.array(
        F.struct(F.col("label").cast("int").alias("cls"), hit.alias("tp"), F.lit(1).alias("y"), F.lit(0).alias("p")),
        F.struct(F.col("pred").cast("int").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).alias("y"), F.lit(1).alias("p")))).alias("c"))
    by = both.groupBy("fold", "alpha", "c.cls").agg(F.sum("c.tp").alias("tp"), F.sum("c.y").alias("y"), F.sum("c.p").alias("p"))
    return by.groupBy("fold", "alpha").agg((F.sum("tp") / F.sum("y")).alias("accuracy"),
                                           F.avg(2 * F.col("tp") / (F.col("y") + F.col("p"))).alias("f1_macro"))


def cross_val_scores(spark, sf):
    """Accuracy and macro F1 of naive Bayes (alpha 1) on each of five folds."""
    s = fold_scores(nb_folds(split_texts(spark, sf), [1.0]))
    return s.select("fold", F.round("accuracy", 9).alias("accuracy"), F.round("f1_macro", 9).alias("f1_macro"))


def mean_scores(spark, sf):
    """Means over the folds."""
    s = fold_scores(nb_folds(split_texts(spark, sf), [1.0]))
    return s.agg(F.round(F.avg("accuracy"), 9).alias("mean_accuracy"), F.round(F.avg("f1_macro"), 9).alias("mean_f1_macro"))


NB_GRID = {"max_features": [250, 500, 1000, 3000], "alpha": list(ALPHAS)}


def nb_search(spark, sf, points, metric: str):
    """The naive Bayes point with the best mean fold score (ties: the earlier); test predictions.

    A vectoriser size is fitted once a fold and serves all its smoothings.
    """
    train, test = folded_texts(spark, sf, FOLDS)
    found = SR.PipelineSearch([SR.Vectorise(tfidf=False)], SR.NaiveBayes(), metric).run(train, points)
    best = points[found.best()]
    return found.predict(train, test).select("msg_id", "label", "pred", F.lit(best["max_features"]).alias("max_features"),
                                             F.lit(best["alpha"]).alias("alpha"))


def grid_search(spark, sf, values=NB_GRID, metric: str = "f1_macro"):
    """Every vectoriser size and smoothing of the grid, 5-fold, macro F1."""
    return nb_search(spark, sf, SR.grid(**values), metric)


def random_search(spark, sf, values=NB_GRID, n_iter: int = 10, metric: str = "f1"):
    """A seeded sample of the grid, 5-fold, F1 of class 1."""
    return nb_search(spark, sf, SR.sampled(SR.grid(**values), n_iter), metric)


def _sql_nb_search(points, metric):
    """DuckDB twin: naive Bayes of every (size, alpha) on every fold; fold -1 stands for all train rows."""
    values = ", ".join(f"({i}, {p['max_features']}, {float(p['alpha'])!r})" for i, p in enumerate(points))
    f1 = {"f1": "2 * max(tp) FILTER (cls = 1) / (max(y) FILTER (cls = 1) + max(p) FILTER (cls = 1))", "f1_macro": "avg(2 * tp / (y + p))"}[metric]
    return FX.with_ctes(
        *_sql_nb_cv([1.0])[:7],
        "vocab AS (SELECT fold, term, row_number() OVER (PARTITION BY fold ORDER BY sum(tf) DESC, term) AS r FROM ft WHERE NOT held GROUP BY fold, term)",
        "nd AS (SELECT fold, label AS cls, count(*) AS n FROM rw WHERE NOT held GROUP BY ALL)",
        "ns AS (SELECT fold, sum(n) AS n, count(*) AS k FROM nd GROUP BY fold)",
        "nct AS (SELECT fold, label AS cls, term, r, sum(tf) AS c FROM ft JOIN vocab USING (fold, term) WHERE NOT held GROUP BY ALL)",
        f"pt AS (SELECT * FROM (VALUES {values}) t(point, size, alpha))",
        "sz AS (SELECT DISTINCT size FROM pt)",
        "vs AS (SELECT fold, size, count(*) AS v FROM vocab JOIN sz ON r <= size GROUP BY ALL)",
        "nc AS (SELECT fold, cls, size, sum(c) AS c FROM nct JOIN sz ON r <= size GROUP BY ALL)",
        "sc AS (SELECT rw.fold, pt.point, rw.msg_id, rw.label, nd.cls, ln(nd.n + alpha) - ln(ns.n + ns.k * alpha) "
        "+ coalesce(sum(CASE WHEN vocab.r <= pt.size THEN ft.tf * (ln(coalesce(nct.c, 0) + alpha) - ln(nc.c + alpha * vs.v)) END), 0) AS s "
        "FROM rw CROSS JOIN pt JOIN nd ON nd.fold = rw.fold JOIN ns ON ns.fold = rw.fold JOIN vs ON vs.fold = rw.fold AND vs.size = pt.size "
        "JOIN nc ON nc.fold = rw.fold AND nc.cls = nd.cls AND nc.size = pt.size "
        "LEFT JOIN ft ON ft.fold = rw.fold AND ft.msg_id = rw.msg_id LEFT JOIN vocab ON vocab.fold = rw.fold AND vocab.term = ft.term "
        "LEFT JOIN nct ON nct.fold = rw.fold AND nct.cls = nd.cls AND nct.term = ft.term "
        "WHERE rw.held GROUP BY rw.fold, pt.point, rw.msg_id, rw.label, nd.cls, nd.n, ns.n, ns.k, alpha)",
        "pr AS (SELECT fold, point, msg_id, label, arg_max(cls, s) AS pred FROM sc GROUP BY ALL)",
        "by_ AS (SELECT fold, point, cls, sum(tp) AS tp, sum(y) AS y, sum(p) AS p FROM ("
        "SELECT fold, point, label AS cls, CAST(label = pred AS INTEGER) AS tp, 1 AS y, 0 AS p FROM pr WHERE fold >= 0 UNION ALL "
        "SELECT fold, point, pred, 0, 0, 1 FROM pr WHERE fold >= 0) x GROUP BY ALL)",
        f"fs AS (SELECT fold, point, coalesce({f1}, 0) AS m FROM by_ GROUP BY ALL)",
        "best AS (SELECT point FROM (SELECT point, round(avg(m), 9) AS m FROM fs GROUP BY point) x ORDER BY m DESC, point LIMIT 1)") + (
        "SELECT msg_id, label, CAST(pred AS INTEGER) AS pred, CAST(size AS INTEGER) AS max_features, CAST(alpha AS DOUBLE) AS alpha "
        "FROM pr JOIN best USING (point) JOIN pt USING (point) WHERE fold = -1")


def _sql_nb_cv(alphas) -> list[str]:
    """CTEs: fs(fold, alpha, accuracy, f1_macro) of the searches above; fold -1 stands for all train rows."""
    from lurescan.plans.q_splits import h48_sql, sql_quotas
    points = ", ".join(f"({float(a)!r})" for a in alphas)
    return [
        FX.SQL_M2, sql_quotas("m2", 0.25),
        "sp AS (SELECT m.msg_id, m.text, m.label, row_number() OVER (PARTITION BY m.label ORDER BY "
        + h48_sql(42, "m.msg_id") + ", m.msg_id) <= q.n - q.n_train AS is_test FROM m2 m JOIN quota q ON m.label = q.label)",
        f"own AS (SELECT msg_id, (row_number() OVER (PARTITION BY label ORDER BY {h48_sql(42)}, msg_id) - 1) % {FOLDS} AS own "
        "FROM sp WHERE NOT is_test)",
        f"rw AS (SELECT f.fold, sp.msg_id, sp.label, coalesce(own.own = f.fold, true) AS held FROM sp LEFT JOIN own USING (msg_id) "
        f"CROSS JOIN (SELECT unnest(range(-1, {FOLDS})) AS fold) f WHERE sp.is_test = (f.fold = -1) OR NOT sp.is_test)",
        "tc AS (SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest(regexp_extract_all(lower(text), "
        "'[\\p{L}\\p{N}_]{2,}')) AS term FROM sp) x GROUP BY ALL)",
        "ft AS (SELECT rw.fold, rw.msg_id, rw.label, rw.held, tc.term, tc.tf FROM rw JOIN tc USING (msg_id))",
        f"vocab AS (SELECT fold, term FROM (SELECT fold, term, row_number() OVER (PARTITION BY fold ORDER BY sum(tf) DESC, term) AS r "
        f"FROM ft WHERE NOT held GROUP BY fold, term) x WHERE r <= {VOCAB})",
        "vs AS (SELECT fold, count(*) AS v FROM vocab GROUP BY fold)",
        "nd AS (SELECT fold, label AS cls, count(*) AS n FROM rw WHERE NOT held GROUP BY ALL)",
        "ns AS (SELECT fold, sum(n) AS n, count(*) AS k FROM nd GROUP BY fold)",
        "nct AS (SELECT fold, label AS cls, term, sum(tf) AS c FROM ft JOIN vocab USING (fold, term) WHERE NOT held GROUP BY ALL)",
        "nc AS (SELECT fold, cls, sum(c) AS c FROM nct GROUP BY ALL)",
        f"pt AS (SELECT * FROM (VALUES {points}) t(alpha))",
        "sc AS (SELECT rw.fold, pt.alpha, rw.msg_id, rw.label, nd.cls, ln(nd.n + alpha) - ln(ns.n + ns.k * alpha) "
        "+ coalesce(sum(CASE WHEN vocab.term IS NOT NULL THEN ft.tf * (ln(coalesce(nct.c, 0) + alpha) - ln(nc.c + alpha * vs.v)) END), 0) AS s "
        "FROM rw CROSS JOIN pt JOIN nd ON nd.fold = rw.fold JOIN ns ON ns.fold = rw.fold JOIN vs ON vs.fold = rw.fold "
        "JOIN nc ON nc.fold = rw.fold AND nc.cls = nd.cls "
        "LEFT JOIN ft ON ft.fold = rw.fold AND ft.msg_id = rw.msg_id LEFT JOIN vocab ON vocab.fold = rw.fold AND vocab.term = ft.term "
        "LEFT JOIN nct ON nct.fold = rw.fold AND nct.cls = nd.cls AND nct.term = ft.term "
        "WHERE rw.held GROUP BY rw.fold, pt.alpha, rw.msg_id, rw.label, nd.cls, nd.n, ns.n, ns.k)",
        "pr AS (SELECT fold, alpha, msg_id, label, arg_max(cls, s) AS pred FROM sc GROUP BY ALL)",
        "by_ AS (SELECT fold, alpha, cls, sum(tp) AS tp, sum(y) AS y, sum(p) AS p FROM ("
        "SELECT fold, alpha, label AS cls, CAST(label = pred AS INTEGER) AS tp, 1 AS y, 0 AS p FROM pr WHERE fold >= 0 UNION ALL "
        "SELECT fold, alpha, pred, 0, 0, 1 FROM pr WHERE fold >= 0) x GROUP BY ALL)",
        "fs AS (SELECT fold, alpha, sum(tp) / sum(y) AS accuracy, avg(2 * tp / (y + p)) AS f1_macro FROM by_ GROUP BY ALL)"]


register("cross_val_scores", sql=FX.with_ctes(*_sql_nb_cv([1.0])) + (
    "SELECT CAST(fold AS INTEGER) AS fold, round(accuracy, 9) AS accuracy, round(f1_macro, 9) AS f1_macro FROM fs"))(cross_val_scores)
register("mean_scores", sql=FX.with_ctes(*_sql_nb_cv([1.0])) + (
    "SELECT round(avg(accuracy), 9) AS mean_accuracy, round(avg(f1_macro), 9) AS mean_f1_macro FROM fs"))(mean_scores)
register("grid_search", sql=_sql_nb_search(SR.grid(**NB_GRID), "f1_macro"))(grid_search)
register("random_search", sql=_sql_nb_search(SR.sampled(SR.grid(**NB_GRID), 10), "f1"))(random_search)


def top_features(spark, sf):
    """Forest importances by feature name, top 20, from one fit."""
    train, _, names, k, n = prepared(spark, sf)
    model = MD.fit(MD.estimator("forest", len(names), k, n_rows=n), train, n)
    imp = model.featureImportances.toArray()  # one value per feature: bounded by the vocabulary cap
    rows = [(name, float(v)) for name, v in zip(names, imp, strict=True)]
    return (spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature").limit(20))


register("top_features")(top_features)


def model_comparison(spark, sf):
    """Accuracy of several models side by side on the same test rows."""
    train, test, names, k, n = prepared(spark, sf, bundle=None)
    parts = []
    for name in ("nb", "logreg", "forest", "tree"):
        pred = MD.prediction_frame(MD.fit(MD.estimator(name, len(names), k, n_rows=n), train, n), test)
        parts.append(EV.accuracy(pred).select(F.lit(name).alias("model"), F.round("accuracy", 6).alias("accuracy")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register("model_comparison")(model_comparison)


def sequence_inputs(spark, sf):
    """What a recurrent trainer consumes: padded id sequences and labels, materialised to Parquet."""
    from lurescan.plans.q_vectors import _seq_str
    m = FX.m2(spark, sf)
    idx = V.word_index(m, V.keras_tokens("text"), num_words=5000, oov=True)
    seqs = V.texts_to_sequences(m, "msg_id", V.keras_tokens("text"), idx, oov=True)
    out = seqs.join(m.select("msg_id", "label"), "msg_id").select(
        "msg_id", "label", V.pad_sequences("seq", 100, "pre", "pre").alias("ids"))
    path = scratch_dir(spark, "sequence-inputs")
    out.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return back.select("msg_id", "label", _seq_str("ids").alias("ids"))


def _sql_sequence_inputs():
    from lurescan.plans.q_vectors import KERAS_TOK_SQL, _sql_pad
    return FX.with_ctes(
        FX.SQL_M2,
        "kc AS (SELECT term, count(*) AS cnt FROM (SELECT unnest(" + KERAS_TOK_SQL + ") AS term FROM m2) x GROUP BY term)",
        "wi AS (SELECT term, row_number() OVER (ORDER BY cnt DESC, term) + 1 AS idx FROM kc)",
        "tok AS (SELECT msg_id, label, " + KERAS_TOK_SQL + " AS t FROM m2)",
        "ex AS (SELECT msg_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM tok)",
        "so AS (SELECT ex.msg_id, list(CASE WHEN w.idx < 5000 THEN w.idx ELSE 1 END ORDER BY ex.pos) AS s "
        "FROM ex LEFT JOIN wi w ON ex.term = w.term GROUP BY ex.msg_id)",
        "seqs AS (SELECT tok.msg_id, tok.label, coalesce(so.s, []::BIGINT[]) AS s FROM tok "
        "LEFT JOIN so ON tok.msg_id = so.msg_id)") + (
        "SELECT msg_id, label, array_to_string(" + _sql_pad("s", 100, "pre", "pre") + ", ',') AS ids FROM seqs")


register("sequence_inputs", sql=_sql_sequence_inputs())(sequence_inputs)


def model_nb_long(spark, sf):
    """Multinomial naive Bayes (alpha 1) in long form over the 1000 most frequent train terms."""
    from lurescan.operators import naive_bayes as NB
    m = FX.m2(spark, sf)
    sp = scoped_cache(SP.split_stratified(m, "msg_id", "label", 0.25, 42))
    tc = V.term_counts(sp, "msg_id", V.sklearn_tokens("text"))
    train_docs = sp.where(F.col("is_test") == 0).select("msg_id", "label")
    test_docs = sp.where(F.col("is_test") == 1).select("msg_id", "label")
    train_tc = tc.join(train_docs.select("msg_id"), "msg_id")
    test_tc = tc.join(test_docs.select("msg_id"), "msg_id")
    vocab = V.vocabulary_topk(train_tc, k=VOCAB).select("term")
    model = NB.fit(train_tc, train_docs, vocab)
    return NB.predict(model, test_tc, test_docs).join(test_docs, "msg_id").select("msg_id", "label", "pred")


def _sql_nb_long():
    from lurescan.plans.q_splits import h48_sql, sql_quotas
    return FX.with_ctes(
        FX.SQL_M2, sql_quotas("m2", 0.25),
        "sp AS (SELECT m.msg_id, m.text, m.label, row_number() OVER (PARTITION BY m.label ORDER BY "
        + h48_sql(42, "m.msg_id") + ", m.msg_id) <= q.n - q.n_train AS is_test FROM m2 m JOIN quota q ON m.label = q.label)",
        "tc AS (SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest(regexp_extract_all(lower(text), "
        "'[\\p{L}\\p{N}_]{2,}')) AS term FROM sp) x GROUP BY msg_id, term)",
        "vocab AS (SELECT tc.term FROM tc JOIN sp ON tc.msg_id = sp.msg_id WHERE NOT sp.is_test GROUP BY tc.term "
        f"ORDER BY sum(tc.tf) DESC, tc.term LIMIT {VOCAB})",
        "vs AS (SELECT count(*) AS v FROM vocab)",
        "nd AS (SELECT label AS cls, count(*) AS n FROM sp WHERE NOT is_test GROUP BY label)",
        "nct AS (SELECT tc.term, sp.label AS cls, sum(tc.tf) AS n_ct FROM tc JOIN sp ON tc.msg_id = sp.msg_id "
        "JOIN vocab ON tc.term = vocab.term WHERE NOT sp.is_test GROUP BY tc.term, sp.label)",
        "nc AS (SELECT cls, sum(n_ct) AS n_c FROM nct GROUP BY cls)",
        "cl AS (SELECT nd.cls, ln(nd.n / (SELECT sum(n) FROM nd)) AS log_prior, "
        "0.0 - ln(coalesce(nc.n_c, 0) + 1.0 * vs.v) AS log_norm FROM nd LEFT JOIN nc ON nd.cls = nc.cls, vs)",
        "w AS (SELECT term, cls, ln(n_ct + 1.0) AS w FROM nct)",
        "te AS (SELECT msg_id, label FROM sp WHERE is_test)",
        "ttc AS (SELECT tc.msg_id, tc.term, tc.tf FROM tc JOIN te ON tc.msg_id = te.msg_id "
        "JOIN vocab ON tc.term = vocab.term)",
        "ln_ AS (SELECT msg_id, sum(tf) AS l FROM ttc GROUP BY msg_id)",
        "s AS (SELECT ttc.msg_id, w.cls, sum(ttc.tf * w.w) AS s FROM ttc JOIN w ON ttc.term = w.term "
        "GROUP BY ttc.msg_id, w.cls)",
        "sc AS (SELECT te.msg_id, te.label, cl.cls, cl.log_prior + coalesce(ln_.l, 0) * cl.log_norm "
        "+ coalesce(s.s, 0.0) AS score FROM te CROSS JOIN cl LEFT JOIN ln_ ON ln_.msg_id = te.msg_id "
        "LEFT JOIN s ON s.msg_id = te.msg_id AND s.cls = cl.cls)") + (
        "SELECT msg_id, label, CAST(cls AS INTEGER) AS pred FROM (SELECT *, row_number() OVER ("
        "PARTITION BY msg_id ORDER BY score DESC, cls) AS r FROM sc) x WHERE r = 1")


register("model_nb_long", sql=_sql_nb_long())(model_nb_long)
