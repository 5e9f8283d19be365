"""Properties of the rows-only and at-scale operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from lurescan.operators import evaluate as EV
from lurescan.operators import models as MD
from lurescan.operators import resample as RS
from lurescan.operators import splits as SP
from lurescan.operators.neighbors import knn
from lurescan.operators.ranking import global_rank, rank_by_hash, hash_key
from lurescan.sources import fixtures as FX


def test_split_stratified_is_exact_partition(spark):
    m = FX.m3(spark, "/root/testdata/sf0.01").select("msg_id", "label")
    sp = SP.split_stratified(m, "msg_id", "label", 0.25, 42)
    rows = sp.collect()
    n = m.count()
    assert len(rows) == n and len({r["msg_id"] for r in rows}) == n
    n_test = sum(r["is_test"] for r in rows)
    assert n_test == math.ceil(0.25 * n)
    q = {r["label"]: (r["n"], r["n_test"]) for r in SP.class_quotas(m, "label", 0.25).collect()}
    for lab, (nc, nt) in q.items():
        assert sum(1 for r in rows if r["label"] == lab and r["is_test"]) == nt
        assert abs(nt - nc * 0.25) < 1.0 + 1e-9


def test_kfold_even(spark):
    m = FX.m3(spark, "/root/testdata/sf0.01").select("msg_id", "label")
    f = SP.kfold_stratified(m, "msg_id", "label", 5, 42)
    counts = f.groupBy("label", "fold").count().collect()
    by_label = {}
    for r in counts:
        by_label.setdefault(r["label"], []).append(r["count"])
    for sizes in by_label.values():
        assert max(sizes) - min(sizes) <= 1


def test_rank_by_hash_is_permutation_and_matches_sort(spark):
    v = FX.embeddings(spark, SF_SMALL).select("vec_id", "label")
    r = rank_by_hash(v, "vec_id", hash_key(7, "vec_id"), partition_cols=["label"], rank_col="rk")
    rows = r.select("vec_id", "label", "rk", hash_key(7, "vec_id").alias("k")).collect()
    for lab in {x["label"] for x in rows}:
        part = sorted((x for x in rows if x["label"] == lab), key=lambda x: (x["k"], x["vec_id"]))
        assert [x["rk"] for x in part] == list(range(1, len(part) + 1))


def test_global_rank_many_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id"))
    r = global_rank(df, [F.desc("k"), F.asc("id")], num_partitions=13).select("k", "rank").collect()
    assert sorted(x["rank"] for x in r) == list(range(1, 5001))
    assert all(x["rank"] == 5000 - x["k"] for x in r)


def _brute_knn(rows, k, metric):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i, q in enumerate(x):
        if metric == "cosine":
            d = 1.0 - (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
        else:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
        d[i] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocked_knn_equals_brute_force(spark, metric):
    v = FX.embeddings(spark, SF_SMALL)
    rows = [(r["vec_id"], r["embedding"]) for r in v.collect()]
    nn = knn(v, v, 5, metric=metric, block_rows=64).collect()  # many blocks on both sides
    got = {}
    for r in sorted(nn, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["nid"])
    assert got == _brute_knn(rows, 5, metric)


def test_oversample_equalises_with_copies(spark):
    v = FX.embeddings(spark, SF_SMALL).select("vec_id", "label")
    o = RS.oversample_random(v, "vec_id", "label", 42)
    counts = {r["label"]: r["count"] for r in o.groupBy("label").count().collect()}
    assert len(set(counts.values())) == 1
    orig = {(r["vec_id"], r["label"]) for r in v.collect()}
    assert {(r["vec_id"], r["label"]) for r in o.collect()} == orig


def test_smote_points_on_segments(spark):
    v = FX.embeddings(spark, SF_SMALL)
    syn = RS.smote(v, "vec_id", "embedding", "label", k=5, seed=42, block_rows=64).collect()
    vecs = {r["vec_id"]: (r["label"], np.array(r["embedding"], dtype=np.float64)) for r in v.collect()}
    counts = {}
    for lab, _ in vecs.values():
        counts[lab] = counts.get(lab, 0) + 1
    assert len(syn) == sum(max(counts.values()) - c for c in counts.values())
    for r in syn:
        lb, xb = vecs[r["base_id"]]
        ln, xn = vecs[r["nbr_id"]]
        assert lb == ln == r["label"] and r["base_id"] != r["nbr_id"]
        assert np.allclose(np.array(r["embedding"]), xb + r["u"] * (xn - xb))


def test_report_agrees_with_confusion_matrix(spark):
    p = FX.m3_predictions(spark, "/root/testdata/sf0.01")
    cm = {r["actual"]: r for r in EV.confusion_matrix(p, [0, 1, 2]).collect()}
    rep = {r["row"]: r for r in EV.report(EV.pair_counts(p)).collect()}
    for c in (0, 1, 2):
        tp = cm[c][f"pred_{c}"]
        support = sum(cm[c][f"pred_{j}"] for j in (0, 1, 2))
        predicted = sum(cm[a][f"pred_{c}"] for a in cm)
        assert rep[str(c)]["support"] == support
        assert rep[str(c)]["precision"] == pytest.approx(tp / predicted)
        assert rep[str(c)]["recall"] == pytest.approx(tp / support)


def test_threshold_sweep_equals_brute_force(spark):
    s = FX.score_table(spark, "/root/testdata/sf0.01")
    rows = s.select("label", "p").collect()
    curve = {r["i"]: r for r in EV.threshold_sweep(s).collect()}
    ts = EV.thresholds()
    assert len(curve) == 81
    for i, t in enumerate(ts):
        tp = sum(1 for r in rows if r["p"] >= t and r["label"] == 1)
        fp = sum(1 for r in rows if r["p"] >= t and r["label"] == 0)
        assert (curve[i]["tp"], curve[i]["fp"]) == (tp, fp)
    best = [i for i, r in curve.items() if r["is_best"]]
    f1s = [curve[i]["f1"] for i in range(81)]
    assert best == [int(np.argmax(f1s))]


def test_soft_vote_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(
        [(i, i % 2, [float(i % 3), float(i % 5), 1.0]) for i in range(40)], "msg_id long, label int, f array<double>")
    from pyspark.ml.functions import array_to_vector
    df = df.select("msg_id", "label", array_to_vector("f").alias("features"))
    frames = [MD.prediction_frame(MD.estimator(n, n_rows=40).fit(df), df) for n in ("nb", "logreg", "forest")]
    out = MD.vote_frames(frames).collect()
    assert len(out) == 40 and all(abs(sum(r["proba"]) - 1.0) < 1e-9 for r in out)
    singles = [{r["msg_id"]: r["proba"] for r in f.collect()} for f in frames]
    for r in out:
        assert r["proba"] == pytest.approx([sum(s[r["msg_id"]][c] for s in singles) / 3 for c in (0, 1)])
        assert r["pred"] == int(r["proba"][1] > r["proba"][0])


BUILTIN_ONLY = ["message_features", "clean_email_table", "tfidf", "ngrams", "split_stratified",
                "threshold_sweep", "classification_report", "score_chunks_any", "texts_to_sequences"]


@pytest.mark.parametrize("key", BUILTIN_ONLY)
def test_builtin_keys_have_no_python_in_plan(spark, key):
    import __spark_entry__ as E
    plan = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_prunes_columns(spark):
    import __spark_entry__ as E
    plan = E.queries()["message_features"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan or "struct<doc_id:bigint,text:string>" in plan
