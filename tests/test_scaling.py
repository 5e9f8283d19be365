"""Work that must not grow with the number of partitions, passes or lookups."""

import random

import numpy as np
from paths import SF_SMALL
from pyspark.sql import functions as F

from lurescan.operators import dictionary as D
from lurescan.operators import entities, svd
from lurescan.operators import vectorize as V


def tasks_of(spark, name, run):
    """(result of ``run``, tasks of each stage that its jobs started)."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return out, [i.numTasks for i in map(tracker.getStageInfo, stages) if i]


def test_svd_sums_a_matrix_a_core(spark):
    x = np.random.default_rng(1).normal(size=(60, 5))
    rows = spark.createDataFrame([(i, list(range(5)), [float(v) for v in r]) for i, r in enumerate(x)],
                                 "id long, js array<int>, ws array<double>").repartition(40).cache()
    rows.count()
    got, tasks = tasks_of(spark, "svd-tasks", lambda: svd.gram_times(rows, np.eye(5)))
    rows.unpersist()
    assert np.allclose(got, x.T @ x)
    assert tasks and max(tasks) <= max(spark.sparkContext.defaultParallelism, 8), tasks


def test_svd_counts_texts_once_for_vocabulary_and_idf(spark, monkeypatch):
    import __spark_entry__ as E
    calls, stats = [], V.term_stats
    monkeypatch.setattr(V, "term_stats", lambda tc: calls.append(1) or stats(tc))
    E.queries()["truncated_svd"](spark, SF_SMALL)
    assert len(calls) == 1


def test_word_forms_of_any_letters(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeybcé\U0001F600\n") for _ in range(rng.randrange(9))) for _ in range(3000)]

    def plain(word):
        form = ""
        for ch in word:
            form += "v" if ch in "aeiou" or (ch == "y" and form.endswith("c")) else "c"
        return form

    df = spark.createDataFrame([(w,) for w in [*words, None]], "word string").select("word", D.word_form(F.col("word")).alias("form"))
    got = {r.word: r.form for r in df.collect()}
    assert got.pop(None) is None and got == {w: plain(w) for w in words}


def test_word_forms_are_marked_at_once(spark):
    """The letter-by-letter form is a fallback inside a condition, not worked out for every word."""
    df = spark.createDataFrame([("toys",)], "word string")
    plan = df.select(D.word_form(F.col("word")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN") < plan.index("aggregate(")


def test_names_beyond_the_limit_do_not_shuffle_positions(spark):
    """Of many names only those that the texts hold are looked up, so they are broadcast again."""
    names = [(f"name{i}", "PERSON") for i in range(200)] + [("red cross", "ORG"), ("red", "GPE")]
    gaz = spark.createDataFrame(names, "name string, kind string")
    texts = ["name3 met the Red Cross", "a red name7 and name7", "", None, "nobody here"]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id int, text string")
    spark.conf.set("lurescan.broadcast.maxRows", "20")
    try:
        tokens = df.select("msg_id", F.regexp_extract_all(F.lower("text"), F.lit(entities.TOKEN), 0).alias("_tok"))
        found = entities.name_matches(tokens, gaz, "msg_id")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.msg_id, r["at"], r["words"], r.kind) for r in found.collect())
    finally:
        spark.conf.unset("lurescan.broadcast.maxRows")
    assert got == [(0, 1, 1, "PERSON"), (0, 4, 2, "ORG"), (1, 2, 1, "GPE"), (1, 3, 1, "PERSON"), (1, 5, 1, "PERSON")]
    assert plan.count("strategy=broadcast") == 2, plan
