import random

import brute
import numpy as np
import pytest
from llm_data import ODD

from lurescan.llm import substrings
from lurescan.llm.words import prefix_hash


def check(df, rows):
    want = brute.repeats(rows)
    got = substrings.spans(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def made(seed=3, docs=80):
    """Texts with shared passages, passages cut at their edges, periodic parts and near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(20, 90))) for _ in range(6)]
    out = []
    for i in range(docs):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 3)
            parts.append(p[a:len(p) - rng.randrange(0, len(p) // 3)])
            parts.append(" ".join(word() for _ in range(rng.randrange(0, 12))))
        if rng.random() < 0.15:
            parts.append(rng.choice(["ab", "x", "abc "]) * rng.randrange(20, 150))
        if out and rng.random() < 0.2:
            parts = [rng.choice(out)[1]]
        out.append((i, " ".join(parts)))
    return out


def test_documents(documents, rows):
    check(documents, rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_made_up(spark, seed):
    rows = made(seed)
    random.Random(1).shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_hot_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 2)
    rows = made(9, 50)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_small_slices(spark, monkeypatch):
    """Groups that cross batches are put together."""
    rows = made(11, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(df, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_odd(odd, empty, spark):
    check(odd, ODD)
    assert substrings.spans(empty).count() == 0
    long = "q" * 150
    df = spark.createDataFrame([(None, long), (None, long), (1, long), (1, long), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.spans(df).collect())
    assert got == [(0, 150, 0, 0), (0, 150, 0, 0), (1, 150, 149, 1), (1, 150, 149, 1), (2, 0, 0, 0)]


def test_merge_sort_is_a_suffix_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1500] = data[2000:2500]
    at = rng.choice(3900, 700, replace=False)
    group = np.sort(rng.integers(0, 9, 700))
    order = substrings.merge_sort(data, prefix_hash(data), group, at)
    raw = data.tobytes()
    want = sorted(range(700), key=lambda i: (group[i], raw[at[i]:at[i] + substrings.WIDTH]))
    assert [(group[i], raw[at[i]:at[i] + 100]) for i in order] == [(group[i], raw[at[i]:at[i] + 100]) for i in want]


def test_collisions_are_found(monkeypatch, spark):
    """With hashes that collide all the time, results stay right."""
    rows = [(1, 11, 0, 1, 0, b"a" * 100), (1, 12, 0, 1, 0, b"b" * 100), (1, 13, 0, 1, 0, b"a" * 100)]
    monkeypatch.setattr(substrings, "prefix_hash", lambda d: np.zeros(len(d) + 1, np.uint64))
    ids, s, e = substrings.repeated_windows(rows)
    assert ids.tolist() == [13]
