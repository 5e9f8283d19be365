import brute
import pytest
from llm_data import ODD
from pyspark.sql import functions as F

from lurescan.llm import common, components, exact_dedup, minhash


def test_exact_matches_brute_force(documents, rows):
    want = brute.exact(rows)
    got = exact_dedup.classes(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.digest) == want[r.id]
        assert r.kept == (r.id == r.keep_id)


def test_exact_odd_texts_and_weak_digest(odd):
    want = brute.exact(ODD)
    for digest in (exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)):
        got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(odd, digest=digest).collect()}
        assert got == {i: (k, n, i == k) for i, (k, n, _) in want.items()}


def test_exact_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "a"), (5, "b"), (None, "c"), (None, "c")],
                               "doc_id long, text string")
    got = exact_dedup.classes(df).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 3
    assert {(r.digest, r.keep_id, r.group_size) for r in got if r.keep_id == 3} == {(got_digest("a"), 3, 4)}
    kept = sorted(exact_dedup.keep(df).collect(), key=lambda r: r.text)
    assert [(r.doc_id, r.text) for r in kept] == [(3, "a"), (5, "b"), (None, "c")]


def got_digest(t):
    import hashlib

    return hashlib.sha256(t.encode()).hexdigest()


def test_exact_keep_returns_all_columns(odd, empty):
    kept = exact_dedup.keep(odd)
    assert kept.columns == odd.columns
    want = {i for i, (k, _, _) in brute.exact(ODD).items() if i == k}
    assert {r.doc_id for r in kept.collect()} == want
    assert exact_dedup.keep(empty).count() == 0 and exact_dedup.classes(empty).count() == 0


def test_exact_state_survives_between_runs(spark, documents):
    """A second stream run under the same checkpoint meets rows of the first."""
    from lurescan.session import scratch_dir

    folder, checkpoint = scratch_dir(spark, "two-runs"), scratch_dir(spark, "two-runs-state")
    a = exact_dedup.fingerprints(documents.where("doc_id >= 100"), "doc_id", "text")
    b = exact_dedup.fingerprints(documents.where("doc_id < 100"), "doc_id", "text")
    a.write.parquet(folder)
    exact_dedup.run_stream(spark, folder, a.schema, checkpoint, max_files=1)
    b.write.mode("append").parquet(folder)
    exact_dedup.run_stream(spark, folder, a.schema, checkpoint, max_files=2)
    got = {r.digest: (r["first"].id, r.n) for r in exact_dedup.read_state(spark, checkpoint).collect()}
    want = {}
    for i, (k, n, d) in brute.exact([(r.doc_id, r.text) for r in documents.collect()]).items():
        want[d] = (k, n)
    assert got == want


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash_matches_brute_force(documents, rows, percent):
    want = brute.near(rows, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components(documents, percent=percent).collect()}
    assert got == want


def test_minhash_odd(odd, empty, spark):
    want = brute.near(ODD)
    got = minhash.components(odd).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.keep(odd).columns == odd.columns
    assert {r.doc_id for r in minhash.keep(odd).collect()} == {i for i, (_, c) in want.items() if i == c}
    assert minhash.components(empty).count() == 0
    twice = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = sorted([(r.doc_id or 0, r.component_id, r.kept) for r in minhash.components(twice).collect()])
    assert got == [(0, None, True), (1, 1, True), (1, 1, True)]


@pytest.mark.parametrize("cluster", [8192, 3])
def test_minhash_loses_no_link_when_hubs_fail(spark, monkeypatch, cluster):
    """Families whose smallest member is linked to few others: stars alone would miss links."""
    import random

    monkeypatch.setattr(minhash, "CLUSTER", cluster)  # over it: rounds of joins
    rng = random.Random(5)
    rows = []
    for fam in range(12):
        base = [f"w{fam}x{k}" for k in range(160)]
        for j in range(25):
            own = base[:]
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(160)] = f"n{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components(df).collect()}
    assert got == brute.near(rows)


def test_join_cluster_equals_brute_force():
    import random

    import numpy as np

    rng = random.Random(8)
    for n in (1, 2, 30):
        base = list(range(100))
        sets = []
        for _ in range(n):
            own = base[:]
            for _ in range(rng.randrange(0, 14)):
                own[rng.randrange(100)] = rng.randrange(1000, 10**6)
            sets.append(set(own))
        ids = rng.sample(range(1000), n)
        got = minhash.join_cluster(ids, [np.array(sorted(s), np.uint64) for s in sets], 85)
        root = list(range(n))
        for _ in range(n):
            for a in range(n):
                for b in range(n):
                    if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        least = {}
        for r, i in zip(root, ids):
            least[r] = min(i, least.get(r, i))
        assert got == [least[r] for r in root]


def test_densify_fills_every_bin():
    import numpy as np

    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 40, (50, minhash.BINS)).astype(np.uint64)
    empty = rng.random((50, minhash.BINS)) < np.linspace(0, 0.999, 50)[:, None]
    empty[-1] = True
    empty[-2] = True
    empty[-2, 17] = False
    out = minhash.densify(sig, empty)
    assert (out[~empty] == sig[~empty]).all()
    for r in range(49):
        assert np.isin(out[r], sig[r][~empty[r]]).all()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 299)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components.connected(df).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}
    assert got == want
    assert components.connected(df.limit(0)).count() == 0


def test_materialise_keeps_schema_of_empty(spark):
    df = spark.range(0).withColumn("x", F.lit("a"))
    assert common.materialise(df, "t").schema.names == ["id", "x"]


def test_large_clusters_meet_by_signatures(monkeypatch):
    """Sets that signatures tell apart are not compared in full; the components stay those of all pairs."""
    import numpy as np

    rng = np.random.default_rng(4)
    root, sets = rng.integers(0, 2**63, 300).astype(np.uint64), []
    for share in (0.3, 0.4, 0.5):
        base = root.copy()
        away = rng.random(300) < share
        base[away] = rng.integers(0, 2**63, away.sum())
        for size in (300, 30):
            for _ in range(40):
                x = base[:size].copy()
                away = rng.random(size) < rng.choice([0.0, 0.03, 0.08])
                x[away] = rng.integers(0, 2**63, away.sum())
                sets.append(np.unique(x))
    order = rng.permutation(len(sets))
    sets, ids = [sets[i] for i in order], [int(i) + 7 for i in order]
    monkeypatch.setattr(minhash, "PAIRS", len(sets))
    want = minhash.join_cluster(ids, sets, 85)
    monkeypatch.setattr(minhash, "PAIRS", 64)
    seen, real = [], np.add.reduceat
    monkeypatch.setattr(minhash.np, "add", type("Add", (), {"reduceat": staticmethod(lambda x, at: seen.append(len(x)) or real(x, at)),
                                                            "at": staticmethod(np.add.at)}))
    assert minhash.join_cluster(ids, sets, 85) == want and len(set(want)) > 6
    assert sum(seen) < sum(map(len, sets)) * len(sets) / 8
