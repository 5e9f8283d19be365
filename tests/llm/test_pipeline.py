import base64

import brute
import corpus_pipeline
import duckdb
import pandas as pd
import public_tokenizers as P
from llm_data import ODD, SF, read

from lurescan.llm import common, mixing

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def expected(rows):
    """rows (doc_id, text, lang, source) -> sorted (doc_id, ids) of the last stage, in plain Python and SQL."""
    import tiktoken

    rows = [r for r, good in zip(rows, brute.verdicts([(r[1], r[3]) for r in rows])) if good]
    first = brute.exact([r[:2] for r in rows])
    rows = [r for r in rows if first[r[0]][0] == r[0]]
    near = brute.near([r[:2] for r in rows], corpus_pipeline.NEAR_PERCENT)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=NAMES[:4]))
    drawn = [r[0] for r in con.execute(mixing.SQL).fetchall()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {r[0]: enc.encode_ordinary(r[1]) for r in rows}
    return sorted((i, ids[i]) for i in drawn)


def test_run_equals_brute_force(spark):
    rows = [tuple(r)[:4] for r in read(spark).select(*NAMES).collect()]
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == expected(rows)


def test_rejected_host_leaves_the_pipeline(spark, tmp_path):
    def text(i):
        return " ".join(f"w{i}x{k}" for k in range(30))

    rows = [(i, text(i), "en", f"h{i % 10}") for i in range(100)]
    rows += [(200 + i, text(200 + i) + " # # # # #" * (i > 5), "en", "spam") for i in range(60)]
    good = brute.verdicts([(r[1], r[3]) for r in rows])
    assert {r[3] for r, v in zip(rows, good) if not v} == {"spam"} and sum(good) == 100
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == expected(rows) != []
    assert not {i for i, _ in got} & {r[0] for r in rows if r[3] == "spam"}


def test_stages_hand_on_all_columns(spark, documents):
    docs = documents.withColumnRenamed("n_chars", "kept").selectExpr("*", "doc_id AS id", "'x' AS _row")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = common.materialise(stage(spark, docs, SF), f"test-{i}")
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count() or name == "mixing"
        assert out.dtypes == docs.dtypes
        docs = out


def test_odd_and_empty_tables(spark, odd, empty):
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, SF)
        assert {r.doc_id for r in out.collect()} <= {r[0] for r in ODD}, name
        assert stage(spark, empty, SF).count() == 0, name


def test_names_of_entry():
    import __spark_entry__ as E

    names = list(E.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(E.oracle_sql()) <= set(names)


def test_unused_memory_is_given_back_after_each_batch(monkeypatch):
    given = []

    class Pool:
        def release_unused(self):
            given.append(len(taken))

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    taken = []
    for batch in common.released(iter("abc")):
        taken.append(batch)
    assert taken == ["a", "b", "c"] and given == [1, 2, 3]
