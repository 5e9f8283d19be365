import base64
import hashlib
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from llm_data import ODD, SF

from lurescan.llm import bpe, mixing, quality_rules, token_files

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_rules_match_brute_force(documents, rows):
    want = {i: brute.rules(t) for i, t in rows}
    got = quality_rules.score(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert r.kept == (not r.base_failed and r.host_ok and not r.symbols_failed)
    table = documents.collect()
    verdicts = brute.verdicts([(r.text, r.source) for r in table])
    assert {r.doc_id: r.kept for r in got} == {r.doc_id: v for r, v in zip(table, verdicts)}
    assert any(r.symbols_failed and not r.base_failed for r in got)


def test_symbols_are_read_by_the_host(spark):
    """A host that often fails is read more strictly, a clean one less; ids may be null or repeated."""
    words = " ".join(f"w{i}" for i in range(40))
    noisy = lambda n: words.replace(" ", "# ", n)
    rows = [(h * 100 + i, words + f" {i}", f"h{h}") for h in range(10) for i in range(60)]
    rows += [(2000 + i, noisy(20), "noisy") for i in range(20)] + [(2100 + i, words, "noisy") for i in range(40)]
    rows += [(3000, noisy(3), "noisy"), (3001, noisy(3), "h0"), (3002, noisy(6), "h0"), (3003, noisy(8), "h0"),
             (3004, noisy(9), "h0"), (3005, None, "noisy"), (3005, None, None), (None, words, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.score(df).collect()
    want = sorted(zip([r[0] or -1 for r in rows], brute.verdicts([r[1:] for r in rows])))
    assert sorted((r.doc_id or -1, r.kept) for r in got) == want
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[3000] and kept[3001] and kept[2100]
    assert sorted(r.doc_id or -1 for r in quality_rules.keep(df).collect()) == sorted(i for i, v in want if v)


def test_rules_odd(odd, empty):
    got = {r.doc_id: r for r in quality_rules.score(odd, limit=1.0).collect()}
    for i, t in ODD:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(t)
    kept = quality_rules.keep(odd, limit=1.0)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.score(empty).count() == 0 and quality_rules.keep(empty).count() == 0


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good + f" {i}", f"h{i % 20}") for i in range(400)]
    rows += [(1000 + i, "bad one", "spam") for i in range(60)] + [(1100, good + " fine", "spam")]
    rows += [(2000, "bad one", "tiny"), (2001, good + " tiny", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.score(df).collect()}
    assert not got[1100].kept and not got[1100].base_failed  # the host's verdict
    assert got[2001].kept and not got[2000].kept
    assert all(got[i].kept for i in range(400))
    assert {r.doc_id for r in quality_rules.keep(df).collect()} == {i for i, r in got.items() if r.kept}


def test_bpe_equals_tiktoken(documents, rows, odd, tik):
    for df, own in ((documents, rows), (odd, ODD)):
        got = {r.doc_id: r for r in bpe.encode(df, RANKS, P.PATTERN).collect()}
        for i, t in own:
            ids = tik.encode_ordinary(t or "")
            assert got[i].ids == ids and got[i].n_tokens == len(ids)
            assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_random_strings(tik):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("  \n\tab'srévell1.,!é漢 　") for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["a" * 900, "ab" * 500 + "z", "=" * 700]
    _, words = bpe.coder(RANKS, P.PATTERN)
    ids, at = words.ids(pa.array(texts))
    for t, i, j in zip(texts, at[:-1], at[1:]):
        assert ids[i:j].tolist() == tik.encode_ordinary(t)


def test_bpe_index_starts_over(monkeypatch, tik):
    _, words = bpe.coder(RANKS, P.PATTERN)
    monkeypatch.setattr(words, "max_words", 5)
    for k in range(5):
        text = " ".join(f"w{k}{i}" for i in range(20))
        assert words.ids(pa.array([text]))[0].tolist() == tik.encode_ordinary(text)


def test_bpe_empty(empty):
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def write_and_read(spark, df):
    from lurescan.session import scratch_dir

    folder = scratch_dir(spark, "t7")
    shards, dtype = token_files.write(df, folder, JSON, P.PATTERN)
    return token_files.read_back(shards, folder, dtype).collect(), folder, dtype


def test_token_files(spark, documents, rows, odd, empty, lib):
    for df, own in ((documents, rows), (odd, ODD)):
        got, _, dtype = write_and_read(spark, df)
        assert dtype == "<u2" and len(got) == len(own)
        start = 0
        by = {r.id: r for r in got}
        for i, t in sorted(own):
            ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
            r = by[i]
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert write_and_read(spark, empty)[0] == []


def test_token_files_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b c"), (2, "b c"), (1, None)], "doc_id long, text string")
    got, _, _ = write_and_read(spark, df)
    assert sorted((r.start, r.id, r.n_tokens) for r in got) == [(0, None, 2), (2, 1, 1), (3, 2, 3), (6, 2, 3)]


def test_mixing_equals_sql(spark, documents):
    got = sorted(tuple(r) for r in mixing.query(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert got == sorted(con.execute(mixing.SQL).fetchall())


def test_mixing_odd_budgets(spark, odd, empty):
    total = sum(r[0] for r in mixing.leaf_rows(odd, "doc_id", "text", "lang", "source").select("n_tokens").collect())
    for percent in (0, 7, 100, 350, 900):
        got = mixing.draw(odd, percent=percent).collect()
        assert sum(r.take_tokens for r in got) == min(total * percent // 100, total * mixing.MAX_EPOCHS)
        assert len({(r.id, r.epoch) for r in got}) == len(got)
        assert all(0 < r.take_tokens <= r.n_tokens and r.epoch <= mixing.MAX_EPOCHS for r in got)
    assert mixing.draw(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("prose", "en", "a", 10), ("prose", "en", "b", 1000), ("table", "en", "c", 1000)],
                                   "domain string, lang string, source string, tokens long")
    w = {"domain": {"prose": 50, "table": 50}, "lang": {}, "source": {"a": 50, "b": 50}}
    got = {r.source: r.budget for r in mixing.plan(leaves, w, percent=40, max_epochs=1).collect()}
    assert got == {"a": 10, "b": 392, "c": 402}
    got = {r.source: r.budget for r in mixing.plan(leaves, w | {"domain": {"prose": 90, "table": 10}}, 60, 1).collect()}
    assert got == {"a": 10, "b": 1000, "c": 196}


def test_mixing_draws_rows_with_equal_and_null_ids_by_themselves(spark):
    from lurescan.llm import mixing

    rows = [(7, "one two three", "en", "a"), (7, "four five six", "en", "a"), (None, "x y z", "en", "a"), (None, "u v w", "en", "a"),
            (8, "one two three", "en", "a"), (8, "one two three", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [tuple(r) for r in mixing.mixed(df, percent=100, max_epochs=1).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
