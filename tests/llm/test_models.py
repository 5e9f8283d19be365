import zlib

import numpy as np
import public_tokenizers as P
import pytest
from llm_data import ODD, read
from pyspark.sql import functions as F

from lurescan.llm import byte_cnn, pseudonyms, token_counts

JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def count(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return token_counts.count_slice(token_counts.machine(JSON), offsets, np.frombuffer(b"".join(raw), np.uint8)).tolist()


def test_token_counts(documents, rows, odd, empty, lib):
    for df, own in ((documents, rows), (odd, ODD)):
        got = {r.doc_id: r for r in token_counts.counts(df, JSON).collect()}
        for i, t in own:
            n = len(lib.encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert token_counts.counts(empty, JSON).count() == 0


def test_token_counts_of_random_texts(lib):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("  \n\tab'srevlé1.,!  漢") for _ in range(rng.randrange(1200))) for _ in range(400)]
    texts += ["a  <|endoftext|>", "<|endoftext|><|endoftext|> b", "<|endof", "'re'r 'll 'lx'v've", "x" * 2000, " " * 900]
    assert count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_after_starting_over(monkeypatch, lib):
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 10)
    for text in ("one two three", "vier fünf", "one two three"):
        assert count([text]) == [len(lib.encode(text, add_special_tokens=False).ids)]


def test_scores_of_slices_equal_single_texts():
    w = byte_cnn.Weights(1)
    w.out = np.random.default_rng(0).normal(0, 1, 2 * byte_cnn.FILTERS).astype(np.float32)
    rng = np.random.default_rng(2)
    raw = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 3, 6, 255, 256, 257, 261, 262, 511, 512, 517, 5000, 70_000)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = byte_cnn.score_slice(w, offsets, np.concatenate(raw))
    want = [float(byte_cnn.probability(w, byte_cnn.pooled(w, r))) for r in raw]
    assert np.allclose(got, want, atol=1e-6)


def test_gradient():
    w = byte_cnn.Weights(3)
    w.out = np.random.default_rng(0).normal(0, 1, 2 * byte_cnn.FILTERS).astype(np.float32)
    data = np.random.default_rng(1).integers(0, 256, 1500).astype(np.uint8)
    grads = {k: np.zeros_like(getattr(w, k), np.float64) for k in byte_cnn.Weights.NAMES}
    byte_cnn.backward(w, data, w.out, grads)
    f = lambda: float(byte_cnn.pooled(w, data).astype(np.float64) @ w.out)
    for name, at in (("bias", (2,)), ("filters", (5, 3)), ("embed", (int(data[700]), 1))):
        x, h = getattr(w, name), 1e-3
        x[at] += h
        up = f()
        x[at] -= 2 * h
        down = f()
        x[at] += h
        assert abs((up - down) / (2 * h) - grads[name][at]) < 0.05 * max(1, abs(grads[name][at]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = read(spark, sf).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    w = byte_cnn.fit(docs, labels, max_train=800)
    got = byte_cnn.scores(docs, w).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [r.predicted == r.quality for r in got]
    assert sum(right) / len(right) > 0.95
    assert sum(x for x, r in zip(right, got) if r.quality == 0) / sum(r.quality == 0 for r in got) > 0.9


def test_scores_odd(spark, odd, empty):
    w = byte_cnn.Weights(1)
    got = byte_cnn.scores(odd, w).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert byte_cnn.scores(empty, w).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert byte_cnn.fit(odd, none).out_bias[0] == 0
    one = spark.createDataFrame([*((i, 1) for i in range(4, 16)), (3, None), (None, 0)], "doc_id long, quality int")
    assert byte_cnn.fit(odd, one).out_bias[0] > 0


PRIVATE = [
    (1, "mail a.b7@x.example.com, card 9807915762804490 x +1 (017) 555-7713 ip 97.51.17.173 on 2021-02-28 or 28/02/2021."),
    (2, None), (3, ""), (4, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" DE89370400440532013000 123-45-6789'),
    (7, "call (415) 555-2671 or 415-555-2671, amex 3782 822463 10005"),
    (5, "again 97.51.17.173 9807915762804490 2021-02-28 4111 1111 1111 1111 A.B@c.org"),
    (6, "not: 300.1.2.3 2021-02-30 31/02/2020 version 3.0 DE00370400440532013000 in 1999, 000-12-3456, " + "y" * 50_000),
]


def test_pseudonyms(spark):
    import re

    df = spark.createDataFrame(PRIVATE, "doc_id long, text string")
    out = pseudonyms.pseudonymise(df).cache()
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].kinds == ["email", "card", "phone", "address", "date", "dmy"]
    assert got[4].kinds == ["secret", "iban", "ssn"] and got[5].kinds == ["address", "card", "date", "card", "email"]
    assert got[7].kinds == ["local_phone", "local_phone", "card"]
    assert re.findall(r"\d", got[7].text)[:10] == re.findall(r"\d", got[7].text)[10:20]
    assert got[2].text is None and got[3].text == "" and got[6].text == PRIVATE[6][1] and got[6].kinds == []
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
    for i, t in (PRIVATE[0], PRIVATE[4], PRIVATE[5]):
        own = re.sub(r"\d+\.\d+\.\d+\.\d+", "", got[i].text)
        assert shape(own) == shape(re.sub(r"\d+\.\d+\.\d+\.\d+", "", t)) and own != t
    assert len(got[4].text) == len(PRIVATE[3][1])
    # equal values stay linked, and the key holder gets the texts back
    for pattern in (r"\d+\.\d+\.\d+\.\d+", r"\b\d{16}\b", r"\d{4}-\d\d-\d\d"):
        assert re.search(pattern, got[1].text)[0] == re.search(pattern, got[5].text)[0]
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(out.drop("kinds"), inverse=True).collect()}
    assert back == dict(PRIVATE)
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(df, key="another").collect()}
    assert other[1] != got[1].text


FORMS = [
    (1, "NL91 ABNA 0417 1643 00, FR14 2004 1010 0505 0001 3M02 606 and GB29NWBK60161331926819.", ["iban"] * 3),
    (2, "ES91 2100 0418 4502 0005 1332 2024", ["iban"]), (3, "DE00 3704 0044 0532 0130 00", ["card"]),
    (4, "AT12 4111 1111 1111 1111", ["card"]), (5, "12/31/2020 3/2/2021 3/25/2021", ["mdy", "dmy", "mdy"]),
    (6, "2021/02/03 2021.2.3, 2021-2-13T", ["date", "date"]), (7, "31.12.2020. 1-9-1999 at 2020-02-29T10:00", ["dmy", "dmy", "date"]),
    (8, "NL92 ABNA 0417 1643 00 31/31/2020 1.2.2020.4 13/13/2020 2021-13-01", []),
]


def test_other_forms_of_private_values(spark):
    import re

    df = spark.createDataFrame([f[:2] for f in FORMS], "doc_id long, text string")
    out = pseudonyms.pseudonymise(df).cache()
    got = {r.doc_id: r for r in out.collect()}
    for i, t, kinds in FORMS:
        assert got[i].kinds == kinds
        assert (got[i].text == t) == (not kinds)
        assert re.sub("[0-9]", "0", re.sub("[A-Z]", "A", got[i].text)) == re.sub("[0-9]", "0", re.sub("[A-Z]", "A", t))
    for v in re.findall("[A-Z]{2}[0-9]{2}[A-Z0-9 ]{14,}", got[1].text):
        v = v.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    assert got[2].text.endswith(" 2024")
    back = pseudonyms.pseudonymise(out.drop("kinds"), inverse=True).collect()
    assert {r.doc_id: r.text for r in back} == {i: t for i, t, _ in FORMS}


def test_only_valid_cards_are_cards(spark):
    text = "4111111111111111 9807915762804490 9780306406157 AT12 4111 1111 1111 1112"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = pseudonyms.pseudonymise(df, other_numbers="number").cache()
    got = out.first()
    assert got.kinds == ["card", "number", "number", "number"]
    assert not set(got.text.split()[:3]) & set(text.split())
    back = pseudonyms.pseudonymise(out.drop("kinds"), inverse=True, other_numbers="number").first()
    assert back.text == text and back.kinds == got.kinds
    only = pseudonyms.pseudonymise(df, other_numbers=None).first()
    assert only.kinds == ["card"] and only.text.split()[0] == got.text.split()[0] and only.text.split()[1:] == text.split()[1:]


def test_dates_of_every_form_come_back(spark):
    days = spark.sql("SELECT explode(sequence(date'2019-12-01', date'2020-02-10')) AS d")
    forms = ["d/M/yyyy", "dd/M/yyyy", "M/d/yyyy", "MM/dd/yyyy", "yyyy.M.d", "dd-MM-yyyy"]
    df = days.select(F.explode(F.array(*[F.date_format("d", f) for f in forms])).alias("text")).distinct()
    df = df.select(F.xxhash64("text").alias("doc_id"), "text").cache()
    out = pseudonyms.pseudonymise(df).cache()
    assert out.where("size(kinds) != 1").count() == 0 and out.select("text").distinct().count() == df.count()
    back = pseudonyms.pseudonymise(out.drop("kinds"), inverse=True).withColumnRenamed("text", "b")
    assert back.join(df, "doc_id").where("b = text").count() == df.count()


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    out = df.select("t", pseudonyms.feistel(F.col("t"), "k", F.lit("x")).alias("v")).cache()
    assert {r.v for r in out.collect()} == {f"{i:03d}" for i in range(1000)}
    back = out.select("t", pseudonyms.feistel(F.col("v"), "k", F.lit("x"), inverse=True).alias("b"))
    assert back.where("t != b").count() == 0


def test_pseudonyms_odd(odd, empty):
    out = pseudonyms.cleaned(odd)
    assert out.columns == odd.columns
    assert {r.doc_id: r.text for r in out.collect()} == dict(ODD)
    assert pseudonyms.pseudonymise(empty).count() == 0


def test_no_private_value_is_left(spark):
    import re

    docs = read(spark, "/root/testdata/sf0.01")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.text for r in pseudonyms.query(spark, "/root/testdata/sf0.01").collect()}
    seen = 0
    for i, t in texts.items():
        values = re.findall(r"\+1 \(\d{3}\) 555-\d{4}|\b\d{16}\b|[\w.]+@mail\d\.example\.com|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", t)
        seen += len(values)
        assert not [v for v in values if v in got[i]]
        if not re.search("[0-9@]", t):
            assert got[i] == t
    assert seen > 50
