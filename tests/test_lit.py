"""Edge-case rows (FIXTURES.md section 4): expected values derived by hand from the cited behaviour."""

import pytest
from pyspark.sql import functions as F

from lurescan.functions import labels as L
from lurescan.functions import text as T
from lurescan.operators import evaluate as EV
from lurescan.operators import scoring as SC
from lurescan.operators import textops as X
from lurescan.operators import vectorize as V


def one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_html(spark):
    assert one(spark, ["<p>a</p><p>b</p>", "x &lt; y", "  <b>a</b>\n\n b  "], T.clean_html) == ["ab", "x &lt; y", "a b"]


def test_extract_email(spark):
    assert one(spark, ["Bob <b@x.org>, c@y.com", None, "none"], T.extract_email) == ["b@x.org", None, None]


def test_clean_date(spark):
    got = one(spark, ["Tue, 05 Aug 2008 23:31:02 -0700", "junk", None, "2008-08-05", "August 5, 2008",
                      "08/05/2008"], T.clean_date)
    assert got == ["05/08/2008", None, None, "05/08/2008", "05/08/2008", "05/08/2008"]


def test_clean_subject(spark):
    assert one(spark, ["éé", "éa", "", None], T.clean_subject) == [None, "éa", "", None]


def test_clean_body(spark):
    assert one(spark, ["a\tb", "a  b\n", "", "éé", None], T.clean_body) == ["a\tb", "a b", None, "", None]


def test_clean_sms(spark):
    assert one(spark, ["&lt;a&gt; &amp;", "a\n b", None], T.clean_sms) == ["<a> &amp;", "a b", None]


def test_strip_urls_and_has_url(spark):
    assert one(spark, ["wwwx y"], T.strip_urls) == [" y"]
    assert one(spark, ["wwwx y", "see www.x.org", "http://a"], T.has_url) == [0, 1, 1]


def test_has_phone(spark):
    vals = ["1234567890", "12345678901", "(123) 456-7890", "(123)456-7890", "x1234567890"]
    assert one(spark, vals, T.has_phone) == [1, 0, 1, 1, 0]


def test_has_email(spark):
    assert one(spark, ["a@b", "a @b", "x a@ b", "@", "see me@here now"], T.has_email) == [1, 0, 0, 0, 1]


def test_counts_follow_python(spark):
    vals = ["Hello World! Ⅷ ", "a b c", "", "1²3 !?"]
    assert one(spark, vals, T.num_words) == [len(v.split()) for v in vals]
    assert one(spark, vals, T.num_uppercase) == [sum(c.isupper() for c in v) for v in vals]
    assert one(spark, vals, T.num_special_chars) == [sum(not c.isalnum() and not c.isspace() for c in v)
                                                     for v in vals]
    assert one(spark, vals, T.num_exclamations) == [v.count("!") for v in vals]


def test_avg_word_length(spark):
    assert one(spark, ["ab cde", ""], T.avg_word_length) == [2.5, 0.0]


def test_label_three(spark):
    assert one(spark, ["Smishing", "SPAM", "ham", "other", "", None], L.map_labels_three) == [2, 1, 0, None, None, None]


def test_label_equality_case_sensitive(spark):
    assert one(spark, ["Smishing", "smishing", None], L.map_labels_equality_cs) == [1, 0, 0]


def test_label_binary_and_equality(spark):
    assert one(spark, ["Safe Email", "Phishing Email", "x", None], L.map_labels_binary) == [0, 1, None, None]
    assert one(spark, ["Safe Email", "Phishing Email", "x", None], L.map_labels_equality) == [0, 1, 0, 0]


def test_pad_sequences(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4, 5]), (1, [7]), (2, [])], "i int, s array<bigint>")

    def pad(p, t):
        return [r[0] for r in df.orderBy("i").select(V.pad_sequences("s", 3, p, t)).collect()]

    assert pad("pre", "pre") == [[3, 4, 5], [0, 0, 7], [0, 0, 0]]
    assert pad("post", "post") == [[1, 2, 3], [7, 0, 0], [0, 0, 0]]
    assert pad("post", "pre") == [[3, 4, 5], [7, 0, 0], [0, 0, 0]]


def test_augment_text(spark):
    df = spark.createDataFrame([(1, "", 0), (2, "cats like dogs", 1)], "msg_id long, text string, label int")
    out = X.augment_text(df, "msg_id", "text", n=2, keep=["label"]).collect()
    assert len(out) == 2
    assert {r["msg_id"] for r in out} == {2} and {r["label"] for r in out} == {1}
    for r in out:
        words = r["text"].split()
        assert len(words) == 3
        # every word is either kept or lemmatised (cats -> cat, dogs -> dog)
        assert words[0] in ("cats", "cat") and words[2] in ("dogs", "dog") and words[1] == "like"


def test_filter_max_length(spark):
    df = spark.createDataFrame([(1, "a" * 10000), (2, "a" * 10001)], "doc_id long, text string")
    kept = [r[0] for r in df.where(F.length("text") <= 10000).select("doc_id").collect()]
    assert kept == [1]


def test_score_chunks_any(spark):
    # class per chunk from a scorer that reads a marker word: (0, 0) -> 0, (0, 2) -> 1, no chunks -> 0
    def scorer(chunk):
        return F.when(chunk.contains("TWO"), 2).otherwise(0)

    body0 = " ".join(["w"] * 600)
    body1 = " ".join(["w"] * 600 + ["TWO"])
    df = spark.createDataFrame([(0, body0), (1, body1), (2, "")], "id long, text string")
    out = {r["id"]: (r["prediction"], r["n_chunks"]) for r in SC.score_chunks_any(df, "id", "text", scorer).collect()}
    assert out == {0: (0, 2), 1: (1, 2), 2: (0, 0)}


def test_thresholds_at_half(spark):
    df = spark.createDataFrame([(0.5,)], "p double")
    r = df.select((F.col("p") >= 0.5).cast("int"), (F.col("p") > 0.5).cast("int"),
                  F.bround("p", 0).cast("int")).first()
    assert tuple(r) == (1, 0, 0)


def test_prf_no_predicted_positive(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, pred int")
    r = EV.prf_for(EV.pair_counts(df), 1).first()
    assert r["precision"] == 0.0 and r["f1"] == 0.0 and r["recall"] == 0.0 and r["support"] == 1


def test_lemma_rules(spark):
    vals = ["classes", "boxes", "churches", "ponies", "cats", "bus", "this", "children", "gas"]
    got = one(spark, vals, X.lemma_word)
    assert got == ["class", "box", "church", "pony", "cat", "bus", "this", "child", "gas"]


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"),
    ("hissing", "hiss"), ("happy", "happi"), ("sky", "sky"), ("generalizations", "gener"),
    ("oscillators", "oscil"),
])
def test_porter(word, stem):
    from porter_plain import stem as porter
    assert porter(word) == stem
