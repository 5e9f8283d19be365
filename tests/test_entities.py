"""Names of any number of words: longest match from the left, against a scan in plain Python."""

import random
import re

from pyspark.sql import functions as F

from lurescan.operators import entities


def brute(text, names):
    """{kind: count}; ``names`` maps word tuples to kinds."""
    words, out, i = re.findall(r"[^\W_]+|#", text.lower()), {}, 0
    while i < len(words):
        n = max((k for k in range(1, len(words) - i + 1) if tuple(words[i:i + k]) in names), default=0)
        if n:
            kind = names[tuple(words[i:i + n])]
            out[kind] = out.get(kind, 0) + 1
        i += n or 1
    return out


def counted(spark, texts, names):
    gaz = spark.createDataFrame([(" ".join(w), k) for w, k in names.items()], "name string, kind string")
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id int, text string")
    rows = entities.entity_counts(df, gaz, kinds=("PERSON", "ORG", "GPE")).collect()
    assert len(rows) == len(texts)
    return {r.msg_id: {k: r[k] for k in ("PERSON", "ORG", "GPE") if r[k]} for r in rows}


def test_long_names(spark):
    names = {("bank", "of", "america"): "ORG", ("america",): "GPE", ("bank",): "ORG", ("united", "states", "of", "america"): "GPE",
             ("john", "van", "der", "berg"): "PERSON", ("john",): "PERSON"}
    texts = ["The Bank of America", "bank of the america", "United States of America, United States", "John van der Berg and John van",
             "", None, "bank of", "the bank-of/america!"]
    want = [{"ORG": 1}, {"ORG": 1, "GPE": 1}, {"GPE": 1}, {"PERSON": 2}, {}, {}, {"ORG": 1}, {"ORG": 1}]
    got = counted(spark, texts, names)
    assert [got[i] for i in range(len(texts))] == want == [brute(t or "", names) for t in texts]


def test_random_names_and_texts(spark):
    rng = random.Random(3)
    words = ["aa", "bb", "cc", "dd"]
    names = {tuple(rng.choice(words) for _ in range(rng.randrange(1, 6))): rng.choice(["PERSON", "ORG", "GPE"]) for _ in range(14)}
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(60)]
    got = counted(spark, texts, names)
    assert [got[i] for i in range(60)] == [brute(t, names) for t in texts]


def test_trie_of_equal_names_and_no_names(spark):
    gaz = spark.createDataFrame([("New York", "GPE"), ("new york", "ORG"), ("!!", "ORG"), ("new", "PERSON")], "name string, kind string")
    rows = {(r.prefix, r.words, r.kind) for r in entities.name_trie(gaz).collect()}
    assert rows == {("new", 1, "PERSON"), ("new york", 2, "ORG")}
    df = spark.createDataFrame([(1, "new york")], "msg_id int, text string")
    assert entities.entity_counts(df, gaz.limit(0), kinds=("PERSON", "ORG")).select("PERSON", "ORG").first() == (0, 0)
    assert entities.entity_counts(df.limit(0), gaz).count() == 0
    assert entities.name_matches(df.select("msg_id", F.split("text", " ").alias("_tok")), gaz, "msg_id").collect()[0]["words"] == 2
