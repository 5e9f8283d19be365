"""Word dictionaries: stems against plain Python, lemmas by hand, both ways back into the texts."""

import itertools
import random

import porter_plain
import pytest
from pyspark.sql import functions as F

from lurescan.functions.lexicon import PORTER_IRREGULAR, PORTER_STEP2, PORTER_STEP3, PORTER_STEP4
from lurescan.operators import dictionary as D
from lurescan.operators import textops as X

# words and stems as the extended mode is documented to give them
KNOWN = {"dies": "die", "died": "die", "flies": "fli", "spied": "spi", "cried": "cri", "skies": "sky", "lying": "lie",
         "news": "news", "enjoy": "enjoy", "say": "say", "by": "by", "cry": "cri", "apology": "apolog", "geology": "geolog",
         "possibly": "possibl", "usefully": "use", "agreed": "agre", "owed": "owe", "using": "use", "succeed": "succeed",
         "caresses": "caress", "hopping": "hop", "falling": "fall", "hoping": "hope", "conditional": "condit",
         "relational": "relat", "triplicate": "triplic", "adjustment": "adjust", "controlling": "control", "y": "y"}


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "word string")
    return {r.word: r.stem for r in D.with_stems(df).collect()}


def test_known_stems(spark):
    assert stems(spark, KNOWN) == KNOWN
    assert {w: porter_plain.stem(w) for w in KNOWN} == KNOWN


def test_stems_equal_plain_python(spark):
    rng = random.Random(7)
    roots = ["".join(rng.choice("aeiouybcdlnrstwxz") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    ends = [s for s, _ in PORTER_STEP2 + PORTER_STEP3] + list(PORTER_STEP4) + ["s", "es", "ies", "ied", "ed", "eed", "ing",
                                                                              "logi", "logy", "ion", "e", "ll", "y", "ally", ""]
    words = {r + a for r, a in itertools.product(roots, ends)} | {r + rng.choice(ends) + b for r in roots for b in ends}
    words |= set(PORTER_IRREGULAR)
    got = stems(spark, sorted(words))
    assert got == {w: porter_plain.stem(w) for w in words}


def test_lemmas_need_the_lexicon(spark):
    words = ["classes", "class", "clas", "boxes", "wolves", "women", "geese", "ponies", "gas", "gases", "s", "xyzs"]
    lex = spark.createDataFrame([(w,) for w in ["class", "box", "boxe", "wolf", "woman", "pony", "gas", "ga", "s", "pony"]], "word string")
    got = {r.word: r.lemma for r in D.with_lemmas(spark.createDataFrame([(w,) for w in words], "word string"), lex).collect()}
    # two candidates: the shortest; none: the word; an exception needs no lexicon; a bare suffix is not cut
    assert got == {"classes": "class", "class": "class", "clas": "clas", "boxes": "box", "wolves": "wolf", "women": "woman",
                   "geese": "goose", "ponies": "pony", "gas": "ga", "gases": "gas", "s": "s", "xyzs": "xyzs"}
    empty = lex.where("false")
    assert all(r.word == r.lemma for r in D.with_lemmas(lex.distinct(), empty).collect())


TEXTS = [(1, "flies and flies"), (2, ""), (3, None), (4, "  "), (5, "dogs chased dogs unknownword"), (6, "a " * 3000 + "flies")]


@pytest.mark.parametrize("rows", [None, "1"])
def test_words_come_back_in_order(spark, rows):
    """Broadcast and, with the limit lowered to a row, through shuffles."""
    docs = spark.createDataFrame(TEXTS, "id int, text string")
    voc = D.vocabulary(docs, X.tokenize_ws("text"))
    forms = D.with_stems(voc).where("word <> 'unknownword'").withColumnRenamed("stem", "form")
    if rows:
        spark.conf.set("lurescan.broadcast.maxRows", rows)
    try:
        out = D.map_words(docs, "id", "text", X.tokenize_ws("_text"), forms)
        got = {r.id: r.text for r in out.collect()}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("lurescan.broadcast.maxRows")
    assert ("broadcast" in plan) == (rows is None)
    want = {i: t and " ".join(w if w == "unknownword" else porter_plain.stem(w) for w in t.split()) for i, t in TEXTS}
    assert got == {i: None if t is None else t or "" for i, t in want.items()}


def test_plan_has_no_python_and_one_shuffle_of_texts(spark):
    docs = spark.createDataFrame(TEXTS, "id int, text string")
    forms = D.with_stems(D.vocabulary(docs, X.tokenize_ws("text"))).withColumnRenamed("stem", "form")
    out = D.map_words(docs, "id", "text", X.tokenize_ws("_text"), forms)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    upper = plan.split("InMemoryTableScan")[0]
    assert upper.count("Exchange hashpartitioning") == 1, plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "id int, text string")
    forms = D.with_stems(D.vocabulary(docs, X.tokenize_ws("text"))).select("word", F.col("stem").alias("form"))
    assert D.map_words(docs, "id", "text", X.tokenize_ws("_text"), forms).count() == 0
