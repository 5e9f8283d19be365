"""Word forms by dictionary: every distinct word of a corpus is worked out once.

``vocabulary`` lists the distinct words, ``with_lemmas`` and ``with_stems`` add
their forms as SQL functions and joins, and ``map_words`` puts the forms back
into the texts by word.  Nothing here runs in Python workers.

Lemmas follow the detachment scheme of WordNet's noun morphology: exceptions
first, else the word itself and every rule's result, of which only those in the
lexicon table count; the shortest wins.  Rules are applied once, not to their
own results.  Stems are Porter's in the extended mode of the scripts' library
(irregular forms, four-letter -ies/-ied, -y after a consonant only, -bli, -fulli,
-logi, short words of two letters).

Cases: a null text gives null and a text without words the empty string; null
words stay out of the vocabulary.  Ids must be unique, as the words of one id
are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.functions.lexicon import (LEMMA_TABLE, NOUN_DETACHMENTS, PORTER_IRREGULAR, PORTER_STEP2, PORTER_STEP3,
                                        PORTER_STEP4)
from lurescan.operators.joins import small_enough
from lurescan.session import scoped_cache

#: Regular expressions over a word's form, a string of c (consonant) and v (vowel).
POSITIVE = "^c*v+c"        # m > 0
OVER_ONE = "^c*v+c+v+c"    # m > 1
ONE = "^c*v+c+v*$"         # m = 1


def vocabulary(docs: DataFrame, tokens: Column) -> DataFrame:
    """(word, docs): the distinct words of all token arrays and the number of documents of each."""
    words = docs.select(F.explode(F.array_distinct(tokens)).alias("word")).where(F.col("word").isNotNull())
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))


# ---------------------------------------------------------------- lemmas

def _cut(word: Column, suffix: str, new: str) -> Column:
    return F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(new))


def default_exceptions(spark) -> DataFrame:
    return spark.createDataFrame(list(LEMMA_TABLE.items()), "word string, lemma string")


def with_lemmas(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``words`` (distinct, in column ``word``) with a column ``lemma``.

    ``lexicon`` holds the words that may be lemmas (column ``word``), ``exceptions``
    irregular forms (word, lemma; default: the small fixed table).  A word that is
    no exception and has no candidate in the lexicon keeps its form.
    """
    if exceptions is None:
        exceptions = default_exceptions(words.sparkSession)
    w = F.col("word")
    rules = [F.when(w.endswith(s) & (F.length(w) > len(s)), _cut(w, s, new)) for s, new in NOUN_DETACHMENTS]
    known = lexicon.select(F.col("word").alias("form")).distinct()
    found = (words.select("word", F.explode(F.array_compact(F.array(w, *rules))).alias("form"))
             .join(known, "form", "left_semi")
             .groupBy("word").agg(F.min(F.struct(F.length("form").alias("n"), "form")).alias("best"))
             .select("word", F.col("best.form").alias("_found")))
    odd = exceptions.groupBy("word").agg(F.min("lemma").alias("_odd"))
    return (words.join(found, "word", "left").join(odd, "word", "left")
            .withColumn("lemma", F.coalesce("_odd", "_found", "word")).drop("_odd", "_found"))


# ---------------------------------------------------------------- stems

def word_form(word: Column) -> Column:
    """c or v for every letter: a, e, i, o and u are vowels, and y is one after a consonant.

    All letters are marked at once, then a y by the mark before it.  Only words in
    which several y follow each other, so that one is left, go letter by letter.
    """
    def add(form, ch):
        vowel = ch.isin(*"aeiou") | ((ch == "y") & form.endswith("c"))
        return F.concat(form, F.when(vowel, F.lit("v")).otherwise(F.lit("c")))
    marks = F.translate(F.regexp_replace(word, "[^aeiouy]", "c"), "aeiou", "vvvvv")
    marks = F.replace(F.replace(F.regexp_replace(marks, "^y", "c"), F.lit("cy"), F.lit("cv")), F.lit("vy"), F.lit("vc"))
    slow = F.aggregate(F.regexp_extract_all(word, F.lit("(?s)."), 0), F.lit(""), add)
    return F.when(marks.contains("y"), slow).otherwise(marks)


def _now() -> Column:
    """The word as the steps so far left it."""
    return F.col("_w")


def _shape() -> Column:
    """Its form."""
    return F.col("_form")


def _stem_form(k: int) -> Column:
    """The form of the word without its last k letters."""
    return F.substring(_shape(), F.lit(1), F.length(_shape()) - k)


def _double() -> Column:
    n = F.length(_now())
    return _shape().endswith("c") & (n > 1) & (F.substring(_now(), -1, 1) == F.substring(_now(), n - 1, F.lit(1)))


def _short(form: Column, word: Column) -> Column:
    """Consonant, vowel, consonant other than w, x or y at the end; or vowel and consonant only."""
    return (form.endswith("cvc") & ~word.rlike("[wxy]$")) | (form == "vc")


def _cases(arms, otherwise: Column) -> Column:
    """The first arm whose condition holds, and within it the new word if its test holds."""
    out = None
    for cond, test, new in arms:
        value = new if test is None else F.when(test, new).otherwise(_now())
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def _suffixes(rules, measure: str) -> Column:
    """Longest suffix first; replaced where what is before it has the measure."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    return _cases([(_now().endswith(s), _stem_form(len(s)).rlike(measure), _cut(_now(), s, new)) for s, new in ordered], _now())


def with_stems(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """``words`` with the Porter stem of column ``word`` (lower-case letters) in column ``stem``.

    One projection a step: each reads the word and its form many times, so
    Spark keeps them apart instead of repeating the earlier steps.  A filter on the
    stem may be pushed down and repeat them: cache or write the result first.
    """
    out = words.withColumn("_w", F.col(word)).withColumn("_form", word_form(_now()))

    def step(new: Column):
        nonlocal out
        out = out.withColumn("_w", new).withColumn("_form", word_form(_now()))

    # 1a: plurals
    step(_cases([(_now().endswith("ies") & (F.length(_now()) == 4), None, _cut(_now(), "ies", "ie")),
                 (_now().endswith("sses"), None, _cut(_now(), "sses", "ss")), (_now().endswith("ies"), None, _cut(_now(), "ies", "i")),
                 (_now().endswith("ss"), None, _now()), (_now().endswith("s"), None, _cut(_now(), "s", ""))], _now()))
    # 1b: -ed and -ing; a cut word is marked by a blank behind it until it is smoothed
    step(_cases([(_now().endswith("ied"), None, F.when(F.length(_now()) == 4, _cut(_now(), "ied", "ie")).otherwise(_cut(_now(), "ied", "i"))),
                 (_now().endswith("eed"), _stem_form(3).rlike(POSITIVE), _cut(_now(), "eed", "ee")),
                 (_now().endswith("ed") & _stem_form(2).contains("v"), None, _cut(_now(), "ed", " ")),
                 (_now().endswith("ing") & _stem_form(3).contains("v"), None, _cut(_now(), "ing", " "))], _now()))
    out = out.withColumn("_cut", _now().endswith(" ")).withColumn("_w", F.rtrim(_now())).withColumn("_form", word_form(_now()))
    step(_cases([(~F.col("_cut"), None, _now()), (_now().rlike("(at|bl|iz)$"), None, F.concat(_now(), F.lit("e"))),
                 (_double(), ~_now().rlike("[lsz]$"), _cut(_now(), "x", "")),
                 (_shape().rlike(ONE) & _short(_shape(), _now()), None, F.concat(_now(), F.lit("e")))], _now()))
    # 1c: y after a consonant, not as second letter
    step(F.when(_now().endswith("y") & (F.length(_now()) > 2) & _stem_form(1).endswith("c"), _cut(_now(), "y", "i")).otherwise(_now()))
    # 2: -alli first, as its result may end in another suffix
    step(F.when(_now().endswith("alli") & _stem_form(4).rlike(POSITIVE), _cut(_now(), "alli", "al")).otherwise(_now()))
    step(F.when(_now().endswith("logi"), F.when(_stem_form(3).rlike(POSITIVE), _cut(_now(), "logi", "log")).otherwise(_now()))
         .otherwise(_suffixes(PORTER_STEP2, POSITIVE)))
    step(_suffixes(PORTER_STEP3, POSITIVE))
    ion = _stem_form(3).rlike(OVER_ONE) & _now().rlike("[st]ion$")
    step(F.when(_now().endswith("ion"), F.when(ion, _cut(_now(), "ion", "")).otherwise(_now()))
         .otherwise(_suffixes([(s, "") for s in PORTER_STEP4], OVER_ONE)))
    # 5: final e, then double l
    before = F.substring(_now(), F.lit(1), F.length(_now()) - 1)
    cut = _stem_form(1).rlike(OVER_ONE) | (_stem_form(1).rlike(ONE) & ~_short(_stem_form(1), before))
    step(F.when(_now().endswith("e") & cut, before).otherwise(_now()))
    step(F.when(_now().endswith("ll") & _stem_form(1).rlike(OVER_ONE), before).otherwise(_now()))

    irregular = F.create_map(*[F.lit(x) for kv in PORTER_IRREGULAR.items() for x in kv])
    short = F.when(F.length(word) <= 2, F.col(word))
    return out.withColumn(stem, F.coalesce(F.try_element_at(irregular, F.col(word)), short, _now())).drop("_w", "_form", "_cut")


# ---------------------------------------------------------------- back into the texts

def map_words(docs: DataFrame, id_col: str, text_col: str, tokens: Column, forms: DataFrame) -> DataFrame:
    """(id, text): every token replaced by its form, joined by spaces.

    ``forms`` holds (word, form), a word once; a token without a row keeps its
    form.  Below the limits of ``joins.small_enough`` the forms are broadcast, and
    the texts are shuffled once, whole, so that a text's words meet again where
    they already are.  Beyond, words shuffle to their forms and back to their texts.
    """
    # all forms are cached, then those that change taken: a filter must not be pushed into the steps of with_stems
    forms = scoped_cache(forms.select("word", "form")).where(F.col("form") != F.col("word"))
    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    if small_enough(forms):
        rows, forms = rows.repartition(F.col(id_col)), F.broadcast(forms)
    rows = rows.withColumn("_none", F.col("_text").isNull()).withColumn("_tokens", tokens)
    each = rows.select(id_col, "_none", F.posexplode_outer("_tokens").alias("pos", "word"))
    got = each.join(forms, "word", "left").groupBy(id_col).agg(
        F.bool_and("_none").alias("_none"),
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("form", "word").alias("form")))).alias("_words"))
    text = F.array_join(F.transform("_words", lambda x: x["form"]), " ")
    return got.select(id_col, F.when(~F.col("_none"), text).alias(text_col))
