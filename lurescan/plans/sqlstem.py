"""DuckDB twins of the word dictionaries: lemmas by detachment, stems by steps of one CTE each."""

from __future__ import annotations

from lurescan.functions.lexicon import (LEMMA_TABLE, NOUN_DETACHMENTS, PORTER_IRREGULAR, PORTER_STEP2, PORTER_STEP3,
                                        PORTER_STEP4)
from lurescan.plans.sqlfrag import q


def _values(pairs):
    return "(VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in pairs) + ")"


def lemma_ctes(words: str, lexicon: str) -> list[str]:
    """CTE ``lemmas`` (word, lemma) over the tables named, each with a column word."""
    return [
        f"cand AS (SELECT word, word AS form FROM {words} UNION SELECT word, left(word, length(word) - length(s)) || r "
        f"FROM {words}, {_values(NOUN_DETACHMENTS)} d(s, r) WHERE suffix(word, s) AND length(word) > length(s))",
        f"best AS (SELECT word, min(ROW(length(form), form)) AS b FROM cand WHERE form IN (SELECT word FROM {lexicon}) "
        "GROUP BY word)",
        f"lemmas AS (SELECT w.word, coalesce(o.lemma, b.b[2], w.word) AS lemma FROM {words} w LEFT JOIN best b "
        f"ON w.word = b.word LEFT JOIN {_values(LEMMA_TABLE.items())} o(word, lemma) ON w.word = o.word)",
    ]


def _form(w):
    """Consonants and vowels of a word; y counts as a vowel behind a consonant."""
    return (f"list_reduce(list_prepend('', string_split({w}, '')), lambda a, x: a || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') "
            "OR (x = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END)")


def _m(f, n):
    """The measure: how often a consonant follows a vowel."""
    return f"len(regexp_extract_all({f}, 'vc')) {n}"


def _short(w, f):
    return f"(({f} LIKE '%cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y')) OR {f} = 'vc')"


def _rules(rules, test):
    arms = " ".join(f"WHEN suffix(w, '{s}') THEN CASE WHEN {_m(f'left(f, length(w) - {len(s)})', test)} "
                    f"THEN left(w, length(w) - {len(s)}) || '{r}' ELSE w END"
                    for s, r in sorted(rules, key=lambda x: len(x[0]), reverse=True))
    return f"CASE {arms} ELSE w END"


def stem_ctes(words: str, col: str) -> list[str]:
    """CTE ``stems`` (word, stem) for the distinct values of a column."""
    less = lambda k: f"left(w, length(w) - {k})"
    form = lambda k: f"left(f, length(w) - {k})"
    ends = lambda s: f"suffix(w, '{s}')"
    smooth = (f"CASE WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN length(w) > 1 AND f LIKE '%c' AND "
              f"right(w, 1) = w[-2:-2] THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE {less(1)} END "
              f"WHEN {_m('f', '= 1')} AND {_short('w', 'f')} THEN w || 'e' ELSE w END")
    steps = [
        f"CASE WHEN {ends('ies')} AND length(w) = 4 THEN {less(1)} WHEN {ends('sses')} OR {ends('ies')} THEN {less(2)} "
        f"WHEN {ends('s')} AND NOT {ends('ss')} THEN {less(1)} ELSE w END",
        f"CASE WHEN {ends('ied')} THEN CASE WHEN length(w) = 4 THEN {less(1)} ELSE {less(2)} END "
        f"WHEN {ends('eed')} THEN CASE WHEN {_m(form(3), '> 0')} THEN {less(1)} ELSE w END "
        f"WHEN {ends('ed')} AND {form(2)} LIKE '%v%' THEN '+' || {less(2)} "
        f"WHEN {ends('ing')} AND {form(3)} LIKE '%v%' THEN '+' || {less(3)} ELSE w END",
        None,
        f"CASE WHEN {ends('y')} AND length(w) > 2 AND {form(1)} LIKE '%c' THEN {less(1)} || 'i' ELSE w END",
        f"CASE WHEN {ends('alli')} AND {_m(form(4), '> 0')} THEN {less(2)} ELSE w END",
        f"CASE WHEN {ends('logi')} THEN CASE WHEN {_m(form(3), '> 0')} THEN {less(1)} ELSE w END "
        f"ELSE {_rules(PORTER_STEP2, '> 0')} END",
        _rules(PORTER_STEP3, "> 0"),
        f"CASE WHEN {ends('ion')} THEN CASE WHEN {_m(form(3), '> 1')} AND regexp_matches(w, '[st]ion$') THEN {less(3)} "
        f"ELSE w END ELSE {_rules([(s, '') for s in PORTER_STEP4], '> 1')} END",
        f"CASE WHEN {ends('e')} AND ({_m(form(1), '> 1')} OR ({_m(form(1), '= 1')} AND NOT {_short(less(1), form(1))})) "
        f"THEN {less(1)} ELSE w END",
        f"CASE WHEN {ends('ll')} AND {_m(form(1), '> 1')} THEN {less(1)} ELSE w END",
    ]
    out = [f"s0 AS MATERIALIZED (SELECT word, word AS w, {_form('word')} AS f FROM (SELECT DISTINCT {col} AS word FROM {words}) x)"]
    for i, e in enumerate(steps):
        if e is None:  # smooth the words cut by the step before, marked by a plus
            cut = f"SELECT word, substr(w, 2) AS w, {_form('substr(w, 2)')} AS f FROM s{i} WHERE w LIKE '+%'"
            inner = (f"SELECT word, {smooth} AS w FROM ({cut}) y UNION ALL SELECT word, w FROM s{i} WHERE w NOT LIKE '+%'")
        else:
            inner = f"SELECT word, {e} AS w FROM s{i}"
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT word, w, {_form('w')} AS f FROM ({inner}) x)")
    odd = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PORTER_IRREGULAR.items())
    out.append(f"stems AS (SELECT word, CASE word {odd} ELSE CASE WHEN length(word) <= 2 THEN word ELSE w END END AS stem "
               f"FROM s{len(steps)})")
    return out
