"""DuckDB twins of the Column functions, as SQL text templates over an expression."""

from __future__ import annotations

from lurescan.functions.lexicon import ASCII_PUNCTUATION, NLTK_STOPWORDS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


PUNCT_SQL = q(ASCII_PUNCTUATION)
NLTK_LIST_SQL = "[" + ", ".join(q(w) for w in NLTK_STOPWORDS) + "]"

BOUND = r"[^\p{L}\p{N}_]"  # a Unicode word boundary neighbour, spelled out for RE2


def has_url(t):
    return f"CAST(regexp_matches({t}, 'http\\S+|www\\.\\S+') AS INTEGER)"


def has_email(t):
    return f"CAST(regexp_matches({t}, '\\S+@\\S+') AS INTEGER)"


def has_phone(t):
    return (f"CAST(regexp_matches({t}, '(^|{BOUND})\\d{{10}}($|{BOUND})|\\(\\d{{3}}\\)\\s*\\d{{3}}-\\d{{4}}') "
            f"AS INTEGER)")


def message_length(t):
    return f"CAST(length({t}) AS BIGINT)"


def count_char(t, ch):
    return f"CAST(length({t}) - length(replace({t}, {q(ch)}, '')) AS BIGINT)"


def num_exclamations(t):
    return count_char(t, "!")


def num_questions(t):
    return count_char(t, "?")


def rcount(t, pat):
    return f"CAST(len(regexp_extract_all({t}, '{pat}')) AS BIGINT)"


def num_uppercase(t):
    return rcount(t, "\\p{Lu}")


def num_digits(t):
    from lurescan.functions.text import DIGITS_BEYOND_DECIMAL
    return rcount(t, f"[\\p{{Nd}}{DIGITS_BEYOND_DECIMAL}]")


def num_words(t):
    return rcount(t, "\\S+")


def avg_word_length(t):
    nw = num_words(t)
    return (f"CASE WHEN {nw} > 0 THEN CAST(length(regexp_replace({t}, '\\s+', '', 'g')) AS DOUBLE) / {nw} "
            f"ELSE 0.0 END")


def num_special_chars(t):
    return rcount(t, "[^\\p{L}\\p{N}\\s]")


FEATURES = {
    "has_url": has_url,
    "has_email": has_email,
    "has_phone": has_phone,
    "message_length": message_length,
    "num_exclamations": num_exclamations,
    "num_questions": num_questions,
    "num_uppercase": num_uppercase,
    "num_digits": num_digits,
    "num_words": num_words,
    "avg_word_length": avg_word_length,
    "num_special_chars": num_special_chars,
}


def feature_sql(name, t):
    e = FEATURES[name](t)
    return f"round({e}, 6)" if name == "avg_word_length" else e


# ---------------------------------------------------------------- cleaning

def py_strip(t):
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def clean_html(t):
    return py_strip(f"regexp_replace(regexp_replace({t}, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')")


def extract_email(t):
    return (f"nullif(regexp_extract(CAST({t} AS VARCHAR), "
            f"'\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b', 0), '')")


MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
# (pattern, year, month, day groups; whether the month is a name): shapes searched anywhere in the text,
# unlike the Spark side, which strips the text and tries formats
DATE_SHAPES = (
    ("(\\d{4})[-/](\\d{1,2})[-/](\\d{1,2})", 1, 2, 3, False),
    ("^(\\d{4})(\\d{2})(\\d{2})$", 1, 2, 3, False),
    ("(\\d{1,2})-([A-Za-z]{3})-(\\d{4})", 3, 2, 1, True),
    ("(\\d{1,2}) +([A-Za-z]{3})[a-z]* +(\\d{4})", 3, 2, 1, True),
    ("([A-Za-z]{3})[a-z]* +(\\d{1,2}),? +(?:\\d{1,2}:\\d{2}:\\d{2} +)?(\\d{4})", 3, 1, 2, True),
    ("(\\d{1,2})/(\\d{1,2})/(\\d{4})", 3, 1, 2, False),
    ("^(\\d{2})/(\\d{2})/(\\d{2})$", 3, 1, 2, False),
)


def clean_date(t):
    s = f"CAST({t} AS VARCHAR)"
    arms = []
    for p, y, m, d, named in DATE_SHAPES:
        part = lambda g: f"regexp_extract({s}, '{p}', {g})"  # noqa: B023, E731
        month = f"list_position({MONTHS}, lower({part(m)}))" if named else f"try_cast({part(m)} AS INTEGER)"
        year = f"try_cast({part(y)} AS INTEGER)"
        year = f"CASE WHEN {year} < 75 THEN {year} + 2000 WHEN {year} < 100 THEN {year} + 1900 ELSE {year} END"
        arms.append(f"WHEN regexp_matches({s}, '{p}') THEN strftime(try_cast(printf('%04d-%02d-%02d', "
                    f"{year}, {month}, try_cast({part(d)} AS INTEGER)) AS DATE), '%d/%m/%Y')")
    return "CASE " + " ".join(arms) + " END"


def clean_subject(t):
    share = f"CAST(len(regexp_extract_all({t}, '[^\\x00-\\x7F]')) AS DOUBLE) / length({t})"
    return f"CASE WHEN length({t}) > 0 AND {share} > 0.5 THEN NULL ELSE {t} END"


def clean_body(t):
    out = f"regexp_replace({t}, '[^\\x00-\\x7F]+', '', 'g')"
    out = py_strip(f"regexp_replace({out}, '\\s{{2,}}', ' ', 'g')")
    return f"CASE WHEN {t} IS NULL OR {t} = '' THEN NULL ELSE {out} END"


def clean_sms(t):
    out = f"replace(replace({t}, '&lt;', '<'), '&gt;', '>')"
    out = f"regexp_replace({out}, '[Âï¿½]+', '', 'g')"
    out = f"regexp_replace({out}, '[^\\x00-\\x7F]+', '', 'g')"
    return py_strip(f"regexp_replace({out}, '\\s+', ' ', 'g')")


def strip_nonalpha_space(t):
    return f"regexp_replace(lower({t}), '[^a-zA-Z]', ' ', 'g')"


def strip_nonalpha_drop(t):
    return f"regexp_replace({t}, '[^a-zA-Z\\s]', '', 'g')"


def strip_punct(t):
    return f"translate(lower({t}), {PUNCT_SQL}, '')"


def strip_urls(t):
    return f"regexp_replace({t}, 'http\\S+|www\\S+|https\\S+', '', 'g')"
