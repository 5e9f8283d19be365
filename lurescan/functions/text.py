"""Column -> Column text functions: cleaning, normalising and hand-made features.

All are built-in Spark expressions (whole-stage codegen, no Python).  Where the
original semantics are Python's Unicode-aware ``\\s``/``str.split``/``strip``,
the explicit whitespace class of ``str.isspace`` is used instead of Java's
ASCII ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurescan.functions.lexicon import ASCII_PUNCTUATION, PY_WHITESPACE_CHARS, PY_WHITESPACE_CLASS

WS = f"[{PY_WHITESPACE_CLASS}]"          # one Python whitespace character
NON_WS = f"[^{PY_WHITESPACE_CLASS}]"     # one Python non-whitespace character


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spaces_only(c) -> Column:
    """Every Python whitespace character turned into a plain space (translate, no regex)."""
    return F.translate(_c(c), PY_WHITESPACE_CHARS, " " * len(PY_WHITESPACE_CHARS))


def drop_whitespace(c) -> Column:
    return F.translate(_c(c), PY_WHITESPACE_CHARS, "")


def split_words(c) -> Column:
    """Python ``str.split()`` as an array: whitespace normalised by translate, split on runs of spaces."""
    return F.filter(F.split(spaces_only(c), " +"), lambda t: t != "")


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def count_char(c, ch: str) -> Column:
    """``text.count(ch)`` for a single character, without a regex."""
    c = _c(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("long")


def regex_count(c, pattern: str) -> Column:
    return F.regexp_count(_c(c), F.lit(pattern)).cast("long")


# ---------------------------------------------------------------- cleaning

def clean_html(c) -> Column:
    """Delete tags (words may fuse), collapse whitespace, strip."""
    no_tags = F.regexp_replace(_c(c), "<[^>]*>", "")
    return py_strip(F.regexp_replace(no_tags, f"{WS}+", " "))


# Patterns that decide what counts as an address, URL or phone number
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def extract_email(c) -> Column:
    """First e-mail address in the value, else null."""
    return F.nullif(F.regexp_extract(_c(c).cast("string"), EMAIL_PATTERN, 0), F.lit(""))


# Names of months and weekdays in dates (also their first three letters, and "sept")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "tues", "wednes", "thur", "thurs")
#: Words that may stand in a date without a meaning.
DATE_FILLERS = ("at", "on", "and", "ad", "of", "m", "t", "st", "nd", "rd", "th")
#: Years of two digits lie before this year, at most a hundred years.
CENTURY_END = 2075
# clock times, with fraction, half of the day and offset or zone letter; a time without minutes needs am or pm
_OFFSET = r"(?:\s*(?:UTC|GMT|Z)?\s*[+-]\d{1,2}:?\d{2}\b|\s*Z\b)?"
_CLOCK = r"(?i)(?:(?<=\d)T|\b)\s*\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[ap]\.?m\b\.?)?" + _OFFSET + r"|\b\d{1,2}\s*[ap]\.?m\b\.?"
_ZONE_NAME = r"(?<=[\s\d])(?!(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC|MON|TUE|TUES|WED|THU|THUR|FRI|SAT|SUN|MARCH|APRIL|JUNE|JULY)\b)[A-Z]{3,5}\b"


def date_tokens(c) -> Column:
    """Lower-case words and numbers of a date text in order, without comments, clock time, zone and fillers.

    Null where anything else stands in the text.
    """
    s = F.regexp_replace(_c(c).cast("string"), r"\([^()]*\)", " ")
    s = F.regexp_replace(F.regexp_replace(s, _CLOCK, " "), _ZONE_NAME, " ")
    s = F.lower(s)
    # what is not a word, a number or a separator is no date
    clean = F.regexp_replace(s, r"[a-z]+|\d+|[\s,;/.'-]+", "") == ""
    skip = F.array(*[F.lit(w) for w in (*DATE_FILLERS, *WEEKDAYS, *(d[:3] for d in WEEKDAYS[:7]))])
    return F.when(clean, F.filter(F.regexp_extract_all(s, F.lit(r"[a-z]+|\d+"), 0), lambda t: ~F.array_contains(skip, t)))


def _month_number(t: Column) -> Column:
    """1 to 12 for a month's name, 0 for any other token."""
    out = F.lit(0)
    for i, name in enumerate(MONTHS):
        out = F.when(t.isin(name, name[:3], *(["sept"] if i == 8 else [])), i + 1).otherwise(out)
    return out


def clean_date(c) -> Column:
    """Lenient date parse by grammar to ``dd/MM/yyyy``; unparsable or incomplete -> null.

    Three tokens make a date, at most one of them a month's name; a single
    number of 6, 8, 12 or 14 digits is read from the year down.  Which number is
    the year follows from its digits and size: with a name in the middle or in
    front, a first (a middle) number above 31 is the year, else the last; without
    a name, a first number above 31 or of more than two digits is the year and
    month and day follow, a first number above 12 is the day, and else the month
    comes first.  Years of two digits lie in the hundred years before
    ``CENTURY_END``.  The wall-clock date is kept: an offset is not applied.
    """
    return let(date_tokens(c), lambda t: let(_three(t), lambda x: let(_numbered(x), lambda full: let(
        _resolved(t, full), _rendered))))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


PACKED = r"^(?:\d{6}|\d{8}|\d{12}|\d{14})$"


def _packed(t: Column) -> Column:
    return (F.size(t) == 1) & F.element_at(t, 1).rlike(PACKED)


def _three(t: Column) -> Column:
    """The three tokens of a date; a packed number is cut into year, month and day."""
    one = F.element_at(t, 1)
    width = F.when(F.length(one) == 6, 2).otherwise(4)
    parts = F.array(F.substr(one, F.lit(1), width), F.substr(one, width + 1, F.lit(2)), F.substr(one, width + 3, F.lit(2)))
    return F.when(_packed(t), parts).when(F.size(t) == 3, t)


def _numbered(t: Column) -> Column:
    """(number, digits, whether it is a month's name) of each token; words that are no month give no number."""
    def of(x):
        return let(_month_number(x), lambda m: F.struct(
            F.when(x.rlike(r"^\d{1,4}$"), x.try_cast("int")).when(m > 0, m).alias("v"),
            F.when(x.rlike(r"^\d+$"), F.length(x)).otherwise(0).alias("digits"), (m > 0).alias("name")))
    return F.transform(t, of)


def _resolved(t: Column, full: Column) -> Column:
    """Year (with its digits), month and day among the three tokens."""
    a, b, d = (F.element_at(full, i) for i in (1, 2, 3))

    def order(y, m, day):
        return F.struct(y["v"].alias("y"), y["digits"].alias("digits"), m["v"].alias("m"), day["v"].alias("d"))

    names = F.size(F.filter(full, lambda x: x["name"]))
    return (F.when(full.isNull() | (names > 1), None).when(_packed(t), order(a, b, d))
            .when(a["name"], F.when(b["v"] > 31, order(b, a, d)).otherwise(order(d, a, b)))
            .when(b["name"], F.when(a["v"] > 31, order(a, b, d)).otherwise(order(d, b, a)))
            .when(d["name"], F.when(b["v"] > 31, order(b, d, a)).otherwise(order(a, d, b)))
            .when((a["v"] > 31) | (a["digits"] > 2), order(a, b, d))
            .when(a["v"] > 12, order(d, b, a)).otherwise(order(d, a, b)))


def _rendered(p: Column) -> Column:
    year = F.when(p["digits"] > 2, p["y"]).when(p["y"] + 2000 < CENTURY_END, p["y"] + 2000).otherwise(p["y"] + 1900)
    text = F.format_string("%04d-%02d-%02d", year, p["m"], p["d"])
    ok = p["m"].between(1, 12) & p["d"].between(1, 31) & (year > 0)
    return F.when(ok, F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "dd/MM/yyyy"))


def clean_subject(c) -> Column:
    """Null when more than half of the characters are non-ASCII."""
    c = _c(c)
    share = regex_count(c, "[^\\x00-\\x7F]") / F.length(c)
    return F.when((F.length(c) > 0) & (share > 0.5), F.lit(None).cast("string")).otherwise(c)


def clean_body(c) -> Column:
    """Drop non-ASCII, ``\\s{2,}`` -> space, strip; empty or null -> null."""
    c = _c(c)
    out = F.regexp_replace(c, "[^\\x00-\\x7F]+", "")
    out = py_strip(F.regexp_replace(out, f"{WS}{{2,}}", " "))
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(out)


def clean_sms(c) -> Column:
    """Decode only &lt; / &gt;, drop mojibake and non-ASCII, collapse whitespace."""
    out = F.replace(_c(c), F.lit("&lt;"), F.lit("<"))
    out = F.replace(out, F.lit("&gt;"), F.lit(">"))
    out = F.regexp_replace(out, "[Âï¿½]+", "")  # fixed value: mojibake characters
    out = F.regexp_replace(out, "[^\\x00-\\x7F]+", "")
    return py_strip(F.regexp_replace(out, f"{WS}+", " "))


def strip_nonalpha_space(c) -> Column:
    """lower, every non-letter -> space."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-zA-Z]", " ")


def strip_nonalpha_drop(c) -> Column:
    """Delete everything but ASCII letters and whitespace (words can fuse)."""
    return F.regexp_replace(_c(c), f"[^a-zA-Z{PY_WHITESPACE_CLASS}]", "")


def strip_punct(c) -> Column:
    """lower, delete ASCII punctuation (digits kept)."""
    return F.translate(F.lower(_c(c)), ASCII_PUNCTUATION, "")


def strip_urls(c) -> Column:
    # fixed value: the URL pattern of this cleaner
    return F.regexp_replace(_c(c), f"http{NON_WS}+|www{NON_WS}+|https{NON_WS}+", "")


# ---------------------------------------------------------------- features

def has_url(c) -> Column:
    # fixed value: the URL pattern
    return _c(c).rlike(f"http{NON_WS}+|www\\.{NON_WS}+").cast("int")


def has_email(c) -> Column:
    # \S+@\S+ matches exactly when some '@' has a non-space on both sides; this
    # form is linear (the + form backtracks over long tokens)
    c = _c(c)
    return F.when(c.contains("@"), c.rlike(f"{NON_WS}@{NON_WS}")).otherwise(F.lit(False)).cast("int")


def has_phone(c) -> Column:
    # fixed value: the phone patterns
    return _c(c).rlike("(?U)\\b\\d{10}\\b|\\(\\d{3}\\)\\s*\\d{3}-\\d{4}").cast("int")


def message_length(c) -> Column:
    return F.length(_c(c)).cast("long")


def num_exclamations(c) -> Column:
    return count_char(c, "!")


def num_questions(c) -> Column:
    return count_char(c, "?")


def num_uppercase(c) -> Column:
    return regex_count(c, "\\p{IsUppercase}")


#: Characters that ``str.isdigit`` takes beside the decimal digits (superscripts, circled digits, ...),
#: by Python's Unicode tables.
DIGITS_BEYOND_DECIMAL = "".join(c for c in map(chr, range(0x110000)) if c.isdigit() and not c.isdecimal())


def num_digits(c) -> Column:
    """Characters for which ``str.isdigit`` holds.

    A class of many single characters is tried one by one, so ASCII is told apart first.
    """
    return regex_count(c, f"[0-9]|(?=[^\\x00-\\x7F])[\\p{{Nd}}{DIGITS_BEYOND_DECIMAL}]")


def num_decimals(c) -> Column:
    """Decimal digits only (the pattern ``\\d``)."""
    return regex_count(c, "\\p{Nd}")


def num_words(c) -> Column:
    return F.size(split_words(c)).cast("long")


def avg_word_length(c) -> Column:
    c = _c(c)
    n = num_words(c)
    chars = F.length(drop_whitespace(c))
    return F.when(n > 0, chars / n).otherwise(F.lit(0.0)).cast("double")


def num_special_chars(c) -> Column:
    return regex_count(c, f"[^\\p{{L}}\\p{{N}}{PY_WHITESPACE_CLASS}]")


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

# the feature bundles of the training scripts, taken from raw text
FEATURE_BUNDLES = {
    "email": ["has_url", "has_email", "has_phone", "message_length", "num_exclamations",
              "num_questions", "num_uppercase", "num_digits"],
    "sms": ["has_url", "has_phone", "message_length", "num_exclamations", "num_questions",
            "num_uppercase", "num_digits", "num_words", "avg_word_length", "num_special_chars"],
    "split": ["has_url", "has_email", "has_phone", "message_length", "num_exclamations",
              "num_questions", "num_uppercase", "num_digits"],
    "synthetic": ["message_length", "num_exclamations", "num_questions", "num_uppercase"],
}


def message_features(c, bundle: str = "sms") -> list[Column]:
    """The named bundle as aliased columns, for one ``select``."""
    return [FEATURES[name](c).alias(name) for name in FEATURE_BUNDLES[bundle]]
