"""Label rules of the message sets (Column -> Column).

Each rule is kept as its own function because the scripts disagree on case,
on nulls and on polarity; pick the one that matches the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurescan.functions.lexicon import EMAIL_NEGATIVE, EMAIL_POSITIVE, SMS_MERGED, SMS_THREE


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(c: Column, mapping: dict) -> Column:
    """Map lookup; a missing key (or null) gives null."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr.otherwise(F.lit(None).cast("int"))


def lower_labels(c) -> Column:
    return F.lower(_c(c))


def map_labels_binary(c) -> Column:
    """E-mail: Safe Email -> 0, Phishing Email -> 1, other -> null."""
    return _lookup(_c(c), {EMAIL_NEGATIVE: 0, EMAIL_POSITIVE: 1})


def map_labels_equality(c, positive: str = EMAIL_POSITIVE) -> Column:
    """Equal to the positive string -> 1, anything else (null too) -> 0."""
    return F.coalesce((_c(c) == positive).cast("int"), F.lit(0))


def map_labels_three(c) -> Column:
    """SMS, lowered: ham 0, spam 1, smishing 2, other -> null."""
    return _lookup(F.lower(_c(c)), SMS_THREE)


def map_labels_merged(c) -> Column:
    """SMS, lowered: ham and spam 0, smishing 1, other -> null."""
    return _lookup(F.lower(_c(c)), SMS_MERGED)


def map_labels_equality_lower(c, positive: str = "smishing") -> Column:
    return F.coalesce((F.lower(_c(c)) == positive).cast("int"), F.lit(0))


def map_labels_equality_cs(c, positive: str = "Smishing") -> Column:
    """Case-sensitive equality: only the exact string counts."""
    return map_labels_equality(c, positive)


def cast_label(c) -> Column:
    return _c(c).cast("int")
