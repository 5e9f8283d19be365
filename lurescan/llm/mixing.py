"""Operator 4: mixing sources to target weights (DataFrame functions only).

The tree is domain, then language, then source; its leaves hold documents.  A
leaf's capacity is its tokens times the number of epochs allowed, a node's the
sum of its leaves'.  The budget goes down the tree: at each node it is split
by the children's weights, and what a child cannot hold goes to its siblings
by their weights.  As a node never gets more than its subtree can hold, a
shortage is met by siblings first and by the ancestors' siblings only when the
whole subtree is full.  All amounts are whole tokens in exact arithmetic.

A leaf with budget b and t tokens takes b div t whole epochs, then a prefix of
b mod t tokens of one more epoch.  Every epoch has its own seeded order of the
leaf's documents (md5 of seed, epoch and id).  The prefix is found by digits of
that order: token sums of 256 ranges, the one range that the budget ends in is
divided again, and only within that range are documents ordered.  So no task
sees a whole leaf.

Tokens are words here: ``[^\\x20\\x09-\\x0D]+``.

Cases
-----
* null or empty text: no tokens; such a row is never drawn.
* null domain, language or source: a node of its own at that level (``null`` is
  taken as the empty name).
* null ids order first; repeated rows count and are drawn each by itself.
* weights missing from the table: ``DEFAULT_WEIGHT`` parts.
* budget over the whole capacity: every leaf is filled; budget 0 or an empty
  table: no row.
* ties in the seeded order fall back to the id, then to the row's number.
* extra columns are ignored by ``draw`` and returned by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescan.llm import common

LEVELS = ("domain", "lang", "source")
#: Parts by level and name.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"prose": 70, "table": 15, "shout": 15},
    "lang": {"en": 50, "de": 20, "fr": 15, "es": 15},
    "source": {},
}
DEFAULT_WEIGHT = 10
MAX_EPOCHS = 4
#: The budget, as a share of all tokens (hundredths).
BUDGET_PERCENT = 60
SEED = 42
RANGES = 256


def domain_of(text: Column) -> Column:
    """The form of a text: rows of cells, exclamations, or prose."""
    return (F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("!! ")), "shout").otherwise("prose"))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(common.WORD_CLASS + "+")).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, parts in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(int(parts))).otherwise(out)
    return out.cast("long")


BIG = "decimal(38,0)"


def split_budget(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children (``w`` parts, ``cap`` tokens) as ``share``.

    Children are taken by rising cap / w.  One is full if its cap is within
    its part of what the fuller-than-it have left; the others divide the rest
    by weight, rounded down, and the odd tokens go one each in order of name.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("w")).asc(), F.col(name))
    whole, before = Window.partitionBy(*parent), order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    x = children.withColumns({
        "_used": F.coalesce(F.sum("cap").over(before), zero), "_gone": F.coalesce(F.sum("w").over(before), zero),
        "_all": F.sum("w").over(whole)})
    full = (F.col("cap").cast(BIG) * (F.col("_all") - F.col("_gone")).cast(BIG)
            <= F.col("w").cast(BIG) * (F.col("budget") - F.col("_used")).cast(BIG))
    x = x.withColumn("_full", full)
    x = x.withColumns({"_rest": F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), zero),
                       "_parts": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("w"))).over(whole), zero)})
    even = F.expr("cast((cast(w as decimal(38,0)) * cast(_rest as decimal(38,0))) div cast(_parts as decimal(38,0)) as long)")
    x = x.withColumn("_share", F.when(F.col("_full"), F.col("cap")).otherwise(even))
    odd = F.col("budget") - F.sum("_share").over(whole)
    turn = F.row_number().over(Window.partitionBy(*parent, "_full").orderBy(name))
    x = x.withColumns({"_odd": odd, "_turn": turn})
    share = F.col("_share") + F.when(~F.col("_full") & (F.col("_turn") <= F.col("_odd")), 1).otherwise(0)
    return x.withColumn("share", share.cast("long")).drop("_used", "_gone", "_all", "_full", "_rest", "_parts", "_share", "_odd", "_turn")


def plan(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, percent: int = BUDGET_PERCENT,
         max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Leaves (domain, lang, source, tokens) -> the same with ``budget``."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0  # one number
    goal = min(total * percent // 100, total * max_epochs)
    caps = leaves.where("tokens > 0").withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    top = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumns(
        {"w": _weight("domain", weights), "budget": F.lit(goal).cast("long"), "_root": F.lit(0)})
    top = split_budget(top, ["_root"], "domain").select("domain", F.col("share").alias("budget"))
    mid = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("lang", weights)).join(top, "domain")
    mid = split_budget(mid, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    low = caps.withColumn("w", _weight("source", weights)).join(mid, ["domain", "lang"])
    return split_budget(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", F.col("share").alias("budget"))


def seeded(seed: int, epoch: Column, id_: Column) -> Column:
    """Six bytes of md5 as a whole number."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def leaf_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, row_col: str | None = None) -> DataFrame:
    number = F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`")
    text = common.text_of(F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), domain_of(text).alias("domain"),
                       *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"))),
                       n_words(text).alias("n_tokens"), number.alias("row"))


def draw(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, percent: int = BUDGET_PERCENT,
         max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
         lang_col: str = "lang", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row for each epoch of each document drawn: id, row, leaf, epoch, n_tokens, take_tokens.

    ``row`` tells rows with equal ids apart: the number in ``row_col``, or one given here.
    """
    keys = list(LEVELS)
    rows = common.materialise(leaf_rows(docs, id_col, text_col, lang_col, source_col, row_col), "op4-rows")
    budgets = plan(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), weights, percent, max_epochs)
    budgets = common.materialise(budgets, "op4-plan")
    leaves = budgets.select(*keys, F.expr("budget div tokens").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest"))
    rows = rows.where("n_tokens > 0").join(leaves, keys)

    full = rows.where("epochs > 0").select("id", "row", *keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))).alias("epoch"),
                                           "n_tokens", F.col("n_tokens").alias("take_tokens"))

    part = rows.where("rest > 0").withColumn("epoch", F.col("epochs") + 1)
    part = part.withColumn("key", seeded(seed, F.col("epoch"), F.col("id")))
    taken = []
    group = keys
    for depth in range(2):  # two digits of the order: 256, then 65,536 ranges
        digit = f"r{depth}"
        part = part.withColumn(digit, F.expr(f"(key div {2 ** (40 - 8 * depth)}) % {RANGES}"))
        sums = part.groupBy(*group, digit).agg(F.sum("n_tokens").alias("s"), F.min("rest").alias("limit"))
        before = Window.partitionBy(*group).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.coalesce(F.sum("s").over(before), F.lit(0).cast("long")))
        place = F.when(F.col("start") + F.col("s") <= F.col("limit"), "in").when(F.col("start") < F.col("limit"), "cut")
        sums = sums.withColumn("place", place).where("place is not null").select(*group, digit, "start", "place")
        met = part.join(sums, group + [digit])
        taken.append(met.where("place = 'in'").select("id", "row", *keys, "epoch", "n_tokens", F.col("n_tokens").alias("take_tokens")))
        part = met.where("place = 'cut'").withColumn("rest", F.col("rest") - F.col("start")).drop("start", "place")
        group = group + [digit]
    run = Window.partitionBy(*group).orderBy("key", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    last = part.withColumn("start", F.coalesce(F.sum("n_tokens").over(run), F.lit(0).cast("long"))).where("start < rest")
    taken.append(last.select("id", "row", *keys, "epoch", "n_tokens", F.least("n_tokens", F.col("rest") - F.col("start")).alias("take_tokens")))
    for x in taken:
        full = full.unionByName(x)
    return full


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` as often as they are drawn, whole documents, all columns.

    The document in which a leaf's budget ends is taken whole.  Every row is
    drawn by itself, also one with a null id or an id that another row has:
    rows are numbered and written once, and the draws meet them by number.
    """
    row, copy = common.fresh(docs, "_row_number"), common.fresh(docs, "_copy")
    numbered = common.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "op4-docs")
    times = draw(numbered, id_col=id_col, row_col=row, **options).groupBy(F.col("row").alias(row)).agg(
        F.count(F.lit(1)).cast("int").alias(copy))
    again = F.explode(F.array_repeat(F.lit(1), F.col(f"`{copy}`")))
    return numbered.join(times, row).select(*[F.col(f"`{c}`") for c in docs.columns], again.alias(copy)).drop(copy)


def query(spark, sf_dir) -> DataFrame:
    out = draw(common.documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select(F.col("id").alias("doc_id"), *LEVELS, "epoch", "n_tokens", "take_tokens")


def _case(level: str) -> str:
    rows = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in sorted(WEIGHTS[level].items()))
    return f"CASE {rows} ELSE {DEFAULT_WEIGHT} END" if rows else str(DEFAULT_WEIGHT)


def _level(src: str, parent: str, name: str) -> str:
    """SQL of split_budget over ``src`` (columns: parent, name, w, cap, budget)."""
    part = f"PARTITION BY {parent}"
    return f"""
      SELECT * EXCLUDE (used, gone, allw, isfull, rest, parts, base, odd, turn),
             base + CASE WHEN NOT isfull AND turn <= odd THEN 1 ELSE 0 END AS share FROM (
      SELECT *, budget - sum(base) OVER ({part}) AS odd, row_number() OVER ({part}, isfull ORDER BY {name}) AS turn FROM (
      SELECT *, CASE WHEN isfull THEN cap ELSE (w::HUGEINT * rest::HUGEINT) // parts END AS base FROM (
      SELECT *, budget - coalesce(sum(CASE WHEN isfull THEN cap END) OVER ({part}), 0) AS rest,
             coalesce(sum(CASE WHEN NOT isfull THEN w END) OVER ({part}), 0) AS parts FROM (
      SELECT *, cap::HUGEINT * (allw - gone) <= w::HUGEINT * (budget - used) AS isfull FROM (
      SELECT *, coalesce(sum(cap) OVER o, 0) AS used, coalesce(sum(w) OVER o, 0) AS gone, sum(w) OVER ({part}) AS allw FROM {src}
      WINDOW o AS ({part} ORDER BY cap::DOUBLE / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))))"""


SQL = f"""
WITH r AS (
  SELECT doc_id, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '!! ') THEN 'shout' ELSE 'prose' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM r GROUP BY ALL),
caps AS (SELECT *, tokens * {MAX_EPOCHS} AS cap FROM leaves WHERE tokens > 0),
goal AS (SELECT least(sum(tokens) * {BUDGET_PERCENT} // 100, sum(tokens) * {MAX_EPOCHS}) AS g FROM leaves),
t0 AS (SELECT 0 AS root, domain, sum(cap) AS cap, {_case('domain')} AS w, (SELECT g FROM goal) AS budget FROM caps GROUP BY domain),
t1 AS ({_level('t0', 'root', 'domain')}),
m0 AS (SELECT a.domain, a.lang, sum(a.cap) AS cap, {_case('lang')} AS w, any_value(t1.share) AS budget FROM caps a JOIN t1 ON a.domain = t1.domain GROUP BY a.domain, a.lang),
m1 AS ({_level('m0', 'domain, lang_root', 'lang').replace('domain, lang_root', 'domain')}),
l0 AS (SELECT a.*, {_case('source')} AS w, m1.share AS budget FROM caps a JOIN m1 ON a.domain = m1.domain AND a.lang = m1.lang),
l1 AS ({_level('l0', 'domain, lang', 'source')}),
p AS (SELECT r.*, share // l1.tokens AS epochs, share % l1.tokens AS rest FROM r JOIN l1 USING (domain, lang, source) WHERE n_tokens > 0),
f AS (SELECT doc_id, domain, lang, source, unnest(range(1, epochs::BIGINT + 1)) AS epoch, n_tokens, n_tokens AS take_tokens FROM p),
k AS (SELECT *, epochs + 1 AS epoch, ('0x' || substr(md5('{SEED}|' || (epochs + 1) || '|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS key FROM p WHERE rest > 0),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens, take_tokens::BIGINT AS take_tokens FROM f
UNION ALL
SELECT doc_id, domain, lang, source, epoch::BIGINT, n_tokens, least(n_tokens, rest - start)::BIGINT FROM c WHERE start < rest
"""
