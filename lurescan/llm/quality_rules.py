"""Operator 2: host-level quality rules.

Each document gets rule counts and rule verdicts (numpy over Arrow slices).
Failures are summed by host (``documents.source``), a beta prior is fitted to
the hosts' rates by the method of moments, every host's rate is shrunk towards
the prior mean, and the hosts' verdicts are joined back to the documents: a host whose
shrunk rate passes a limit loses all of them, and at every other host the share of
symbols a document may have moves with the host's shrunk rate.  A document fails
by symbols when 10 * n_symbols * scale > n_words, where scale is the host's rate by
that rule over the prior mean, ``MIN_SCALE`` at least and ``MAX_SCALE`` at most:
hosts that often fail are read more strictly.

Cases
-----
* null or empty text, or white space only: no words, all counts 0, base_failed.
* null host: all rows without a host form one host of their own.
* null ids and repeated rows: each row is judged and returned by itself.
* a host with few documents: its rate moves towards the prior mean, so one bad
  document alone never condemns a host unless most of the corpus is bad.
* all hosts alike (no spread between their rates), one host, or no rows: the
  prior takes the weight ``MAX_PRIOR`` documents at the mean rate.
* ties: a shrunk rate equal to the limit keeps the host, symbols equal to the limit keep the document.
* extra columns: ``score`` ignores them, ``keep`` returns all of them; names of
  its own columns are taken anew if the table has them already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan.llm import common
from lurescan.llm.words import Words, in_doc, prefix_hash, range_hash

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host is rejected when its shrunk failure rate by one rule is over this.
HOST_LIMIT = 0.5
#: Bounds of a host's symbol rate over the prior mean.
MIN_SCALE, MAX_SCALE = 0.5, 2.0
#: Most documents that the prior may weigh.
MAX_PRIOR = 1000.0

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Rules whose failures are summed by host; base rules also reject the document itself.
RULES = ("few_words", "repeats", "symbols", "dup_lines")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def count_slice(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """The rule counts of every text of a slice."""
    n = len(offsets) - 1
    w = Words(offsets, data)
    prefix = prefix_hash(data)
    out = {
        "n_words": w.counts(),
        "word_chars": w.per_doc(w.full & ((data & 0xC0) != 0x80)),
        "n_symbols": w.per_doc(SYMBOLS[data]),
    }
    # lines with a word: from the start of a text or after \n to the next \n or the end
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], breaks + 1]))
    starts = starts[starts < len(data)]
    doc = np.searchsorted(offsets, starts, "right") - 1
    nxt = np.searchsorted(breaks, starts)
    ends = np.append(breaks, len(data))[nxt]
    ends = np.minimum(ends, offsets[doc + 1])
    full = np.zeros(len(data) + 1, np.int64)
    np.cumsum(w.full, out=full[1:])
    keep = full[ends] > full[starts]
    starts, ends, doc = starts[keep], ends[keep], doc[keep]
    out["n_lines"] = np.bincount(doc, minlength=n)
    _, first = np.unique(in_doc(range_hash(prefix, starts, ends), doc), return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[first], minlength=n)
    # words in windows found twice or more in their text
    first, h = w.windows(w.hashes(prefix), WINDOW)
    covered = np.zeros(len(w.starts) + 1, np.int64)
    if len(first):
        key = in_doc(h, w.doc[first])
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = first[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    covered = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def _kernel(ids, offsets, data):
    counts = count_slice(offsets, data)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(counts[k]) for k in COUNTS)], ["id", *COUNTS])


def _scored(rows: DataFrame, key_type: str) -> DataFrame:
    """(id, text) -> id, counts and a boolean for each rule."""
    out = common.map_texts(rows, _kernel, f"id {key_type}, " + ", ".join(f"{c} long" for c in COUNTS))
    n = F.col("n_words")
    return out.withColumns({
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    })


def beta_prior(hosts: DataFrame, fails: str, total: str) -> tuple[float, float]:
    """(alpha, beta) by the method of moments over the hosts' rates; one row reaches the driver."""
    rate = F.col(fails) / F.col(total)
    got = hosts.agg(F.sum(fails).alias("f"), F.sum(total).alias("n"), F.avg(rate).alias("m"),
                    F.var_samp(rate).alias("v")).first()
    if not got["n"]:
        return 1.0, 1.0
    mean = (got["f"] + 0.5) / (got["n"] + 1.0)  # never 0 or 1
    spread = got["v"] or 0.0
    weight = MAX_PRIOR if spread <= 0 else min(MAX_PRIOR, max(1.0, mean * (1 - mean) / spread - 1))
    return mean * weight, (1 - mean) * weight


def over_symbols(n_symbols, n_words, scale):
    """Whether a document has more symbols than its host allows."""
    return 10 * n_symbols * scale > n_words


def host_verdicts(judged: DataFrame, host: str = "host", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, failures and shrunk rate by rule, ``symbol_scale`` and ``host_ok``."""
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("docs"),
                                     *(F.sum(F.col(r).cast("long")).alias(f"fail_{r}") for r in RULES))
    hosts = common.materialise(hosts, "op2-hosts")
    ok = F.lit(True)
    for r in RULES:
        a, b = beta_prior(hosts, f"fail_{r}", "docs")
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"fail_{r}") + F.lit(a)) / (F.col("docs") + F.lit(a + b)))
        ok = ok & (F.col(f"rate_{r}") <= F.lit(limit))
        if r == "symbols":
            scale = F.greatest(F.lit(MIN_SCALE), F.least(F.lit(MAX_SCALE), F.col(f"rate_{r}") / F.lit(a / (a + b))))
            hosts = hosts.withColumn("symbol_scale", scale)
    return hosts.withColumn("host_ok", ok)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: id, host, counts, rules, the host's verdicts, base_failed, symbols_failed and kept.

    The counts are written once (a few numbers per row); the hosts' table is
    joined back on the host.  Spark broadcasts it when its files are small
    enough, else both sides shuffle and AQE splits the hot host.
    """
    key = F.struct(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"))
    rows = docs.select(key.alias("id"), common.text_of(text_col).alias("text"))
    key_type = rows.schema["id"].dataType.simpleString()
    judged = _scored(rows, key_type)
    judged = common.materialise(judged.select("id.id", "id.host", *COUNTS, *RULES), "op2-rules")
    hosts = host_verdicts(judged, "host", limit).select(F.col("host").alias("h"), "host_ok", "symbol_scale",
                                                        *(f"rate_{r}" for r in RULES))
    out = judged.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    out = out.withColumn("base_failed", F.col("few_words") | F.col("repeats"))
    out = out.withColumn("symbols_failed", over_symbols(F.col("n_symbols"), F.col("n_words"), F.col("symbol_scale")))
    kept = ~F.col("base_failed") & F.col("host_ok") & ~F.col("symbols_failed")
    return out.withColumn("kept", kept).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Row-local rules filter the very rows that carry the text, so no id is
    needed; only the hosts meet the rows in a join, broadcast when their files
    are small enough, else shuffled with the hot host split by AQE.
    """
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.col(f"`{host_col}`").cast("string").alias("id"), common.text_of(F.col(f"`{text_col}`")).alias("text"))
    fails = _scored(rows, "string").withColumnRenamed("id", "host")
    hosts = host_verdicts(fails, "host", limit)
    at = docs.columns.index(text_col)
    words, symbols = common.fresh(docs, "_words"), common.fresh(docs, "_symbols")
    schema = T.StructType([*docs.schema.fields, T.StructField(words, T.LongType()), T.StructField(symbols, T.LongType())])

    def passed(batches):
        for batch in batches:
            offsets, data = common.string_parts(batch.column(at))
            for a, b in common.slices(offsets):
                own = offsets[a:b + 1]
                c = count_slice(own - own[0], data[own[0]:own[-1]])
                good = (c["n_words"] >= MIN_WORDS) & (100 * c["n_repeat_words"] <= MAX_REPEAT_PERCENT * c["n_words"])
                part = batch.slice(a, b - a).filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c["n_words"][good]), pa.array(c["n_symbols"][good])],
                                                 names=schema.names)

    kept = docs.mapInArrow(passed, schema)
    own, known, scale = (common.fresh(docs, x) for x in ("_host", "_known", "_scale"))
    passing = hosts.where("host_ok").select(F.col("host").alias(known), F.col("symbol_scale").alias(scale))
    return (kept.withColumn(own, F.col(f"`{host_col}`").cast("string"))
            .join(passing, F.col(own).eqNullSafe(F.col(known)))
            .where(~over_symbols(F.col(symbols), F.col(words), F.col(scale))).select(*names))


def query(spark, sf_dir) -> DataFrame:
    out = score(common.documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "symbols_failed", "kept", "host_ok")



def _sql() -> str:
    ok = []
    for r in RULES:
        ok.append(f"(fail_{r} + m_{r} * w_{r}) / (docs + w_{r}) <= {HOST_LIMIT}")
    prior = ", ".join(f"(sum(fail_{r}) + 0.5) / (sum(docs) + 1.0) AS m_{r}, coalesce(var_samp(fail_{r} / docs), 0) AS v_{r}" for r in RULES)
    weight = ", ".join(f"m_{r}, CASE WHEN v_{r} <= 0 THEN {MAX_PRIOR} ELSE least({MAX_PRIOR}, greatest(1.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) END AS w_{r}"
                       for r in RULES)
    scale = f"greatest({MIN_SCALE}, least({MAX_SCALE}, (fail_symbols + m_symbols * w_symbols) / (docs + w_symbols) / m_symbols))"
    return f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{common.WORD_CLASS}+') AS ws FROM documents),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t) x WHERE regexp_matches(line, '{common.WORD_CLASS}') GROUP BY doc_id),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p:p + {WINDOW - 1}]) AS c FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM t) x),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p FROM g WHERE c > 1) x CROSS JOIN (SELECT unnest(range(0, {WINDOW})) AS k) y GROUP BY doc_id),
c AS (SELECT t.doc_id, t.source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(ln.n_lines, 0) AS n_lines,
  coalesce(cov.n, 0) AS n_repeat_words FROM t LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} AS few_words, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS repeats,
  10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS dup_lines FROM c),
h AS (SELECT source, count(*) AS docs, {", ".join(f"sum({r}::BIGINT) AS fail_{r}" for r in RULES)} FROM f GROUP BY source),
p AS (SELECT {weight} FROM (SELECT {prior} FROM h) x),
v AS (SELECT source, {" AND ".join(ok)} AS host_ok, {scale} AS scale FROM h CROSS JOIN p),
r AS (SELECT f.*, host_ok, few_words OR repeats AS base_failed, 10 * n_symbols * scale > n_words AS symbols_failed
  FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbols_failed,
  NOT base_failed AND host_ok AND NOT symbols_failed AS kept, host_ok FROM r"""


SQL = _sql()
