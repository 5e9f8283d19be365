"""Entity counts per message, re-aimed from a statistical NER model.

Pattern kinds (MONEY, DATE, CARDINAL, PERCENT, QUANTITY, TIME, URL, EMAIL,
PHONE) are regex counts inside the row.  Name kinds (PERSON, ORG, GPE) are
matches of whole names, of any number of words, against a gazetteer table that
Spark derives from the given tables.  The gazetteer becomes a trie of its names'
prefixes, one table a level; a text's positions are walked through it by one
join a level (broadcast only below a checked size), and positions whose prefix
is in no name leave at the first level that misses them.  Of the names that
begin at a position the longest counts, and from the left no name counts inside
another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescan.operators.joins import lookup_join, small_enough
from lurescan.session import scoped_cache
from lurescan.sources.tables import table

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"

# regex per pattern kind; written so that Java and RE2 read them the same way
PATTERNS = {
    "MONEY": "[$€£][0-9][0-9,]*(\\.[0-9]+)?|[0-9][0-9,]*(\\.[0-9]+)? ?(dollars|euros|pounds|USD|EUR|GBP)",
    "DATE": f"[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|({MONTHS}) [0-9]{{1,2}}",
    "CARDINAL": "[0-9]+",
    "PERCENT": "[0-9]+(\\.[0-9]+)? ?(%|percent)",
    "QUANTITY": "[0-9]+(\\.[0-9]+)? ?(kg|km|cm|mm|lbs|lb|miles|ml)",
    "TIME": "[0-9]{1,2}:[0-9]{2}( ?(am|pm|AM|PM))?",
    "URL": "http[^ \\t\\n\\r\\f]+|www\\.[^ \\t\\n\\r\\f]+",
    "EMAIL": "[^ \\t\\n\\r\\f]+@[^ \\t\\n\\r\\f]+",
    "PHONE": "\\([0-9]{3}\\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}",
}
# the same e-mail matches, tried only where a run of non-spaces begins: linear on long runs without '@'
LINEAR_EMAIL = "(?<![^ \\t\\n\\r\\f])" + PATTERNS["EMAIL"]
NAME_KINDS = ("PERSON", "ORG", "GPE")
EMAIL_KINDS = ("PERSON", "ORG", "MONEY", "DATE", "GPE", "CARDINAL", "PERCENT", "QUANTITY")
SMS_KINDS = EMAIL_KINDS + ("TIME", "URL", "EMAIL", "PHONE")

TOKEN = "[\\p{L}\\p{N}#]+"


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """(name, kind): lower-cased names of regions/nations (GPE), suppliers (ORG), customers (PERSON)."""
    def part(t, col, kind):
        return table(spark, sf, t).select(F.lower(F.col(col)).alias("name"), F.lit(kind).alias("kind"))
    g = (part("region", "r_name", "GPE").unionByName(part("nation", "n_name", "GPE"))
         .unionByName(part("supplier", "s_name", "ORG")).unionByName(part("customer", "c_name", "PERSON")))
    # one kind per name: the first in PERSON, ORG, GPE order
    rank = F.when(F.col("kind") == "PERSON", 0).when(F.col("kind") == "ORG", 1).otherwise(2)
    return (g.groupBy("name").agg(F.min(F.struct(rank.alias("r"), F.col("kind"))).alias("m"))
            .select("name", F.col("m.kind").alias("kind")))


def name_trie(gaz: DataFrame) -> DataFrame:
    """(prefix, words, kind): every prefix of the names' words; ``kind`` where it is a whole name, else null.

    Names are cut into words as texts are.  A name of several kinds has the
    first in the order PERSON, ORG, GPE; names without a word match nothing.
    """
    words = F.regexp_extract_all(F.lower("name"), F.lit(TOKEN), 0)
    rank = F.array_position(F.array(*[F.lit(k) for k in NAME_KINDS]), F.col("kind"))
    each = (gaz.select(words.alias("w"), "kind").where(F.size("w") > 0)
            .select("w", "kind", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("words")))
    whole = F.when(F.size("w") == F.col("words"), F.struct(rank.alias("r"), F.col("kind")))
    return (each.select(F.array_join(F.slice("w", 1, F.col("words")), " ").alias("prefix"), "words", whole.alias("k"))
            .groupBy("prefix", "words").agg(F.min("k").alias("k")).select("prefix", "words", F.col("k.kind").alias("kind")))


def name_matches(df: DataFrame, gaz: DataFrame, id_col: str, tokens_col: str = "_tok") -> DataFrame:
    """(id, at, words, kind): the longest name that begins at each position (from 1) of a row's tokens.

    First words too many to be broadcast are first cut to those that the rows hold,
    so that positions are not shuffled to names that occur nowhere.
    """
    trie = scoped_cache(name_trie(gaz))
    depth = trie.agg(F.max("words")).first()[0] or 0  # words of the longest name
    # outer: a filter on the size would be pushed below and work the tokens out again
    at = F.explode_outer(F.when(F.size(tokens_col) > 0, F.sequence(F.lit(1), F.size(tokens_col))))
    walk = (df.select(id_col, tokens_col, at.alias("at")).where(F.col("at").isNotNull())
            .select(id_col, "at", F.slice(tokens_col, F.col("at"), F.lit(max(1, depth))).alias("_ahead"),
                    F.lit(True).alias("_alive"), F.lit(None).cast("int").alias("words"), F.lit(None).cast("string").alias("kind")))
    for level in range(1, depth + 1):
        prefix = F.when(F.col("_alive") & (F.size("_ahead") >= level), F.array_join(F.slice("_ahead", 1, level), " "))
        here = trie.where(F.col("words") == level).select(F.col("prefix").alias("_prefix"), F.col("kind").alias("_kind"))
        if level == 1 and not small_enough(here):
            held = df.select(F.explode(F.array_distinct(tokens_col)).alias("_prefix")).distinct()
            here = here.join(held, "_prefix", "left_semi")
        walk = lookup_join(walk.withColumn("_prefix", prefix), here.withColumn("_in", F.lit(True)), "_prefix", how="left")
        walk = walk.select(id_col, "at", "_ahead", F.coalesce("_in", F.lit(False)).alias("_alive"),
                           F.when(F.col("_kind").isNotNull(), level).otherwise(F.col("words")).alias("words"),
                           F.coalesce("_kind", "kind").alias("kind")).where(F.col("_alive") | F.col("kind").isNotNull())
    return walk.where(F.col("kind").isNotNull()).select(id_col, "at", "words", "kind")


def name_counts(df: DataFrame, gaz: DataFrame, kinds: list[str], id_col: str) -> DataFrame:
    """(id, a count a kind) of the names in a row's tokens, from the left, none inside another one."""
    found = name_matches(df, gaz, id_col).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("at", "words", "kind"))).alias("_m"))
    start = F.struct(F.lit(0).alias("end"), *[F.lit(0).cast("long").alias(k) for k in kinds])

    def take(state, m):
        free = m["at"] >= state["end"]
        return F.struct(F.when(free, m["at"] + m["words"]).otherwise(state["end"]).alias("end"),
                        *[(state[k] + F.when(free & (m["kind"] == k), 1).otherwise(0)).cast("long").alias(k) for k in kinds])

    return found.select(id_col, F.aggregate("_m", start, take).alias("_s")).select(id_col, *[F.col("_s")[k].alias(k) for k in kinds])


def entity_counts(df: DataFrame, gaz: DataFrame, kinds=SMS_KINDS, id_col: str = "msg_id",
                  text_col: str = "text", extra: list | None = None) -> DataFrame:
    """Entity counts per row; ``extra`` columns (e.g. other features of the same text)
    are computed in the same projection and carried along."""
    pattern_kinds = [k for k in kinds if k in PATTERNS]
    name_kinds = [k for k in kinds if k in NAME_KINDS]
    extra = extra or []
    base = df.select(
        id_col,
        *extra,
        *[F.regexp_count(F.col(text_col), F.lit(LINEAR_EMAIL if k == "EMAIL" else PATTERNS[k])).cast("long").alias(k) for k in pattern_kinds],
        F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), 0).alias("_tok"),
    )
    if not name_kinds:
        return base.drop("_tok")
    counts = name_counts(base.select(id_col, "_tok"), gaz, name_kinds, id_col)
    out = base.drop("_tok").join(counts, id_col, "left")
    cols = [id_col] + [c for c in out.columns if c not in kinds and c != id_col] + [F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) if k in name_kinds else F.col(k)
                       for k in kinds]
    return out.select(*cols)


def oracle_sql(kinds) -> str:
    """DuckDB twin over ``documents`` keyed by doc_id."""
    pats = [k for k in kinds if k in PATTERNS]
    names = [k for k in kinds if k in NAME_KINDS]
    def pat_sql(p):
        return p.replace("'", "''")
    gaz = ("gaz0 AS (SELECT lower(r_name) AS name, 'GPE' AS kind, 2 AS r FROM region "
           "UNION ALL SELECT lower(n_name), 'GPE', 2 FROM nation "
           "UNION ALL SELECT lower(s_name), 'ORG', 1 FROM supplier "
           "UNION ALL SELECT lower(c_name), 'PERSON', 0 FROM customer), "
           "gaz AS (SELECT w, arg_min(kind, r) AS kind FROM (SELECT regexp_extract_all(name, '[\\p{L}\\p{N}#]+') AS w, kind, r FROM gaz0) x "
           "WHERE len(w) > 0 GROUP BY w)")
    toks = ("tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}#]+') AS t FROM documents), "
            "grams AS (SELECT doc_id, i AS pos, n, t[i:i + n - 1] AS w FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tk) x, "
            "(SELECT DISTINCT len(w) AS n FROM gaz) s WHERE i + n - 1 <= len(t)), "
            "longest AS (SELECT g.doc_id, g.pos, max(n) AS n, arg_max(z.kind, n) AS kind FROM grams g JOIN gaz z ON g.w = z.w GROUP BY ALL), "
            "taken AS (SELECT doc_id, list_reduce(list({'e': pos + n, 'p': pos, 'k': [kind]} ORDER BY pos), "
            "lambda a, b: CASE WHEN b.p >= a.e THEN {'e': b.e, 'p': b.p, 'k': list_concat(a.k, b.k)} ELSE a END).k AS ks FROM longest GROUP BY doc_id), "
            "hits AS (SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, unnest(ks) AS kind FROM taken) x GROUP BY ALL)")
    sel = ["d.doc_id"]
    for k in kinds:
        if k in PATTERNS:
            sel.append(f"CAST(len(regexp_extract_all(d.text, '{pat_sql(PATTERNS[k])}')) AS BIGINT) AS {k}")
        else:
            sel.append(f"CAST(coalesce((SELECT n FROM hits h WHERE h.doc_id = d.doc_id AND h.kind = '{k}'), 0) "
                       f"AS BIGINT) AS {k}")
    if not names:
        return f"SELECT {', '.join(sel)} FROM documents d"
    return f"WITH {gaz}, {toks} SELECT {', '.join(sel)} FROM documents d"
