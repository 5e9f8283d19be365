"""Class rebalancing and the kNN vote (2.13 model_knn).

Draws are md5 keys of ``seed|label|i|...``; a draw picks a row by its rank
inside its class, so everything is an equi join on (label, rank).  The
draw rows are generated in blocks of at most ``DRAW_BLOCK`` rows spread over
tasks first, so a class needing billions of copies is never exploded by one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescan.operators.neighbors import knn
from lurescan.session import ensure_checkpoint_dir, scoped_cache
from lurescan.operators.ranking import rank_in_groups
from lurescan.sources.fixtures import hash48, hash_fraction

DRAW_BLOCK = 1_000_000
SYN_BASE = 2 ** 32


def _key(seed, *parts) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def class_needs(df: DataFrame, label_col: str) -> DataFrame:
    """(label, n, need): rows to add to reach the largest class."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return c.select(label_col, "n", (F.max("n").over(Window.partitionBy()) - F.col("n")).alias("need"))


def draws(needs: DataFrame, label_col: str) -> DataFrame:
    """(label, n, i) for i in 1..need, generated block by block across tasks."""
    blk = (needs.where(F.col("need") > 0)
           .select(label_col, "n", "need",
                   F.explode(F.sequence(F.lit(0).cast("long"),
                                        (F.ceil(F.col("need") / DRAW_BLOCK) - 1).cast("long"))).alias("blk"))
           .repartition(label_col, "blk"))
    lo = F.col("blk") * DRAW_BLOCK + 1
    hi = F.least(F.col("need"), (F.col("blk") + 1) * DRAW_BLOCK)
    return blk.select(label_col, "n", F.explode(F.sequence(lo, hi)).alias("i"))


def _ranked(df: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return rank_in_groups(df, [label_col], [id_col])


def oversample_random(df: DataFrame, id_col: str, label_col: str, seed: int = 42) -> DataFrame:
    """Originals (copy 0) plus copies drawn with replacement until every class has the majority's size."""
    needs = class_needs(df, label_col)
    d = draws(needs, label_col)
    d = d.select(label_col, "i", (F.pmod(hash48(_key(seed, F.col(label_col), F.col("i"))), F.col("n")) + 1)
                 .alias("rank"))
    copies = d.join(_ranked(df, id_col, label_col), [label_col, "rank"]).drop("rank")
    copies = copies.withColumnRenamed("i", "copy")
    orig = df.withColumn("copy", F.lit(0).cast("long"))
    return orig.unionByName(copies.select(*orig.columns))


def synthetic_id(label: Column, i: Column) -> Column:
    """A negative id of (label, draw): distinct while labels are below 2^31 and draws below 2^32."""
    ok = label.between(0, 2 ** 31 - 2) & (i < F.lit(SYN_BASE))
    return F.when(ok, -((label.cast("long") + 1) * F.lit(SYN_BASE) + i)).otherwise(
        F.raise_error(F.lit("synthetic ids need labels of 0 to 2^31 - 2 and fewer than 2^32 draws a class")).cast("long"))


def smote(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5, seed: int = 42,
          block_rows: int | None = None) -> DataFrame:
    """Synthetic rows x + u * (nn - x) with nn one of x's k same-class neighbours (Euclidean).

    Returns (id, label, vec, base_id, nbr_id, u) for the synthetic rows only.
    A class that must grow needs more than k rows; otherwise a ValueError says so.
    """
    ensure_checkpoint_dir(df.sparkSession)
    needs = scoped_cache(class_needs(df, label_col))
    small = needs.where((F.col("need") > 0) & (F.col("n") <= k)).orderBy(label_col).first()  # one row
    if small is not None:
        raise ValueError(f"class {small[label_col]!r} has {small['n']} rows; {k} neighbours need at least {k + 1}")
    d = draws(needs, label_col)
    kk = F.lit(k)
    d = d.select(label_col, "i",
                 (F.pmod(hash48(_key(seed, F.col(label_col), F.col("i"), "b")), F.col("n")) + 1).alias("rank"),
                 (F.pmod(hash48(_key(seed, F.col(label_col), F.col("i"), "n")), kk) + 1).alias("nbr_rank"),
                 hash_fraction(F.lit(str(seed)), F.col(label_col), F.col("i"), F.lit("u")).alias("u"))
    vecs = df.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"), label_col)
    # only classes that need rows take part, and only drawn rows look for neighbours
    vecs = vecs.join(F.broadcast(needs.where("need > 0").select(label_col)), label_col)  # one row a class
    base = d.join(_ranked(vecs, "_id", label_col).select(label_col, "rank", F.col("_id").alias("base_id"),
                                                         F.col("_v").alias("base_v")), [label_col, "rank"])
    base = base.checkpoint(eager=True)  # read for its ids and again for its vectors
    asked = vecs.join(base.select(F.col("base_id").alias("_id")).distinct(), "_id", "left_semi")
    nn = knn(asked, vecs, k, id_col="_id", vec_col="_v", metric="euclidean", group_col=label_col,
             block_rows=block_rows).select(F.col("qid").alias("base_id"), F.col("rank").alias("nbr_rank"),
                                            F.col("nid").alias("nbr_id"))
    s = base.join(nn, ["base_id", "nbr_rank"]).join(
        vecs.select(F.col("_id").alias("nbr_id"), F.col("_v").alias("nbr_v")), "nbr_id")
    vec = F.zip_with("base_v", "nbr_v", lambda x, y: x + F.col("u") * (y - x))
    return s.select(synthetic_id(F.col(label_col), F.col("i")).alias(id_col), label_col, vec.alias(vec_col),
                    "base_id", "nbr_id", "u")


def with_synthetic(df: DataFrame, syn: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Originals and synthetic rows, written once: the editing steps read them many times."""
    orig = df.select(id_col, label_col, F.col(vec_col).cast("array<double>").alias(vec_col))
    ensure_checkpoint_dir(df.sparkSession)
    return orig.unionByName(syn.select(id_col, label_col, vec_col)).checkpoint(eager=True)


def tomek_links(df: DataFrame, id_col: str, vec_col: str, label_col: str, block_rows: int | None = None) -> DataFrame:
    """Rows left after removing both ends of every Tomek link (mutual 1-NN of different classes)."""
    nn = knn(df, df, 1, id_col=id_col, vec_col=vec_col, metric="euclidean", block_rows=block_rows)
    lab = df.select(F.col(id_col).alias("qid"), F.col(label_col).alias("ql"))
    a = nn.select("qid", "nid").join(lab, "qid")
    b = a.select(F.col("qid").alias("nid"), F.col("nid").alias("qid"), F.col("ql").alias("nl"))
    links = a.join(b, ["qid", "nid"]).where(F.col("ql") != F.col("nl")).select(F.col("qid").alias(id_col))
    return df.join(links, id_col, "left_anti")


def edited_nn(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 3,
              block_rows: int | None = None) -> DataFrame:
    """Rows whose k nearest neighbours all share their class (every class edited)."""
    nn = knn(df, df, k, id_col=id_col, vec_col=vec_col, metric="euclidean", block_rows=block_rows)
    lab = df.select(F.col(id_col).alias("nid"), F.col(label_col).alias("nl"))
    own = df.select(F.col(id_col).alias("qid"), F.col(label_col).alias("ql"))
    agree = nn.join(lab, "nid").join(own, "qid").groupBy("qid").agg(
        F.min((F.col("nl") == F.col("ql")).cast("int")).alias("ok"))
    keep = agree.where(F.col("ok") == 1).select(F.col("qid").alias(id_col))
    return df.join(keep, id_col, "left_semi")


def knn_vote(test: DataFrame, train: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
             label_col: str = "label", metric: str = "cosine", weights=("uniform",)) -> DataFrame:
    """(id, pred_<weights>...): votes of the k nearest training rows, one neighbour search for all.

    ``uniform`` counts votes; ``distance`` weighs them by 1/distance, where a
    zero distance takes the whole vote.  Ties go to the smallest label.
    """
    weights = [weights] if isinstance(weights, str) else list(weights)
    nn = knn(test, train, k, id_col=id_col, vec_col=vec_col, metric=metric, exclude_self=False)
    j = nn.join(train.select(F.col(id_col).alias("nid"), F.col(label_col).alias("nl")), "nid")
    zero = F.min("dist").over(Window.partitionBy("qid")) == 0  # k rows per query
    w_dist = F.when(zero, (F.col("dist") == 0).cast("double")).otherwise(F.lit(1.0) / F.col("dist"))
    j = j.withColumn("w_uniform", F.lit(1.0)).withColumn("w_distance", w_dist)
    votes = j.groupBy("qid", "nl").agg(*[F.sum(f"w_{w}").alias(f"s_{w}") for w in weights])
    best = votes.groupBy("qid").agg(*[F.max_by("nl", F.struct(F.col(f"s_{w}"), -F.col("nl"))).cast("int")
                                      .alias(f"pred_{w}") for w in weights])
    return best.withColumnRenamed("qid", id_col)
