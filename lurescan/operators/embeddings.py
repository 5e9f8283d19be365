"""Word vectors and the embedding matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescan.operators.joins import lookup_join
from lurescan.sources.fixtures import hash48, hash_fraction
from lurescan.sources.tables import table


def word_vectors(spark: SparkSession, sf: str, terms: DataFrame, coverage: float = 0.75) -> DataFrame:
    """(term, vec): a word-vector table Spark derives from ``embeddings``.

    Three terms in four (by an md5 draw) get the embedding row picked by
    another md5 draw; the rest have no vector, as words missing from a
    pre-trained file.
    """
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n_emb = emb.count()
    t = (terms.select("term")
         .where(hash_fraction(F.lit("w"), F.col("term")) < coverage)
         .withColumn("vec_id", F.pmod(hash48(F.concat(F.lit("v|"), F.col("term"))), F.lit(n_emb))))
    return lookup_join(t, emb, "vec_id", how="inner").select("term", F.col("embedding").alias("vec"))


def embedding_matrix(index: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(idx, term, vec, has_vector): a vector per vocabulary word, zeros when missing, row 0 zero."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    rows = (lookup_join(index.select("idx", "term"), vectors, "term", how="left")
            .select("idx", "term", F.coalesce(F.col("vec"), zero).alias("vec"),
                    F.col("vec").isNotNull().alias("has_vector")))
    pad = index.sparkSession.range(1).select(F.lit(0).cast("long").alias("idx"),
                                            F.lit(None).cast("string").alias("term"),
                                            zero.alias("vec"), F.lit(False).alias("has_vector"))
    return pad.unionByName(rows)
