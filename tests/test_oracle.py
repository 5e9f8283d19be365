"""DuckDB oracle per SQL-expressible key at sf0.01 (the driver's correctness gate, locally).

A representative subset runs by default; ``LURESCAN_FULL_ORACLE=1`` runs every key.
"""

import os
import sys

import duckdb
import pytest

from paths import ROOT, SF_ORACLE

sys.path.insert(0, os.path.join(ROOT, "tools"))
import oracle_check as OC  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from lurescan.sources.tables import TABLES  # noqa: E402

SUBSET = ["message_features", "clean_email_table", "clean_date", "map_labels", "tokenize_words", "augment_text",
          "tfidf", "vocabulary_topk", "texts_to_sequences", "split_stratified", "knn_neighbours", "smote",
          "classification_report", "threshold_sweep", "score_chunks_any", "src_csv", "word_index_full"]
KEYS = sorted(E.oracle_sql()) if os.environ.get("LURESCAN_FULL_ORACLE") else SUBSET


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_ORACLE)
    srows, scols = OC.rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(E.oracle_sql()[key])
    drows, dcols = OC.rows_of(rel.columns, rel.fetchall())
    assert scols == dcols
    assert len(srows) == len(drows)
    bad = [(a, b) for a, b in zip(srows, drows) if not OC.close(a, b)]
    assert not bad, bad[:2]


def test_every_key_has_a_builder():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "doc_id" in df.columns
