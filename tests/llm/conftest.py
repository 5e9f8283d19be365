import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_data import ODD, read  # noqa: E402

@pytest.fixture(scope="session")
def documents(spark):
    # a plan of its own: the plain read of the table must not come from this cache in tests that look at scans
    return read(spark).where("true").cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), i, "x", True, [i], "id")
            for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "n_words long, kept string, _row boolean, keys array<int>, id string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
