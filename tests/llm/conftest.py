import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs with columns whose names the operators use themselves."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars", "1 as n", "'x' as digest", "2 as size", "'y' as key", "0 as piece", "7 as shard", "'z' as _salt", "3 as doc", "4 as h")

    return make
