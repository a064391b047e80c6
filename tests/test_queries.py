"""Every registered query of the engine against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from scorefabric.plans import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind in "iuf":
            df[c] = df[c].astype(float).round(5) + 0.0
        elif df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype.kind == "O":
            df[c] = df[c].map(lambda v: None if v is None or v != v else v)
    return sorted(map(str, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, duck, name):
    assert canon(Q.QUERIES[name](spark, DIR).toPandas()) == canon(duck.sql(Q.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_gives_rows(spark, name):
    assert len(Q.QUERIES[name](spark, DIR).toPandas()) > 0


def test_nothing_needs_the_optional_part():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "scorefabric"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "scorefabric.llm" not in p.read_text(), p
