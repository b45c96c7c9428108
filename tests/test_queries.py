"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from rankloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(pdf):
    clean = lambda v: None if v is None or v != v else round(float(v), 9) + 0.0 if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)
    return sorted(str([clean(v) for v in r]) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got, wanted = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert rows(got) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    value = __spark_entry__.entry(spark).first()[0]
    assert math.isfinite(value)
