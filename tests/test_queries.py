"""Every registered query with SQL against DuckDB, and the shape of the plans that matter."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from lodestone import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(frame):
    columns = sorted(frame.columns)
    return frame[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    got, wanted = plain(catalog.QUERIES[name](spark, SF).toPandas()), plain(oracle.sql(catalog.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(wanted.columns) and len(got) == len(wanted)
    assert got.equals(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_without_sql_runs(spark, name):
    """Queries that SQL can't express give rows, the same each time; their values are tested in test_engine.py."""
    runs = [plain(catalog.QUERIES[name](spark, SF).toPandas()) for _ in range(2)]
    assert len(runs[0]) > 0 and runs[0].equals(runs[1])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["qid", "id", "vector_score", "hybrid_score", "score", "rank"]


def explained(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    assert "CartesianProduct" not in explained(catalog.QUERIES["adjacent_blocks"](spark, SF))
    assert "NestedLoop" not in explained(catalog.QUERIES["adjacent_blocks"](spark, SF))
    assert "TakeOrderedAndProject" in explained(catalog.QUERIES["page_slice"](spark, SF)) or "GlobalLimit" in explained(catalog.QUERIES["page_slice"](spark, SF))
    scan = explained(catalog.QUERIES["manifest_totals"](spark, SF))
    assert "ReadSchema" in scan and "n_chars" not in scan.rsplit("ReadSchema", 1)[1]
