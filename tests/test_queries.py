"""Every registered query of this package that has SQL, against DuckDB at sf0.001."""

import duckdb
import pytest

from inkmill.plans.queries import QUERIES, SQL
from tests.oracle import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(db, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["quality_reports", "quality_issues"])
def test_quality_of_halves_and_nulls(spark, tmp_path, name):
    """Averages that end in 5 (in binary at, below or above a half), averages over 1000, no text, ids that repeat or are null."""
    at = lambda words, letters: " ".join(["x" * (letters // words + 1)] * (letters % words) + ["y" * (letters // words)] * (words - letters % words))
    averages = [(4, 5), (4, 7), (8, 10), (20, 23), (20, 33), (20, 37), (20, 39), (4, 61), (4, 63), (20, 301), (20, 303), (60, 903)]
    texts = [*(at(*a) for a in averages), "xy" * 1001, None, "", "\n"]
    rows = [*enumerate(texts), (None, "null id"), (None, None), (100, "a b"), (100, "c\nd\nc\ne\nc\nf\nc\ng"), (100, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(QUERIES[name](spark, str(tmp_path))) == sql_rows(db, SQL[name])
