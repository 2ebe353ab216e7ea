"""Every registered query against its SQL on the smallest given tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as driver  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    return repr(float(value) if not math.isnan(value) else None)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    result = driver.queries()[name](spark, SF)
    columns = sorted(result.columns)
    rows = sorted(tuple(comparable(r[c]) for c in columns) for r in result.collect())
    cursor = sql.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(comparable(r[i]) for i in order) for r in cursor.fetchall())
    assert rows == expected


@pytest.mark.parametrize("name", ["iforest_scores", "iforest_incremental", "legacy_scores"])
def test_scores_are_whole(spark, sql, name):
    rows = driver.queries()[name](spark, SF).collect()
    where = "WHERE ts >= TIMESTAMP '2024-01-21'" if name == "iforest_incremental" else ""
    assert len(rows) == sql.execute(f"SELECT count(*) FROM events {where}").fetchall()[0][0]
    assert all(0.0 <= r["anomaly_score"] <= 1.0 for r in rows)


def test_entry(spark):
    assert driver.entry(spark).count() == 20
