import duckdb
import pytest

import __spark_entry__ as entry
import check

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
FAST = [n for n in QUERIES if n.startswith(("metric", "leaderboard", "champion", "folds", "diagnostics_c", "error", "predictions", "scan_p"))]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", [n for n in FAST if n in ORACLES][::3])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLES[name])
    assert check.rows_of(df.columns, df.collect()) == check.rows_of([x[0] for x in cursor.description], cursor.fetchall())
