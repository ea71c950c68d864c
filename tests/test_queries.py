"""Every query with SQL, compared with DuckDB at the smallest scale."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as spark_entry  # noqa: E402
from check_oracles import canonical  # noqa: E402

DATA = os.environ.get("LEDGERLENS_TESTDATA", "/root/testdata/sf0.001")
ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not mounted")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = spark_entry.queries()[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, cursor.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(spark_entry.queries())
