"""Every query with SQL gives the rows that DuckDB gives on the smallest tables; the others run."""

from pathlib import Path

import duckdb
import pytest

from corpusloom.queries import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value) if isinstance(value, bool) else value


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return db


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, FOLDER)
    rows = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    sql = all_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted(str([plain(r[k]) for k in order]) for r in result.fetchall())
