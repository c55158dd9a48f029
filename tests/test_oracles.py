"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL, QUERIES = entry.oracle_sql(), entry.queries()
CORE = [n for n in QUERIES if QUERIES[n].__module__.startswith("weftline.plans")]


def plain(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False, name=None):
        out.append(tuple(None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in row))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_equals_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL and n not in ("self_training", "linked_records")])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_entry_lists_every_source1_row_once(spark, data):
    rows = entry.entry(spark).collect()
    ids = [r["source1_entity_id"] for r in rows]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{data}/source1.parquet").select("entity_id").distinct().count()
    listed = [x for r in rows for x in r["matched_entity_ids"].split(",") if x]
    assert len(listed) == len(set(listed))
