"""Every query of the subpackage on the smallest tables: columns, no repeated rows, the SQL where there is one."""

import os

import duckdb
import pytest

from weftline.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["entry_a", "entry_b"], "p2_found": ["entity_a", "entity_b"], "p3_found": ["entity_a", "entity_b"], "p4_found": ["entry_a", "entry_b"], "p6_found": ["source1_entity_id", "entity_id"],
    "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert QUERIES[name](spark, data).columns == COLUMNS[name] if name in ("p8_ids", "p9_found") else sorted(rows[0].asDict()) == sorted(COLUMNS[name])
    keys = [tuple(map(str, r)) for r in rows]
    assert len(keys) == len(set(keys)) > 0
    if COLUMNS[name][0].endswith("_a"):
        assert all(r[0] < r[1] for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(SQL[name]).df()
    order = sorted(want.columns)
    assert sorted(map(tuple, got[order].astype(str).values)) == sorted(map(tuple, want[order].astype(str).values))


def test_entities_of_one_record_are_at_most_one(spark, data):
    rows = QUERIES["p6_found"](spark, data).collect()
    assert len({r["entity_id"] for r in rows}) == len(rows)
