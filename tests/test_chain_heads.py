"""Candidate pairs of chain heads are part of every query over pairs; the SQL holds them too (test_oracles compares the values)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", ["token_extra_missing", "group_support", "noise_rule", "merge_preds"])
def test_pairs_of_chain_heads_are_there(spark, data, name):
    assert QUERIES[name](spark, data).where("s like 'S1-H%'").limit(1).count() == 1


def test_chain_heads_are_scored_and_listed(spark, data, duck):
    scored = QUERIES["string_scores"](spark, data).select("s").distinct().toPandas()["s"]
    listed = entry.entry(spark).select("source1_entity_id").toPandas()["source1_entity_id"]
    heads = {r[0] for r in duck.execute("select entity_id from chain_heads").fetchall()}
    assert heads <= set(listed) and len(set(listed)) == len(listed) and heads & set(scored)
