import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import blocking as B
from weftline.operators import retrieval as S
from weftline.plans import linking as L

CHANNELS = ["nw", "nc", "ad"]


def planted(spark, seed=1):
    """Features of many records that share them, with ties, a country without an index and a record of a country of its own."""
    some = random.Random(seed)
    feats = lambda ids, where: [(i, where, ch, f"{ch}{some.randrange(12)}") for i in ids for ch in CHANNELS for _ in range(some.randrange(4))]
    index = feats([f"s{i}" for i in range(40)], "US") + feats([f"t{i}" for i in range(7)], "") + [("u", "IN", "nw", "nw1")]
    asked = feats([f"q{i}" for i in range(30)], "US") + feats([f"r{i}" for i in range(5)], "") + [("v", "FR", "nw", "nw1"), ("w", "US", "nw", "unseen"), ("w", "US", "nw", "nw3")]
    schema = "id string, country string, ch string, feat string"
    return tuple(spark.createDataFrame(rows, schema).distinct() for rows in (asked, index))


def as_sets(feats):
    each = F.struct("ch", "feat")
    of = lambda c: F.transform(F.filter("xs", lambda x: x["ch"] == c), lambda x: x["feat"])
    return feats.groupBy("id", "country").agg(F.collect_list(each).alias("xs")).select("id", "country", S.codes({c: of(c) for c in CHANNELS}).alias("codes"))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("q", "s", "country", "sc_nw", "sc_nc", "sc_ad", "comb", "rk")) for r in df.collect())


@pytest.mark.parametrize("shard", [1000, 9])
def test_sets_give_the_best_of_the_plain_join(spark, shard):
    asked, index = planted(spark)
    sizes = index.groupBy("country").agg(F.countDistinct("id").alias("n_index"))
    caps, wide = {"nw": 6, "nc": 8, "ad": 5}, {"nw": 30, "nc": 30, "ad": 30}
    plain = lambda c: B.keep_best(B.search(asked, index, B.vocabulary(index, sizes), c), CHANNELS, 4, 2)
    got = S.search_sets(as_sets(asked), as_sets(index), sizes, caps, 4, 2, shard=shard)
    assert rows_of(got) == rows_of(plain(caps)) != []
    first = plain(caps)
    strong = {r["q"] for r in first.groupBy("q").agg(F.max("comb").alias("b")).where("b >= 0.9").collect()}
    want = sorted([r for r in rows_of(first) if r[0] in strong] + [r for r in rows_of(plain(wide)) if r[0] not in strong])
    assert strong and rows_of(S.search_sets(as_sets(asked), as_sets(index), sizes, caps, 4, 2, wide, 0.9, shard)) == want


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), "CoGroup" in plan


def test_char4_queries_are_not_exchanged_by_shard(spark, data):
    assert exchanges(L.char4_topk(spark, data)) == (1, False)


def test_queries_of_all_channels_are_not_exchanged_by_shard(spark, data):
    assert exchanges(L.multi_channel_topk(spark, data)) == (1, False)


def test_best_entity_needs_no_other_pairs(spark, data):
    df = L.assign_best(spark, data)
    assert exchanges(df) == (2, False)
    assert df.groupBy("q").count().where("count > 1").count() == 0


def test_second_pass_runs_in_the_task_of_the_first(spark, data):
    assert exchanges(L.adaptive_second_pass(spark, data)) == (1, False)
