import math
import os

from weftline.operators import blocking as B
from weftline.operators import context as C
from weftline.operators.model import feature_columns
from weftline.operators.transliteration import learn
from weftline.sources import tables as T
from weftline.streaming.lookup import candidates_of_stream

INDEX = [("s1", "US", "nw", f) for f in ("oak", "ridge")] + [("s2", "US", "nw", f) for f in ("oak", "hill")] + [("s3", "IN", "nw", "oak")]
QUERY = [("q1", "US", "nw", "oak"), ("q1", "US", "nw", "ridge"), ("q1", "US", "nw", "new"), ("q2", "IN", "nw", "oak"), ("q3", "US", "nw", "none")]


def inputs(spark):
    schema = "id string, country string, ch string, feat string"
    index = spark.createDataFrame(INDEX, schema)
    size = spark.createDataFrame([("US", 2), ("IN", 1)], "country string, n_index long")
    return spark.createDataFrame(QUERY, schema), index, B.vocabulary(index, size)


def test_cosine_counts_unseen_features_in_the_norm(spark):
    q, s, v = inputs(spark)
    got = {(r["q"], r["s"]): r["sc_nw"] for r in B.search(q, s, v, {"nw": 10}).collect()}
    oak, rare, unseen = math.log(3 / 2.5), math.log(3 / 1.5), math.log(3 / 0.5)
    qn, sn = math.sqrt(oak**2 + rare**2 + unseen**2), math.sqrt(oak**2 + rare**2)
    assert got[("q1", "s1")] == round((oak**2 + rare**2) / (qn * sn), 6) and ("q2", "s3") in got and ("q3", "s1") not in got
    capped = {(r["q"], r["s"]) for r in B.search(q, s, v, {"nw": 1}).collect()}
    assert capped == {("q1", "s1"), ("q2", "s3")}


def test_best_ties_and_second_pass(spark):
    rows = [("q", f"s{i}", "US", 0.5, 0.1 * i, 0.5) for i in range(6)]
    pairs = spark.createDataFrame(rows, "q string, s string, country string, sc_a double, sc_b double, comb double")
    got = {r["s"]: r["rk"] for r in B.keep_best(pairs, ["a", "b"], k=2, kc=1).collect()}
    assert got == {"s0": 0, "s1": 1, "s5": 99}
    q, s, v = inputs(spark)
    asked = q.select("id").distinct()
    again = {(r["q"], r["s"]) for r in B.with_second_pass(asked, q, s, v, {"nw": 1}, {"nw": 10}).collect()}
    assert again == {("q1", "s1"), ("q1", "s2"), ("q2", "s3")}


def test_margins_on_ties_and_single_pairs(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, 0.2), ("b", 4, 0.7)], "q string, s int, c double")
    got = {r["s"]: (r["rank_c"], round(r["margin_c"], 6)) for r in C.ranks_and_margins(df, ["c"]).collect()}
    assert got == {1: (1, 0.0), 2: (1, 0.0), 3: (3, -0.3), 4: (1, 0.7)}


def test_word_dictionary(spark):
    rows = [("laxmi stores", "लक्ष्मी stores"), ("lakshmi stores", "लक्ष्मी stores"), ("lakshmi sweets", "लक्ष्मी sweets"), ("a b c", "लक्ष्मी"), (None, "लक्ष्मी")]
    words, variants = learn(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    assert [tuple(r) for r in words.collect()] == [("लक्ष्मी", "lakshmi")] and [tuple(r) for r in variants.collect()] == [("laxmi", "lakshmi")]


def test_dropped_features(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "x")], "g_a int, f double, g_b double, t string")
    assert feature_columns(df, ["g_*"]) == ["f"]


def test_tsv_round_trip(spark, tmp_path):
    rows = [("1", 'a "quoted" \\ name', "", "US"), ("2", "b", "x", "")]
    df = spark.createDataFrame(rows, T.RECORD_SCHEMA)
    T.write_tsv(df, str(tmp_path / "t"))
    assert {tuple(r) for r in T.read_tsv(spark, str(tmp_path / "t")).collect()} == set(rows)


def test_stream_of_new_records(spark, tmp_path):
    q, s, v = inputs(spark)
    folder = str(tmp_path / "in")
    q.write.parquet(folder)
    stream = spark.readStream.schema(q.schema).parquet(folder)
    run = candidates_of_stream(stream, lambda batch: batch, s, v, {"nw": 10}, str(tmp_path / "out"), str(tmp_path / "check"))
    run.awaitTermination(120)
    assert os.path.exists(tmp_path / "out") and {(r["q"], r["s"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("q1", "s1"), ("q1", "s2"), ("q2", "s3")}
