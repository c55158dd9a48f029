from collections import Counter

from weftline.operators.hot_keys import eager_join_aggregate, hot_keys, per_key, per_key_states

ROWS = [("a", "US", f"r{i % 7}", float(i)) for i in range(40)] + [("b", "US", "r1", None), ("b", None, None, 2.0), (None, "FR", "r2", 1.0), (None, "FR", "r2", 1.0)]


def test_counts_distinct_and_best_of_each_key(spark):
    df = spark.createDataFrame(ROWS, "n string, v string, c1 string, top double")
    got = {(r["key_column"], r["key_value"]): (r["n_rows"], r["n_values"], r["best"]) for r in per_key(df, ["n", "v"], "c1", "top").collect()}
    assert got == {("n", "a"): (40, 7, 39.0), ("n", "b"): (2, 1, 2.0), ("v", "US"): (41, 7, 39.0), ("v", "FR"): (2, 1, 1.0)}


def test_share_counts_null_keys_in_the_total(spark):
    df = spark.createDataFrame(ROWS, "n string, v string, c1 string, top double")
    assert {(r["key_column"], r["key_value"]) for r in hot_keys(df, ["n", "v"], "top", 0.9).collect()} == {("n", "a"), ("v", "US")}
    assert hot_keys(df.limit(0), ["n", "v"], "top", 0.03).count() == 0


def test_eager_aggregation_equals_the_joined_rows(spark):
    left = [(f"k{i % 5}", f"g{i % 3}", i) for i in range(50)] + [(None, "g0", 1)]
    right = [(f"k{i % 4}", float(i)) for i in range(23)] + [(None, 1.0)]
    l, r = spark.createDataFrame(left, "k string, g string, x int"), spark.createDataFrame(right, "k string, x double")
    got = {row["g"]: tuple(row)[1:] for row in eager_join_aggregate(l, r.withColumnRenamed("x", "w"), "k", ["g"], ["x"], ["w"], ["x"]).collect()}
    want = {}
    for g in {x[1] for x in left}:
        met = [(a, b) for a in left for b in right if a[1] == g and a[0] is not None and a[0] == b[0]]
        want[g] = (len(met), sum(a[2] for a, _ in met), sum(b[1] for _, b in met), max(a[2] for a, _ in met))
    assert got == want


def test_one_key_with_most_rows_shrinks_before_the_shuffle(spark):
    df = spark.range(20000).selectExpr("if(id % 10 < 9, 'hot', cast(id as string)) as k", "cast(id % 50 as string) as c1", "1.0D as s")
    got = {r["key_value"]: r["n_rows"] for r in per_key(df, ["k"], "c1", "s").collect()}
    assert got["hot"] == 18000 and Counter(got.values())[1] == 2000


def test_several_join_columns_and_asked_keys_only(spark):
    df = spark.createDataFrame(ROWS, "n string, v string, c1 string, top double")
    asked = spark.createDataFrame([("n", "a"), ("v", "FR"), ("v", "none such"), ("n", None)], "key_column string, key_value string")
    got = {(r["key_column"], r["key_value"]): (r["n_rows"], r["best"]) for r in per_key_states(df, ["n", "v"], "top", asked).collect()}
    assert got == {("n", "a"): (40, 39.0), ("v", "FR"): (2, 1.0)}
