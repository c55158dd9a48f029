from weftline.operators.sampling import sample_keys, sample_rows, shuffled


def test_samples_are_the_same_however_rows_are_spread(spark):
    df = spark.range(2000).selectExpr("id % 100 as k", "id as v").union(spark.sql("select cast(null as long) as k, 1L as v"))
    a = {tuple(r) for r in sample_keys(df, "k", 7).collect()}
    assert a == {tuple(r) for r in sample_keys(df.repartition(13), "k", 7).collect()} and len({k for k, _ in a}) == 7 and len(a) == 140
    assert {tuple(r) for r in sample_rows(df, "k", 0.3).collect()} == {tuple(r) for r in sample_rows(df.repartition(5), "k", 0.3).collect()}
    assert sample_keys(df.limit(0), "k", 3).count() == 0 and sample_rows(df, "k", 1.0).count() == 2000
    assert [r["v"] for r in shuffled(df.where("k is not null"), "v").collect()] == [r["v"] for r in shuffled(df.where("k is not null").repartition(3), "v").collect()]
