from weftline.operators import decide as D
from weftline.plans import scoring
from weftline.plans.linking import pairs


def test_none_and_mean_of_small_large_and_certain(spark):
    rows = [("a", 0.5), ("a", 0.2), *[("hot", 0.001 * (i % 7)) for i in range(3000)], ("sure", 1.0), ("sure", 0.3), ("zero", 0.0)]
    got = {r["s"]: r for r in D.none_and_mean(spark.createDataFrame(rows, "s string, p double"), "s").collect()}
    none = 1.0
    for i in range(3000):
        none *= 1 - 0.001 * (i % 7)
    assert got["hot"]["n"] == 3000 and abs(got["hot"]["p_none"] - none) < 1e-12 and abs(got["hot"]["mean"] - sum(0.001 * (i % 7) for i in range(3000))) < 1e-9
    assert abs(got["a"]["p_none"] - 0.4) < 1e-12 and abs(got["a"]["mean"] - 0.7) < 1e-12
    assert (got["sure"]["p_none"], got["zero"]["p_none"], got["zero"]["mean"]) == (0.0, 1.0, 0.0)


def test_poisson_binomial_has_every_entity(spark, data):
    best = scoring._best(spark, data).toPandas()
    got = scoring.poisson_binomial(spark, data).toPandas()
    assert dict(zip(got["s"], got["n"])) == best.groupby("s").size().to_dict() and got["n"].max() > 12
    assert len(best) == pairs(spark, data).select("q").distinct().count()
    for s, group in best.groupby("s"):
        row = got[got["s"] == s].iloc[0]
        assert abs(row["mean"] - group["p"].sum()) < 2e-6 and abs(row["p_none"] - (1 - group["p"]).prod()) < 2e-6
