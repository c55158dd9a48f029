from weftline.operators import decide as D
from weftline.operators.pair_features import number_features
from pyspark.sql import functions as F


def test_house_numbers_of_the_fixture(spark):
    df = spark.createDataFrame([(["12", "7"], ["7"]), ([], ["7"]), (["7"], ["7" * 30])], "q array<string>, s array<string>")
    a, b, c = df.select(*[x.alias(n) for n, x in number_features(F.col("q"), F.col("s")).items()]).collect()
    assert (a["num_s0_in_q"], a["num_first_eq"], a["num_best_ed"], a["num_jacc"], a["num_len_diff"], a["num_best_rel"]) == (1, 0, 0, 0.5, -1, 0.0)
    assert round(a["num_first_abs"], 6) == round(__import__("math").log(6), 6) and (b["num_q"], b["num_s"], b["num_len_diff"], b["num_best_rel"]) == (0, 1, -1, -1.0)
    assert c["num_len_diff"] == 17


def test_addresses_close(spark):
    rows = [("a b c", "a b c"), ("a b", "a b c"), ("neuve lille", "nueve lille"), ("neuve lille", "haute lille"), ("rue lille", "rua lille"), ("neuve x", "nueve x y z w"), ("neuve x", "nueve p q r s"), ("", "a")]
    df = spark.createDataFrame([(x.split(), y.split()) for x, y in rows], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(D.address_close(F.col("x"), F.col("y"))).collect()] == [True, True, False, False, False, False, False, True]
    near = spark.createDataFrame([("victor lille".split(), "victpr lille".split())], "x array<string>, y array<string>")
    assert near.select(D.address_close(F.col("x"), F.col("y"))).first()[0]


def test_noise_pairs(spark):
    side = ["core array<string>", "legal int", "words array<string>", "number string"]
    schema = "q string, s string, q_country string, " + ", ".join(f"{p}_{c}" for p in "qs" for c in side)
    base = dict(q_country="France", q_core=["dupont", "fils"], q_legal=0, q_words=["rue", "neuve"], q_number="9", s_core=["dupont"], s_legal=3, s_words=["rue", "neuve"], s_number="9")
    cases = {
        "fits": {}, "other country": {"q_country": "US"}, "null country": {"q_country": None}, "other number": {"s_number": "8"}, "no number": {"q_number": "", "s_number": ""}, "legal forms": {"q_legal": 2}, "no French word": {"q_core": ["dupont", "services"]},
        "with services": {"q_core": ["dupont", "services", "groupe"]}, "other word": {"q_core": ["dupont", "fils", "bois"]}, "swap": {"s_core": ["dupont", "bois"]}, "swap of compagnie": {"s_core": ["dupont", "bois"], "q_core": ["dupont", "compagnie"]},
        "compagnie": {"q_core": ["dupont", "compagnie"]}, "two lacking": {"s_core": ["dupont", "bois", "chaud"]}, "b is bis": {"q_words": ["b", "rue"], "s_words": ["bis", "rue"]}, "generic only": {"q_words": ["rue"]}, "no words": {"q_words": []}, "nothing extra": {"q_core": ["dupont"]},
    }
    order = ["q", "s", "q_country", *[f"{p}_{c.split()[0]}" for p in "qs" for c in side]]
    rows = [tuple(({"q": name, "s": "e"} | base | change)[c] for c in order) for name, change in cases.items()]
    rows += [tuple(({"q": "ambiguous", "s": s} | base)[c] for c in order) for s in ("e1", "e2")]
    got = {r["q"] for r in D.noise_pairs(spark.createDataFrame(rows, schema), spark.createDataFrame([("rue",)], "t string")).collect()}
    assert got == {"fits", "with services", "swap", "compagnie", "b is bis"}
    assert D.noise_pairs(spark.createDataFrame([], schema), spark.createDataFrame([], "t string")).count() == 0


def test_best_k_with_true_pairs_outside():
    assert D.best_k([0.6, 0.4]) >= D.best_k([0.6, 0.4], extra_true=0.0) and D.best_k([], 0.25, 1.0) == 0 and D.best_k([0.3], extra_true=3.0) == 1
