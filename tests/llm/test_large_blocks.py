from pyspark.sql import functions as F

from weftline.llm import blocks
from weftline.llm.names import Name
from weftline.llm.variants import _may, candidate_pairs


def test_every_pair_of_a_large_block_once(spark):
    rows = [("hot", f"f{i:03d}", 0) for i in range(150)] + [("cold", "f000", 0), ("cold", "f001", 0), ("one", "f002", 0)]
    got = [tuple(r) for r in blocks.every_pair(spark.createDataFrame(rows, blocks.SCHEMA), part=16).collect()]
    assert len(got) == len(set(got)) and set(got) == {(f"f{i:03d}", f"f{j:03d}") for j in range(150) for i in range(j)}


def test_bare_forms_meet_all_and_whole_ones_don_t_meet_each_other(spark):
    rows = [("k", f"w{i:02d}", blocks.WHOLE) for i in range(40)] + [("k", f"b{i}", blocks.BARE) for i in range(5)] + [("none", "w01", blocks.WHOLE), ("none", "w02", blocks.WHOLE)]
    got = [tuple(r) for r in blocks.every_pair(spark.createDataFrame(rows, blocks.SCHEMA), part=4).collect()]
    want = {(f"b{i}", f"w{j:02d}") for i in range(5) for j in range(40)} | {(f"b{i}", f"b{j}") for j in range(5) for i in range(j)}
    assert len(got) == len(want) and set(got) == want
    assert blocks.every_pair(spark.createDataFrame([], blocks.SCHEMA)).count() == 0


def test_a_short_form_meets_every_full_form_of_a_large_block(spark):
    full = [Name(proper=(f"k{a}{b}{c}ul", "plagostur"), trade="bakery").key() for a in "aeiou" for b in "bdgmt" for c in "aeo"]
    short = Name(proper=("plagostur",), proper_initial="k", trade="bakery").key()
    got = {tuple(r) for r in candidate_pairs(spark.createDataFrame([(f,) for f in [*full, short]], "form string")).collect()}
    assert {tuple(sorted((short, f))) for f in full} <= got


def test_a_hot_block_loses_no_pair(spark):
    """One family name for all: what the blocks give equals all pairs under the same condition, found by joining the whole block with itself."""
    letters = "bdfgklmnprstvz"
    forms = [Name(proper=(f"k{v}{b}{w}{c}ul", "plagostur"), trade=("bakery", "plumbing", "")[i % 3]).key() for i, (v, b, w, c) in enumerate((v, b, w, c) for v in "aeo" for b in letters for w in "ei" for c in letters)]
    df = spark.createDataFrame([(f,) for f in forms], "form string")
    trade = lambda c: F.split(c, "\\|")[4]
    pairs = df.select(F.col("form").alias("x")).join(df.select(F.col("form").alias("y")), F.col("x") < F.col("y"))
    want = pairs.where(((trade("x") == trade("y")) | (trade("x") == "") | (trade("y") == "")) & _may(F.col("x"), F.col("y")))
    assert len(forms) > 1000 and {tuple(r) for r in candidate_pairs(df).collect()} == {tuple(r) for r in want.collect()}
