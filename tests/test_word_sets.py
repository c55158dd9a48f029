import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions.normalise import fold_latin
from weftline.operators import retrieval as S
from weftline.operators.word_sets import word_codes
from weftline.plans import linking as L

CHANNELS = ["nw", "nc", "ad"]
NAMES = [["Al Co", "al"], ["aa AA b"], ["x"], ["é-ab"], [], ["", " ##"], ["one two", "two one"], ["a", "b" * 70], ["ab"], ["b a"]]
ADDRESSES = [["1 1 Main St", "main"], [], ["", "007"], ["x"], ["Ünter 5/6"], ["a"], ["9" * 40], ["a b c"], [""], ["b a"]]


def test_codes_are_those_of_the_plain_features(spark):
    rows = [(str(i), n, a) for i, n in enumerate(NAMES) for a in ADDRESSES]
    plain = spark.createDataFrame([(str(j), n, a) for j, (_, names, ads) in enumerate(rows) for n in names or [None] for a in ads or [None]], "entity_id string, business_name string, business_address string")
    made = L.simple_form(plain.withColumns({"src": F.lit(1), "country": F.lit("US"), "data_split": F.lit(None).cast("string")}))
    want = {(int(r["id"]), r["ch"], r["feat"]) for r in L.simple_features(made).collect()}
    fold = {r["x"]: r["y"] for r in spark.createDataFrame([(x,) for xs in NAMES + ADDRESSES for x in xs], "x string").select("x", fold_latin(F.col("x")).alias("y")).collect()}
    table = pa.table({"names": pa.array([[fold[x] for x in n] for _, n, _ in rows], pa.list_(pa.string())), "addresses": pa.array([[fold[x] for x in a] for _, _, a in rows], pa.list_(pa.string()))})
    code, owner = word_codes(CHANNELS)(table)
    # A code stands for one feature wherever it occurs: as many codes as features, in the same rows.
    at: dict = {}
    for row, ch, feat in want:
        at.setdefault((ch, feat), set()).add(row)
    met: dict = {}
    for row, x in zip(owner.tolist(), code.tolist()):
        met.setdefault(x, []).append(row)
    assert sorted((CHANNELS.index(ch), sorted(rows)) for (ch, _), rows in at.items()) == sorted((x & 3, sorted(rows)) for x, rows in met.items())
    assert list(zip(owner, code & 3)) == sorted(zip(owner, code & 3))


def files_of(spark, tmp_path, rows, monkeypatch):
    """Index files of (id, codes) of one country, and where each reading of them is told."""
    index = spark.createDataFrame([(i, "US", c) for i, c in rows], "id string, country string, codes array<long>")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    S.search_sets(index, index, index.groupBy("country").agg(F.count("*").alias("n_index")), {"nw": 50, "nc": 50}, 4, 2)
    folder = next(tmp_path.glob("*/retrieval-*"))
    read, told = S._read, []
    monkeypatch.setattr(S, "_read", lambda folder, **where: (told.append(where), read(folder, **where))[1])
    return S._Files(f"{folder}/terms", f"{folder}/shards", 2), told


def test_index_is_read_once_and_queries_are_scored_together(spark, tmp_path, monkeypatch):
    some = np.random.default_rng(4)
    rows = [(f"s{i:03}", sorted({int(x) * 4 + int(c) for x, c in zip(some.integers(1, 25, 9), some.integers(0, 2, 9))})) for i in range(90)]
    before = spark.sparkContext.getCheckpointDir()
    files, told = files_of(spark, tmp_path, rows, monkeypatch)
    spark.sparkContext.setCheckpointDir(before or str(tmp_path))
    scored = []
    scores = S._scores
    monkeypatch.setattr(S, "_scores", lambda *a: (scored.append(1), scores(*a))[1])
    table = pa.table({"id": [i for i, _ in rows], "country": ["US"] * len(rows), "codes": pa.array([c for _, c in rows], pa.list_(pa.int64()))})
    ask = lambda t: [r for b in S._answers(t, files, 500, ["nw", "nc"], [[9, 9], [50, 50]], 1.2, 4, 2, S.given) for r in b.to_pylist()]
    whole = ask(table)
    # One step for each pass, not one a query; a second chunk reads no file again.
    assert len(scored) == 2 and len({r["q"] for r in whole}) == len(rows)
    halves = ask(table.slice(0, 40)) + ask(table.slice(40))
    assert len(told) == 2
    # However few postings are added up at once, the pairs are the same.
    monkeypatch.setattr(S, "ROOM", 1)
    single = ask(table)
    order = lambda rs: sorted(rs, key=lambda r: (r["q"], r["s"]))
    assert order(whole) == order(halves) == order(single)
    # Nor does it matter if nothing stays in memory.
    monkeypatch.setattr(S, "HELD", 0)
    assert order(ask(table)) == order(whole)


def test_pairs_below_enough_others_are_not_ranked(spark, tmp_path, monkeypatch):
    some = np.random.default_rng(7)
    # Each record shares frequent features with nearly all others and a rare one with a few.
    rows = [(f"s{i:03}", sorted({int(x) * 4 + int(c) for x, c in zip(some.integers(1, 12, 4), some.integers(0, 2, 4))} | {400 + 4 * int(some.integers(0, 60)) + int(some.integers(0, 2))})) for i in range(400)]
    before = spark.sparkContext.getCheckpointDir()
    index = spark.createDataFrame([(i, "US", c) for i, c in rows], "id string, country string, codes array<long>")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    S.search_sets(index, index, index.groupBy("country").agg(F.count("*").alias("n_index")), {"nw": 400, "nc": 400}, 4, 2)
    spark.sparkContext.setCheckpointDir(before or str(tmp_path))
    folder = next(tmp_path.glob("*/retrieval-*"))
    files = S._Files(f"{folder}/terms", f"{folder}/shards", 2)
    ranked = []
    top = S._top
    monkeypatch.setattr(S, "_top", lambda q, *a: (ranked.append(len(q)), top(q, *a))[1])
    table = pa.table({"id": [i for i, _ in rows], "country": ["US"] * len(rows), "codes": pa.array([c for _, c in rows], pa.list_(pa.int64()))})
    ask = lambda: sorted((r["q"], r["rk"], r["s"], r["comb"], r["sc_nw"], r["sc_nc"]) for b in S._answers(table, files, 500, ["nw", "nc"], [[400, 400]], 0.0, 4, 2, S.given) for r in b.to_pylist())
    few, less = ask(), sum(ranked)
    ranked.clear()
    monkeypatch.setattr(S, "_hopeful", lambda shard, q, *a: np.ones(len(q), dtype=bool))
    assert ask() == few and 5 * less < sum(ranked)
