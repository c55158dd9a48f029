from weftline.operators.packed_values import infer_delimiters, unpack

FIELDS = [
    (1, "S3-000000001"), (2, "S3-000000001,S2-000000002"), (3, '["S3-000000001", "S2-000000002"]'), (4, "'S3-000000001,R2';S2-000000002"), (5, " S3-000000001 | | S2-000000002 "), (6, "S2-000000009/S2-000000008"), (7, None), (8, ""),
    (9, "  "), (10, "null"), (11, "[]"), (12, '""'), (13, "-"), (14, "S2-000000003,S2-000000003"), (15, '"S3-000000004|x"'), (16, "S2-000000005 ;\"S2-000000006\"/S2-000000007"), (17, "S2-000000005\nS2-000000006"), (18, "(S2-000000005 S2-000000006)"), (19, "none"),
    (20, "S2-000000001,,S2-000000002,"),
]


def rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append((r["pos"], r["item"]))
    return {k: [v for _, v in sorted(x)] for k, x in out.items()}


def test_pieces_positions_quotes_and_brackets(spark):
    got = rows(unpack(spark.createDataFrame(FIELDS, "id int, packed string"), "packed", ["id"]))
    a, b = "S3-000000001", "S2-000000002"
    assert got[1] == [a] and got[2] == [a, b] and got[3] == [a, b] and got[5] == [a, b]
    assert got[4] == ["S3-000000001,R2", b] and got[15] == ["S3-000000004|x"]
    assert got[14] == ["S2-000000003"] * 2 and got[16] == ["S2-000000005", "S2-000000006", "S2-000000007"]
    assert got[17] == got[18] == ["S2-000000005", "S2-000000006"] and got[20] == ["S2-000000001", b]
    assert not {7, 8, 9, 10, 11, 12, 13, 19} & set(got)


def test_hyphen_inside_values_is_no_delimiter(spark):
    d = {r["delimiter"]: r["chosen"] for r in infer_delimiters(spark.createDataFrame(FIELDS, "id int, packed string"), "packed").collect()}
    assert d["-"] is False and d[","] and d[";"] and d["/"]


def test_each_source_has_its_own_delimiters(spark):
    df = spark.createDataFrame([(i, "a", f"x{i};x{i + 1}") for i in range(9)] + [(i + 9, "b", f"y{i}~y{i + 1}") for i in range(9)], "id int, src string, packed string")
    got = rows(unpack(df, "packed", ["id"], source="src"))
    assert got[0] == ["x0", "x1"] and got[9] == ["y0", "y1"]


def test_empty_table_long_field_and_clashing_names(spark):
    empty = spark.createDataFrame([], "id int, packed string")
    assert unpack(empty, "packed", ["id"]).count() == 0
    long = spark.createDataFrame([(1, ",".join(f"S2-{i:09d}" for i in range(20000)), "x", "y")], "id int, packed string, source string, bare string")
    assert unpack(long, "packed", ["id"]).count() == 20000
