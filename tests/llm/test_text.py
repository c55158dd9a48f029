import random

import pytest
from pyspark.sql import functions as F

from weftline.llm.leakage import Matcher, Walks, _common, holds, passages
from weftline.llm.lookalike import Reader, alike_pairs, consistent, plain, shape_of
from weftline.llm.tokenizer import DEFAULT_RANKS, decode, encode, safe_pieces
from weftline.llm.words import WordFolder


def test_plain_removes_what_does_not_show():
    assert plain("Ｏﬃce​  of Jean‑Luc­ ") == "Office of Jean-Luc"
    assert plain("é") == "é" and plain("  　") == "" and plain("") == ""


def test_look_keeps_case_accents_and_digits():
    assert shape_of("раυрer") != "pauper" and shape_of("рарer") == "paper"
    assert len({shape_of(x) for x in ("Paper", "paper", "páper", "pap3r")}) == 4


def test_script_follows_the_letters_that_leave_no_choice():
    counts = {" п": 5, "пр": 5, "ри": 5, "ив": 5, "ве": 5, "ет": 5, "т ": 5, " c": 9, "co": 9, "op": 9, "pe": 9, "e ": 9}
    reader = Reader(counts)
    assert reader.text("Пpивeт") == reader.text("Привет") and "р" in reader.text("Пpивeт")
    assert reader.text("соре") == reader.text("cope") == "cope"


def test_context_reads_letters_that_look_alike_in_some_faces(spark):
    """No class of shapes holds Greek alpha and a: the letters around decide, and a word that is Greek or Russian throughout stays."""
    words = ["Park", "Pacific", "Oak", "market", "trade", "рынок", "тот", "там", "нет", "Αθήνα", "ανατολή", "τάση"]
    rows = [(f"k{i}", w) for i, w in enumerate(words * 4)] + [("x", "Pαcific Pαrk"), ("y", "Pacific Park"), ("z", "тот"), ("w", "tot")]
    df = spark.createDataFrame(rows, "entity_id string, n string")
    forms = {r["entity_id"]: r["n_form"] for r in consistent(df, ["n"]).collect()}
    assert forms["x"] == forms["y"] == "Pacific Park" and forms["z"] != forms["w"] == "tot" and shape_of("Pαcific") != shape_of("Pacific")
    got = {tuple(r) for r in alike_pairs(df, "entity_id", ["n"], "a", "b").collect()}
    assert ("x", "y") in got and ("w", "z") not in got


def test_forms_and_pairs(spark):
    rows = [("a", "Oak Ltd", "1 Elm"), ("b", "Оаk Ltd", "1 Elm"), ("c", "Oak Ltd", "1 Elm"), ("c", "Oak Ltd", "1 Elm"), ("d", "oak Ltd", "1 Elm"), ("e", None, "1 Elm"), ("f", "", ""), ("g", "Оаk Ltd", " "), (None, "Oak  Ltd", "1 Elm")]
    df = spark.createDataFrame(rows, "entity_id string, n string, a string")
    assert {tuple(r) for r in alike_pairs(df, "entity_id", ["n", "a"], "x", "y").collect()} == {("a", "b"), ("b", "c")}
    forms = {r["entity_id"]: (r["n_form"], r["a_form"]) for r in consistent(df, ["n", "a"]).collect()}
    assert forms["a"] == forms["b"] == ("Oak Ltd", "1 Elm") and forms["e"] == (None, "1 Elm") and forms["f"] == ("", "")
    assert alike_pairs(df.limit(0), "entity_id", ["n", "a"], "x", "y").count() == 0


def test_encoding_round_trip_and_reference_library(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "Hello  world", "東京 👩‍🔧 naïve", " \n", "<|endoftext|> x", "word " * 30000, "a" * 70000, "été " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = encode(df, "doc_id", "text", piece_chars=1000)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    lib = Tokenizer.from_file(DEFAULT_RANKS.replace(".tiktoken", ".json"))
    lib.encode_special_tokens = True
    for i, t in enumerate(texts):
        assert got[i] == (lib.encode(t, add_special_tokens=False).ids if t else [])
    back = {r["doc_id"]: r["text"] for r in decode(ids, "doc_id").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_cuts_give_the_ids_of_the_whole_text():
    from weftline.llm import tokenizer as T

    with open(DEFAULT_RANKS, "rb") as f:
        enc = T._encoding(f.read(), T.PATTERN)
    rng = random.Random(0)
    signs = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'ll", "。", "字", "1", "２", ".", "-", "é", "\u0301", "😀", "\u00a0", "ab", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(2, 40)))
        assert [i for p in safe_pieces(text, 1) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    for text in ("。\nab" * 50_000, "日本語の文章です。" * 20_000, "word " * 50_000):
        assert len(list(safe_pieces(text, 20_000))) > 4 and "".join(safe_pieces(text, 20_000)) == text


ITEM = "Around 1850 Beraquist and Vidaidovny overturned 7522 contracts beside Hobraiffro while Kruluquist of Shetowyck dismissed thirty contracts under Maiskudovny and kept prosecutors waiting"


def test_passages(spark):
    words = ITEM.split()
    filler = "Nothing of note happened in the town that day and people went home early as always".split()
    changed = words[:]
    changed[3], changed[12] = "or", "never"
    docs = [
        (1, " ".join(filler + words + filler)), (2, ITEM.upper().replace(" ", "  \n")), (3, " ".join(filler + words[5:17] + filler)), (4, " ".join(filler + words[5:11] + filler)), (5, " ".join(changed)),
        (6, " ".join(filler)), (7, None), (8, ""), (9, ITEM.replace("o", "ο").replace("a", "а")), (10, " ".join(reversed(words))), (11, " ".join(filler * 3000 + words + filler * 3000)), (12, " ".join(words[:6] + filler + words[6:12])),
        (13, " ".join(w for i, w in enumerate(words) if i not in (4, 15))),
        (14, " ".join(w if i not in (9, 10, 11) else "other" for i, w in enumerate(words[:20]))),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in passages(d, "doc_id", "text", items, "item_id", "text").collect()}
    assert got - {(x, 10) for x in range(20)} == {(k, 7) for k in (1, 2, 3, 5, 9, 11, 13, 14)}
    assert passages(d, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_candidates_reach_every_planted_passage():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(60)]
    m = Matcher(items, 8, 2, 20, 4, 12, 6, 5)
    texts, want = [], set()
    for n in range(300):
        k, t = rng.choice(items)
        at = rng.randrange(0, 16)
        part = t.split()[at : at + 14]
        for j in rng.sample(range(2, 12), 2):
            part[j] = rng.choice(vocab)
        texts.append(" ".join([rng.choice(vocab) for _ in range(20)] + part + [rng.choice(vocab) for _ in range(20)]))
        want.add((n, k))
    got = {(d, m.items[o][0]) for d, o, *_ in m.batch(texts)}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 3


def test_edits_within_a_text_equal_the_plain_table():
    rng = random.Random(8)
    for _ in range(300):
        text, pattern = [rng.randrange(5) for _ in range(rng.randrange(0, 14))], [rng.randrange(5) for _ in range(rng.randrange(1, 7))]
        above = [0] * (len(text) + 1)
        for i, x in enumerate(pattern):
            row = [i + 1]
            for j, y in enumerate(text):
                row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
            above = row
        for most in range(len(pattern)):
            assert holds(text, pattern, most) == (min(above[1:], default=99) <= most)


def test_common_subsequences_and_walks():
    import numpy as np

    a, b = np.array([[1, 2, 3, 4], [1, 1, 1, 1]]), np.array([[1, 3, 4, 2], [2, 2, 2, 2]])
    assert _common(a, b).tolist() == [3, 0]
    w = Walks(10, 4, 3, 2, 1)
    assert (w.keys(a, 0) == w.keys(a.copy(), 0)).all()


@pytest.mark.parametrize("raw,out", [("D'Orgue,", "dorgue"), ("—", ""), ("ＦＯＯ", "foo"), ("nаïve", "naive")])
def test_folded_words(raw, out):
    assert WordFolder().word(raw) == out
