import random

import numpy as np

from weftline.llm.subjects import Chain, SubjectModel, sentences, subject_areas

WORDS = {"law": ["judges", "verdicts", "notaries", "appeals", "statutes"], "sport": ["referees", "sprinters", "goals", "rallies", "trainers"], "music": ["choirs", "arias", "bands", "violins", "drums"]}


def document(rng, subjects, n=6):
    out = []
    for i in range(n):
        s = subjects[i % len(subjects)]
        a, b = rng.sample(WORDS[s], 2)
        out.append(f"In town the {a} changed the {b} after {rng.randrange(99)} weeks.")
    return " ".join(out + ["The meeting starts soon and someone brings the keys."])


def test_held_out_accuracy():
    rng = random.Random(1)
    rows = []
    for i in range(160):
        own = rng.sample(sorted(WORDS), 1 if i % 4 else 2)
        rows.append((document(rng, own), None, f"s{i % 5}", set(own)))
    model = SubjectModel(rows[:110], sorted(WORDS))
    right = sum(set(model.classify(t, s)) == own for t, _, s, own in rows[110:])
    assert right >= 0.95 * 50
    assert model.classify("The meeting starts soon and someone brings the keys.", "s1") == [] and model.classify(None, None) == [] and model.classify("  ", "x") == []
    passing = document(rng, ["law"], 7) + " In town the choirs changed the arias after 3 weeks."
    assert model.classify(passing, "s1") == ["law"]


def test_operator_on_tables(spark):
    rng = random.Random(2)
    docs = [(i, document(rng, [sorted(WORDS)[i % 3]]), None, "src", "clash") for i in range(90)] + [(500, None, "x", None, "y"), (501, "", None, None, "y"), (502, " \n", None, None, "y"), (503, "word " * 20000, None, None, "z")]
    labels = [(i, sorted(WORDS)[i % 3]) for i in range(60)] + [(0, sorted(WORDS)[0]), (None, "law"), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, text_tgt string, source string, k string")
    l = spark.createDataFrame(labels, "doc_id long, subject string")
    a = spark.createDataFrame([(s, "") for s in WORDS], "subject string, about string")
    got = {(r["doc_id"], r["subject"]) for r in subject_areas(d, l, a).collect()}
    assert {x for x in got if x[0] < 500} == {(i, sorted(WORDS)[i % 3]) for i in range(60, 90)} and not {500, 501, 502} & {x[0] for x in got}
    assert subject_areas(d, l.limit(0), a).count() == 0 and subject_areas(d.limit(0), l, a).count() == 0


def test_subjects_that_occur_together(spark):
    """Law is labelled wherever sport is, though one sentence in six deals with it: the chain learns it, a rule on shares can't."""
    rng = random.Random(7)
    rows = []
    for i in range(240):
        own = {"law", "sport"} if i % 3 == 0 else {sorted(WORDS)[i % 3]}
        rows.append((document(rng, ["sport"] * 5 + ["law"], 6) if "sport" in own and "law" in own else document(rng, ["music"] * 5 + ["law"], 6) if own == {"music"} else document(rng, sorted(own), 6), None, f"s{i % 5}", own))
    model = SubjectModel(rows[:160], sorted(WORDS))
    held = rows[160:]
    right = sum(set(model.classify(t, s)) == own for t, _, s, own in held)
    shares = 0
    for t, _, _, own in held:
        count, _ = model.terms.weigh(sentences(t, model.fold))
        shares += {model.subjects[c] for c in range(3) if count[c] >= count.sum() / 3} == own
    assert right >= 0.95 * len(held) > shares


def test_a_wider_beam_finds_what_a_greedy_one_passes_by():
    chain = Chain([0, 1], {}, np.array([0.5, 0.5]), 2)
    chain.weights[0, 0] = -0.2
    chain.weights[1, [0, Chain.OWN]] = -0.1, 5.0
    count = np.array([1.0, 1.0])
    assert chain.decode(count, 0, None, width=1) == [] and chain.decode(count, 0, None, width=6) == [0, 1]
