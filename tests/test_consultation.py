"""Consultations, annotations and splits on small made tables."""

import hashlib

from pyspark.sql import functions as F

from colloquy.operators import consultation as C
from colloquy.operators import dedup as D

FILLER = "some more words of no weight at all"


def decided(spark, conversations):
    rows = [(k, i, role, text) for k, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv long, turn int, role string, text string")
    return {r.conv: r.consultation for r in C.personal_consultation(turns, "conv", "turn", ("cough", "chest pain")).collect()}


def test_personal_consultation(spark):
    user = lambda *texts: [("user", t) for t in texts]
    got = decided(spark, {
        1: user("I have had a cough for days now"),  # pronoun, action and clinical term close together
        2: user("Should I see someone about chest  pain today"),  # asks directly; any white space within the phrase
        3: user("The history of cough remedies in trade"),  # of the domain, nobody speaks of themselves
        4: user("I have had a fever for days now"),  # not of the domain
        5: user("I have had a cough for days now", "please write me a short story"),  # another request
        6: user("hi", "hello", "I have had a cough for days now"),  # greetings have no substance
        7: user(FILLER, FILLER, FILLER, "I have had a cough for days now"),  # after the third turn of substance
        8: user('"I have had a cough for days now'),  # quoted
        9: user("x " * 700 + " I have had a cough"),  # long, without a direct question
        10: user("x " * 700 + " should I see someone about my cough"),  # long, with one
        11: [("assistant", "I have had a cough for days now")],
        12: user("I " + "z " * 120 + " have a cough, it is fair to say"),  # too far apart
        13: [("user", None)],
        14: user("coughing painfully I have had rash"),  # whole words only
        15: user("no no no no cough I have"),  # four different words: no, cough, i, have
        16: user("my my my cough"),  # two
        17: user("Ｉ ｈａｖｅ had a ｃｏｕｇｈ"),  # wide forms
    })
    assert got == {k: k in (1, 2, 6, 10, 15, 17) for k in range(1, 18)}
    assert decided(spark, {1: user("")}) == {1: False}


def test_health_flags(spark):
    lists = C.HealthLists(("cough", "c++"), ("cough",), ("since",), ("damn it",), (r"\d{3}-\d{4}",))
    said = {
        1: [("user", "c++ is fun"), ("assistant", "DAMN  it"), ("user", "worse since then ok")],
        2: [("user", " Explain a cough"), ("user", "since since"), ("user", None)],
        3: [("user", "x" * 2000 + " cough"), ("user", "555-1234")],
        4: [("assistant", "cough")],
        5: [("user", None), ("user", "cough and no more")],
    }
    rows = [(k, i, role, text) for k, turns in said.items() for i, (role, text) in enumerate(turns)]
    got = {r.conv: tuple(r)[1:] for r in C.health_flags(spark.createDataFrame(rows, "conv long, turn int, role string, text string"), "conv", "turn", lists).collect()}
    names = ("health", "respiratory", "personal", "followup_information", "single_knowledge", "explicit_pii", "toxic_text")
    want = {1: {"health", "followup_information", "toxic_text"}, 2: {"health", "respiratory", "single_knowledge"}, 3: {"explicit_pii"}, 4: set(), 5: {"health", "respiratory", "followup_information"}}
    assert {k: {n for n, v in zip(names, x, strict=True) if v} for k, x in got.items()} == want


def test_official_splits(spark):
    groups = spark.createDataFrame([(f"d{k}", k % 5 == 0) for k in range(30)], "digest string, outside boolean")
    got = {r.digest: r.split for r in C.official_splits(groups, "digest", "outside", "3", (10, 4)).collect()}
    inside = sorted((f"d{k}" for k in range(30) if k % 5), key=lambda d: hashlib.sha256(f"3:{d}".encode()).hexdigest())
    want = {d: "train" if i < 10 else "validation" if i < 14 else "test" for i, d in enumerate(inside)} | {f"d{k}": "test" for k in range(0, 30, 5)}
    assert got == want


def test_annotations(spark):
    rows = [(1, 0, "a", " Ask ", None), (1, 0, "b", "ask", "pain"), (1, 1, "a", None, "pain"), (1, 1, "b", None, "pain")]
    frame = spark.createDataFrame(rows, "conv long, turn int, variant string, intent string, slot string")
    assert {tuple(r) for r in C.annotation_summary(frame, "conv", "turn").collect()} == {("intent", "ask", 2), ("slot", "pain", 3), ("disagreement", "turns", 1)}
    assert C.annotation_summary(frame.limit(0), "conv", "turn").collect()[0].n == 0


def test_near_pairs_and_membership(spark, monkeypatch):
    """Hot bands that are dealt over blocks give the pairs of comparing all; each row names its class."""
    texts = [" ".join(f"w{k}" for k in range(40) if k != i % 9) + f" tail{i % 17}" for i in range(80)] + ["", None, "W1 w2", "w2 w1 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {tuple(r) for r in D.near_pairs(docs, "doc_id", "text", 0.8).collect()}
    monkeypatch.setattr(D, "BAND_BLOCK", 4)
    assert {tuple(r) for r in D.near_pairs(docs, "doc_id", "text", 0.8).collect()} == plain and plain
    sets = [frozenset((t or "").lower().split()) for t in texts]
    own = {r.doc_id: r["class"] for r in D.membership(docs, "doc_id", "text").collect()}
    assert own == {k: sets.index(s) if s else k for k, s in enumerate(sets)}
    assert all(abs(j - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-12 and own[a] == a and own[b] == b for a, b, j in plain)


def test_diverse_choice(spark):
    """Each choice is the best of what is left by score less likeness to the choices before."""
    from colloquy.plans.audits import diverse_choice

    rows = [(k, 0, (7 * k % 10) / 10, [f"w{j}" for j in range(k % 4)]) for k in range(12)]
    frame = spark.createDataFrame(rows, "conv_id long, turn_index int, score double, tokens array<string>")
    got, taken = [r.conv_id for r in diverse_choice(frame, ["conv_id", "turn_index"], 4).orderBy(F.monotonically_increasing_id()).collect()], []
    like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 0.0
    for _ in range(4):
        worth = {r[0]: 0.8 * r[2] - 0.2 * max([like(r[3], rows[t][3]) for t in taken], default=0.0) for r in rows if r[0] not in taken}
        taken.append(min(worth, key=lambda k: (-worth[k], -rows[k][2], k)))
    assert got == taken
