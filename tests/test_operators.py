"""Operators on small cases, against plain Python."""

import math
import time
from fractions import Fraction
from itertools import product

import pytest
from pyspark.sql import functions as F

from colloquy.functions import stats as X
from colloquy.functions import text as T
from colloquy.operators import dedup as D
from colloquy.operators import pairs as P
from colloquy.operators import scoring as S
from colloquy.operators import turns as U
from colloquy.plans.scoring import MODEL, within_budget

GOLDEN = S.TransitionModel(
    states=("a", "b", "c", "d"), observations=("x", "y"), positive=("b", "c"), negative=("a", "d"), initial=(0.4, 0.3, 0.2, 0.1),
    transition=((0.4, 0.3, 0.2, 0.1), (0.1, 0.6, 0.2, 0.1), (0.2, 0.2, 0.5, 0.1), (0.3, 0.1, 0.1, 0.5)), emission=((0.7, 0.3), (0.2, 0.8), (0.4, 0.6), (0.9, 0.1)),
)


def forward(model, observations):
    m, n, p, out = model.normalised(), range(len(model.states)), None, []
    p = list(m.initial)
    keep = [m.states.index(s) for s in m.positive]
    for o in observations:
        q = [sum(p[i] * m.transition[i][j] for i in n) for j in n]
        q = [max(1e-12, x / sum(q)) for x in q]
        w = [q[j] * m.emission[j][m.observations.index(o)] for j in n]
        p = [max(1e-12, x / sum(w)) for x in w]
        bound = lambda v: max(0.001, min(0.999, sum(v[k] for k in keep)))
        out.append((bound(q), bound(p), m.states[p.index(max(p))]))
    return out


def test_forward_filter(spark):
    seen = {1: "xyxxy", 2: "y", 3: "x" * 40}
    df = spark.createDataFrame([(c, i, o) for c, xs in seen.items() for i, o in enumerate(xs)], "conv_id long, turn_index int, observation string")
    got = {(r.conv_id, r.turn_index): r for r in S.forward_filter(df, GOLDEN).collect()}
    for c, xs in seen.items():
        for i, (prior, posterior, state) in enumerate(forward(GOLDEN, xs)):
            r = got[c, i]
            assert r.prior == pytest.approx(prior, abs=1e-9) and r.posterior == pytest.approx(posterior, abs=1e-9) and r.most_likely_state == state
            assert r.delta == pytest.approx(posterior - prior, abs=1e-9)


def test_model_problems():
    assert MODEL.problems() == []
    bad = S.TransitionModel(("a", "b"), ("x", "y"), ("a",), ("a", "b"), (0.5, 0.5), ((0.5, 0.4), (1.0, 0.2)), ((0.5, 0.5),))
    found = " ".join(bad.problems())
    assert "both positive and negative" in found and "sums to 0.900" in found and "between 0 and 1" in found and "no row" in found
    with pytest.raises(ValueError):
        bad.normalised()


def test_fallback_label():
    assert S.negative_fallback(MODEL) == "generic"
    assert S.negative_fallback(GOLDEN) == "x"


def test_budget_skips_what_does_not_fit(spark):
    sizes = [(1, 6), (2, 7), (3, 3), (4, 1), (5, 9)]
    got = [r.conv_id for r in within_budget(spark.createDataFrame(sizes, "conv_id long, size long"), 10).orderBy("conv_id").collect()]
    assert got == [1, 3, 4]
    assert within_budget(spark.createDataFrame([(1, 20), (2, 1)], "conv_id long, size long"), 10).count() == 1
    assert within_budget(spark.createDataFrame([], "conv_id long, size long"), 10).count() == 0


def test_greedy_near_duplicates(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(base[:39] + ["z1"]), " ".join(base[:38] + ["z1", "z2"]), " ".join(base), "", "", "solo words here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in D.greedy_filter(df, "doc_id", "text", 0.9).collect()}
    sets = [set((t or "").split()) for t in texts]
    prints = {r.doc_id: r.simhash for r in D.simhash64(df, "doc_id", "text").collect()}
    kept = []
    for i, s in enumerate(sets):
        shares = lambda j: any((prints[i] >> 16 * b) & 0xFFFF == (prints[j] >> 16 * b) & 0xFFFF for b in range(4))
        if not any(shares(j) and s | sets[j] and len(s & sets[j]) / len(s | sets[j]) >= 0.9 for j in kept):
            kept.append(i)
    assert sorted(i for i, k in got.items() if k) == kept


def test_acceptance(spark):
    rows = spark.createDataFrame([(a / 20, b / 20) for a, b in product(range(21), repeat=2)], "c double, r double")
    for x in rows.withColumn("rule", P.acceptance_rule(F.col("c"), F.col("r"))).collect():
        want = None if x.c < 0.7 else "strict" if x.r <= 0.55 and x.c - x.r >= 0.25 else "gap_rescue" if x.r <= 0.65 and x.c - x.r >= 0.3 else None
        assert x.rule == want


def test_pairs_first_of_ties(spark):
    rows = spark.createDataFrame([("p", "a", 0.9, 1), ("p", "b", 0.9, 2), ("p", "c", 0.1, 3), ("p", "d", 0.1, 4), ("q", "a", 0.9, 5), ("s", "t", 0.7, 6), ("s", "t", 0.2, 7)], "prompt string, response string, posterior double, k int")
    got = P.same_prompt_pairs(rows, ["k"]).collect()
    assert [(r.prompt, r.chosen, r.rejected) for r in got] == [("p", "a", "c")]


def test_holm_and_ranks(spark):
    p = spark.createDataFrame([(k, v) for k, v in enumerate([0.01, 0.04, 0.03, 0.5])], "k int, p double")
    got = {r.k: r.adjusted for r in X.holm(p, "p").collect()}
    assert got == pytest.approx({0: 0.04, 2: 0.09, 1: 0.09, 3: 0.5})
    ranked = X.average_ranks(spark.createDataFrame([(1, v) for v in (3.0, 1.0, 3.0, 2.0)], "g int, v double"), ["g"], "v")
    assert sorted(r["rank"] for r in ranked.collect()) == [1.0, 2.0, 3.5, 3.5]


def test_chi_square_tail(spark):
    for x, p in ((0.5, 0.9188914), (7.814728, 0.05), (16.2662, 0.001)):
        assert spark.range(1).select(X.chi3_tail(F.lit(x))).first()[0] == pytest.approx(p, abs=2e-6)


def test_sign_test(spark):
    df = spark.createDataFrame([("g", float(d)) for d in [1] * 9 + [-1] * 3 + [0] * 2] + [("z", 0.0)], "g string, d double")
    got = {r.g: r.p for r in X.sign_test(df, "g").collect()}
    assert got["g"] == pytest.approx(2 * sum(math.comb(12, i) for i in range(4)) / 2**12) and got["z"] == 1.0


@pytest.mark.parametrize(("wins", "losses"), [(1, 0), (5, 5), (0, 9), (700, 640), (20_000, 19_700), (3000, 10)])
def test_sign_test_of_many(spark, wins, losses):
    df = spark.range(wins + losses).select(F.lit("g").alias("g"), F.when(F.col("id") < wins, 1.0).otherwise(-1.0).alias("d"))
    n, low = wins + losses, min(wins, losses)
    term = total = 1
    for i in range(low):
        term = term * (n - i) // (i + 1)
        total += term
    assert X.sign_test(df, "g").first().p == pytest.approx(min(1.0, 2 * float(Fraction(total, 2**n))), rel=1e-7, abs=1e-300)


def test_text_functions(spark):
    df = spark.createDataFrame([("take 2.50 or 007 and 1.2.3", "take 2.5 or 7", "Ａｎｎ  Lee", "ann lee")], "a string, b string, c string, d string")
    r = df.select(T.missing_numerals(F.col("a"), F.col("b")).alias("m"), (T.name_key("c") == T.name_key("d")).alias("same")).first()
    assert "2.5" not in r.m and r.same


def test_roles_alternate_backwards(spark):
    got = spark.range(1).select(U.reassign_roles(F.array(F.lit("User: a"), F.lit("User: b"), F.lit("AI: c")))).first()[0]
    assert got == ["AI: a", "User: b", "AI: c"]


def test_lenient_and_strict_lines(spark, tmp_path):
    from colloquy.sources.tables import RECORD, read_jsonl

    (tmp_path / "x.jsonl").write_text('{"conversation_id": "a", "turn_index": 1}\nnot json\n{"conversation_id": "b"}\n')
    rows = read_jsonl(spark, str(tmp_path / "x.jsonl"), RECORD).cache()
    assert rows.where("_corrupt is not null").count() == 1 and rows.where("_corrupt is null").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        read_jsonl(spark, str(tmp_path / "x.jsonl"), RECORD, strict=True).collect()


def test_bigrams_of_a_long_text(spark):
    """All neighbouring pairs once, also beyond the basic plane, and in time linear in the text."""
    texts = [None, "", "a", " a b ", "aaa", "abab", "😀x😀\n日本", "the cat sat " * 12_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    began = time.perf_counter()
    got = {r.k: r.xs for r in rows.select("k", T.bigrams(F.col("t")).alias("xs")).collect()}
    assert time.perf_counter() - began < 15
    for k, t in enumerate(texts):
        bare = "".join((t or "").split())
        assert sorted(got[k]) == sorted({bare[i : i + 2] for i in range(len(bare) - 1)})


def test_near_pairs_of_all_sizes(spark, monkeypatch):
    """All pairs that share a band and are alike, whatever the number of tokens; few others get their tokens."""
    import numpy as np

    rng, rows = np.random.default_rng(5), []
    for n in (1, 2, 3, 4, 5, 8, 10, 40, 200):
        for _ in range(12):
            words = [f"w{x}" for x in rng.choice(300 if n < 100 else 600, n, replace=False)]
            for drop in (0, 1, n // 9, n // 5, n // 3):
                rows.append((len(rows), " ".join(words[drop:] + [f"v{x}" for x in rng.integers(0, 40, drop // 3)])))
    frame = spark.createDataFrame(rows, "k long, t string")
    sets, first = {k: frozenset(t.split()) for k, t in rows}, {}
    for k, x in sorted(sets.items()):
        if x:
            first.setdefault(x, k)
    prints = {r.k: r.simhash & (1 << 64) - 1 for r in D.simhash64(frame, "k", "t").collect()}
    band = lambda a, b: any(not (prints[a] ^ prints[b]) >> 16 * i & 0xFFFF for i in range(4))
    for threshold in (0.5, 0.8):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in product(first.values(), repeat=2) if a < b and band(a, b)}
        got = {(r.a, r.b): r.jaccard for r in D.near_pairs(frame, "k", "t", threshold).collect()}
        assert got == pytest.approx({p: j for p, j in want.items() if j >= threshold}) and len(got) > 30
    plan = D.near_pairs(frame, "k", "t", 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "bit_count" in plan
