"""Samples under shared limits against folds over rows; matching blocks against the published definition."""

import difflib
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import matching, sampling


def drawn(seed, key):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


def folded_sample(rows, strata, count, cap, seed, reserve):
    quota = {s: count // len(strata) + (k < count % len(strata)) for k, s in enumerate(strata)}
    used, chosen, have = Counter(), [], Counter()

    def take(pool, by, full):
        out = []
        for r in sorted(pool, key=lambda r: drawn(by, r[0])):
            if full(len(out)):
                break
            if used[r[1]] < cap:
                used[r[1]] += 1
                out.append(r)
        return out

    for s in strata:
        chosen += take([r for r in rows if r[2] == s], seed, lambda n, s=s: n >= quota[s])
    rest = lambda: [r for r in rows if r not in chosen]
    chosen += take(rest(), seed + 1, lambda n, m=len(chosen): n >= count - m)
    assert len(chosen) == count and not have
    primary = [(*r, "primary", k) for k, r in enumerate(sorted(chosen, key=lambda r: drawn(seed + 2, r[0])), 1)]
    return primary + [(*r, "reserve", None) for r in take(rest(), seed + 3, lambda n: 0 <= reserve <= n)]


@pytest.mark.parametrize(("count", "cap", "reserve"), [(10, 1, 0), (23, 3, -1), (24, 2, 5)])
def test_stratified_sample(spark, count, cap, reserve):
    rng = np.random.default_rng(count)
    rows = [(k, None if g == 0 else f"g{g}", s if s != "x" else None) for k, (g, s) in enumerate(zip(rng.integers(0, 14, 300).tolist(), rng.choice(["a", "b", "c", "c", "c", "x"], 300).tolist(), strict=True))]
    rows = [r for r in rows if r[2] != "b" or r[1] in ("g1", "g2")]  # too few of b under the cap: filled from others
    frame = spark.createDataFrame(rows, "sample_id long, group string, stratum string")
    got = sampling.stratified_sample(frame, ["a", "b", "c"], count, cap, 5, reserve).drop("order")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(folded_sample(rows, ["a", "b", "c"], count, cap, 5, reserve), key=repr)


def test_stratified_sample_falls_short(spark):
    frame = spark.createDataFrame([(1, "g", "a"), (2, "g", "a")], "sample_id long, group string, stratum string")
    with pytest.raises(ValueError, match="1 of 2"):
        sampling.stratified_sample(frame, ["a"], 2, 1, 0)
    assert sampling.stratified_sample(frame, ["a"], 0, 1, 0).count() == 0


def folded_coverage(rows, count, seed):
    own, first = {}, {}
    for item, label, f in rows:
        own.setdefault(label, set()).add(item)
        first[label] = first.get(label, False) or f
    lists = {label: sorted(items, key=lambda i: drawn(seed, i)) for label, items in own.items()}
    order = sorted(lists, key=lambda x: (not first[x], len(own[x]), x))
    chosen, turn = {}, 0
    while len(chosen) < count:
        turn, before = turn + 1, len(chosen)
        for label in order:
            item = next((i for i in lists[label] if i not in chosen), None)
            if item is not None and len(chosen) < count:
                chosen[item] = label
        if len(chosen) == before:
            break
    return {(i, label) for i, label in chosen.items()}


@pytest.mark.parametrize("count", [1, 7, 60, 1000])
def test_coverage_sample(spark, count):
    rng = np.random.default_rng(3)
    rows = [(i, f"l{label}", bool(label < 4)) for i in range(150) for label in set(np.minimum(rng.geometric(0.25, rng.integers(1, 5)), 12).tolist())]
    got = sampling.coverage_sample(spark.createDataFrame(rows + rows[:5], "item long, label string, first boolean"), count, 9).collect()
    assert {(r.item, r.label) for r in got} == folded_coverage(rows, count, 9)
    assert sorted(r.place for r in got) == list(range(1, len(got) + 1))
    assert sampling.coverage_sample(spark.createDataFrame([], "item long, label string, first boolean"), 3, 1).count() == 0


def test_match_ratio(spark):
    """On a thousand pairs the ratio is that of the published definition."""
    rng = np.random.default_rng(1)
    words = ["the", "cat", "sat", "on", "a", "mat", "été", "日本", "x" * 9, "no", "on on"]
    pairs = [(0, "", ""), (1, None, "a"), (2, "aaaa", "aa"), (3, "abcabcabc", "cabcab"), (4, "same text", "same text"), (5, "a\nb", "a\nb\n"), (6, "😀x😀", "x😀")]
    while len(pairs) < 1000:
        a = [words[k] for k in rng.integers(0, len(words), rng.integers(0, 14))]
        b = list(a) if rng.random() < 0.6 else [words[k] for k in rng.integers(0, len(words), rng.integers(0, 14))]
        for _ in range(int(rng.integers(0, 4))):
            if b:
                b[int(rng.integers(len(b)))] = words[int(rng.integers(len(words)))]
        pairs.append((len(pairs), " ".join(a), " ".join(b)))
    got = {r.id: r.ratio for r in matching.match_ratio(spark.createDataFrame(pairs, "id long, a string, b string")).collect()}
    assert got == {k: pytest.approx(difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()) for k, a, b in pairs}


def test_long_texts_are_compared_in_boxes(spark, monkeypatch):
    """Runs of equals found are far fewer than the product of the texts' lengths; copies of a pair cost nothing."""
    rng, syllables = np.random.default_rng(2), [a + b for a in "tnrs" for b in "aeiou"] + [" ", " ", ". "]
    a, b = ("".join(syllables[k] for k in rng.integers(0, len(syllables), 500)) for _ in range(2))
    found, plain = [], matching.common_runs

    def counted(*args):
        runs = plain(*args)
        found.append(runs.count())
        return runs

    monkeypatch.setattr(matching, "common_runs", counted)
    got = matching.match_ratio(spark.createDataFrame([(k, a, b) for k in range(20)], "id long, a string, b string")).collect()
    assert [r.ratio for r in got] == [pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())] * 20
    assert sum(found) < len(a) * len(b) / 20


def test_distinctness(spark):
    rows = [(1, "The  CAT\n sat", "the cat sat", "A dog"), (2, None, "", "x"), (3, "ΣΑΣ straße", "σας STRASSE", "b")]
    got = {r.k: r for r in matching.distinctness(spark.createDataFrame(rows, "k long, base string, basis string, random string"), ["k"], ["base", "basis", "random"]).collect()}
    for k, *texts in rows:
        a, b, c = (" ".join((t or "").split()).casefold() for t in texts)
        want = [difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in ((a, b), (a, c), (b, c))]
        assert [got[k].base_vs_basis, got[k].base_vs_random, got[k].basis_vs_random, got[k].text_distinctness] == pytest.approx([*want, 1 - max(want)])


def test_folded(spark):
    texts = ["A B  c", " x\x1cy ", "ΌΣΟΣ", "ß"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(matching.folded(F.col("t"))).collect()]
    assert got == ["a b c", "x y", "όσοσ", "ss"]
