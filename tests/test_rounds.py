"""Labels that take turns: rounds end with the last item wanted, and the input is read once."""

import numpy as np
import pytest

from colloquy.operators import sampling
from test_selection import folded_coverage

SCHEMA = "item long, label string, first boolean"


def held(spark, rows, count, monkeypatch):
    """The sample of rows, and how often something was checkpointed for it."""
    calls, plain = [], sampling.reliable

    def counted(frame):
        calls.append(1)
        return plain(frame)

    monkeypatch.setattr(sampling, "reliable", counted)
    return {(r.item, r.label) for r in sampling.coverage_sample(spark.createDataFrame(rows, SCHEMA), count, 9).collect()}, len(calls)


def test_rounds_end_with_the_last_item_wanted(spark, monkeypatch):
    """Kinds of labels as in the registered query: of a hundred turns that each label could take, three are asked for."""
    rng = np.random.default_rng(5)
    kinds = [("p", 5, 3), ("s", 5, 1), ("n", 25, 1)]
    rows = [(i, f"{kind}{k}", kind == "p") for i in range(1500) for kind, n, many in kinds for k in set(rng.integers(0, n, many).tolist())]
    got, calls = held(spark, rows, 100, monkeypatch)
    assert got == folded_coverage(rows, 100, 9)
    assert calls <= 26


@pytest.mark.parametrize("seed", range(4))
def test_what_later_turns_do_does_not_matter(spark, seed, monkeypatch):
    """Chains of labels of which each has an item in common with the next, at counts that end within a turn."""
    rng = np.random.default_rng(seed)
    rows = [(10 * k + int(j), f"l{(k + d) % 12}", bool((k + d) % 12 < 3)) for k in range(12) for j in rng.integers(0, 10, 9) for d in (0, 1, int(rng.integers(0, 12)))]
    count = int(rng.integers(5, 60))
    assert held(spark, rows, count, monkeypatch)[0] == folded_coverage(rows, count, 9)


def test_sizes_and_lists_read_one_shuffle(spark, monkeypatch):
    plans, plain = [], sampling.reliable

    def seen(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return plain(frame)

    monkeypatch.setattr(sampling, "reliable", seen)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else reuse is decided while it runs
    try:
        rows = spark.range(500).selectExpr("id % 200 AS item", "concat('l', id % 7) AS label", "id % 7 < 2 AS first")
        sampling.coverage_sample(rows, 20, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plans[0].count("ReusedExchange") == 1 and plans[0].count("Range (0, 500") == 1
