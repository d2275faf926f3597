"""Rows that small tables are made into: tasks grow with them, and what is grouped by sample stays where it is."""

import re

import pytest

from colloquy.functions import stats
from colloquy.plans.judging import judge
from colloquy.plans.library import QUERIES
from colloquy.sources import tables


def test_tasks_follow_the_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 16)
    n = tables.read(spark, sf, "part").count()
    assert judge(spark, sf).rdd.getNumPartitions() == -(-n // 16) > 1
    assert judge(spark, sf).count() == 9 * n


@pytest.mark.parametrize("name", ["axis_ablation", "friedman4", "axis_export", "friedman3", "holm", "stats_report"])
def test_samples_are_not_shuffled_again(spark, sf, name, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 16)
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_partkey" in plan and not re.search(r"hashpartitioning\([^)]*sample_id", plan)


def test_complete_cases_keys_and_values(spark):
    """A block without a key or with an absent value is none."""
    rows = [("x", 1, m, 1.0) for m in "abc"] + [("x", None, m, 1.0) for m in "abc"] + [("x", 2, m, None if m == "a" else 1.0) for m in "abc"] + [("x", 3, m, 2.0) for m in "aab"]
    got = stats.complete_cases(spark.createDataFrame(rows, "axis string, k int, model_name string, value double"), ["axis", "k"], 3)
    assert sorted(map(tuple, got.collect())) == [("x", 1, m, 1.0) for m in "abc"]
