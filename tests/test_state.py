"""State of streams: a block of conversations is one round trip, turns age one by one, parts follow the rows."""

from pyspark.sql import Row

from colloquy.plans import streams
from colloquy.plans.scoring import MODEL
from colloquy.streaming import jobs


class Handle:
    """The state of one key, and how often it was asked."""

    def __init__(self):
        self.asked, self.kept = 0, {}

    def getValueState(self, name, schema, ttl=None):  # noqa: N802
        return Variable(self, name)

    getMapState = getListState = getValueState  # noqa: N815


class Variable:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def __getattr__(self, call):
        self.handle.asked += 1
        kept, mine = self.handle.kept, self.handle.kept.setdefault(self.name + ":", {})
        return {
            "exists": lambda: self.name in kept, "get": lambda: kept.get(self.name), "update": lambda value: kept.update({self.name: value}),
            "containsKey": lambda key: key in mine, "getValue": lambda key: mine[key], "updateValue": lambda key, value: mine.update({key: value}), "removeKey": lambda key: mine.pop(key),
        }[call]


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms


def selected(processor, turns, ms=0):
    rows = [Row(conv_id=c, turn_index=t, qualifies=True) for c, t in turns]
    return [tuple(r) for r in processor.handleInputRows((0,), iter(rows), Clock(ms))]


def test_a_batch_asks_the_state_twice():
    processor, handle = jobs.CappedSelection(2), Handle()
    processor.init(handle)
    turns = [(c, t) for c in range(16) for t in range(40)]
    assert sorted(selected(processor, turns)) == [(c, t) for c in range(16) for t in range(2)]
    assert selected(processor, turns) == []
    assert handle.asked <= 4


def test_turns_age_one_by_one():
    """A turn is forgotten a time after it came, the count only a time after its conversation's last batch."""
    processor = jobs.CappedSelection(3, ttl_seconds=10)
    processor.init(Handle())
    assert selected(processor, [(1, 0), (2, 0)], 0) == [(1, 0), (2, 0)]
    assert selected(processor, [(1, 1)], 6_000) == [(1, 1)]
    assert selected(processor, [(1, 0), (1, 1), (2, 0)], 12_000) == [(1, 0), (2, 0)]  # 1: turn 0 has aged, turn 1 has not
    assert selected(processor, [(1, 5)], 13_000) == []  # three in all
    assert selected(processor, [(1, 5)], 24_000) == [(1, 5)]


def test_only_early_turns_wait():
    processor, handle = jobs.OnlineFilter(MODEL), Handle()
    processor.init(handle)
    said = lambda *nths: [r.nth for r in processor.handleInputRows((7,), iter([Row(conv_id=7, nth=k, observation=MODEL.observations[k % 2]) for k in nths]), None)]
    assert said(*range(30)) == list(range(30)) and handle.asked <= 3
    assert said(32, 31, 3) == [] and said(30) == [30, 31, 32] and said(31) == []


def test_parts_of_state_follow_the_rows(spark, monkeypatch):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "600")
        for rows, want in ((10, spark.sparkContext.defaultParallelism), (100 * streams.STATE_ROWS, 100), (10_000 * streams.STATE_ROWS, 600)):
            with streams.rocksdb(spark, rows):
                assert int(spark.conf.get(name)) == want
            assert spark.conf.get(name) == "600"
    finally:
        spark.conf.set(name, before)


def test_no_text_is_sorted(spark, sf):
    plan = streams.qualifying(spark, sf)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):].split("\n")[1]
    assert "length(text" in below
