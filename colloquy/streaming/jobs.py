"""Pairs and scores from streams of turns: capped selection, an online forward filter, and a sink that keeps the best."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from colloquy.operators.scoring import EPSILON, HIGH, LOW, TransitionModel


def read_parts(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder to which finished part files are added; a growing file has to be rotated."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Conversations with neighbouring ids that share a state are 2 to this power at most.
SHARED = 4


class CappedSelection(StatefulProcessor):
    """Passes on the first turns of a conversation that qualify, each turn once; what counts is the selected, whatever becomes of them.

    Each question to the state is a round trip that costs more than the turns of a conversation, so a few neighbouring
    conversations are one state, which a batch reads and writes once. A turn ages from when it came, a count from its conversation's last batch.
    """

    def __init__(self, cap: int, ttl_seconds: int | None = None) -> None:
        self.cap, self.ttl = cap, 1000 * ttl_seconds if ttl_seconds else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("known", "known array<struct<conv_id bigint, n int, last bigint, turns array<int>, at array<bigint>>>", self.ttl)

    def now(self, timerValues: TimerValues) -> int:  # noqa: N803
        return timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:  # noqa: N802, N803
        """initialState: known, the conversations with their turns and how many of these are selected."""
        now = self.now(timerValues)
        self.state.update(([(c["conv_id"], c["n"], now, c["turns"], [now] * len(c["turns"])) for c in initialState.known],))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        now, stored = self.now(timerValues), self.state.get()
        young = lambda at: not self.ttl or at + self.ttl > now
        known = {c: (n, last, {t: k for t, k in zip(turns, at, strict=True) if young(k)}) for c, n, last, turns, at in (stored[0] if stored else ()) if young(last)}
        for row in sorted(rows, key=lambda r: r.turn_index):
            n, _, seen = known.get(row.conv_id, (0, now, {}))
            chosen = row.turn_index not in seen and n < self.cap and bool(row.qualifies)
            seen.setdefault(row.turn_index, now)
            known[row.conv_id] = (n + chosen, now, seen)
            if chosen:
                yield Row(conv_id=row.conv_id, turn_index=row.turn_index)
        self.state.update(([(c, n, last, list(seen), list(seen.values())) for c, (n, last, seen) in known.items()],))

    def close(self) -> None:
        pass


def selection_state(selected: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a selection knew, from what it has left: conv_id, turn_index, selected of each turn in its output (selected) or its ledger of turns looked at. Rows without a conversation or turn are left out."""
    both = selected.select("conv_id", "turn_index", F.lit(True).alias("selected")).unionByName(ledger.select("conv_id", "turn_index", F.lit(False).alias("selected")))
    return both.where("conv_id is not null and turn_index is not null").groupBy("conv_id", "turn_index").agg(F.max("selected").alias("selected"))


def capped_selection(turns: DataFrame, cap: int, before: DataFrame | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """turns: a stream of conv_id, turn_index, qualifies. before: the state to begin with (selection_state), where a checkpoint is lost.

    Without ttl_seconds the state of each conversation is kept for good; with it, a turn that comes again later than that counts as
    new, and the query runs until it is stopped: state that ages asks for batches without data, so availableNow doesn't end.
    """
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn_index", T.IntegerType())])
    shared = F.shiftright(F.col("conv_id").cast("long"), SHARED).alias("shared")
    start = None
    if before is not None:
        each = before.groupBy("conv_id").agg(F.count_if("selected").cast("int").alias("n"), F.collect_list("turn_index").alias("turns"))
        start = each.groupBy(shared).agg(F.collect_list(F.struct("conv_id", "n", "turns")).alias("known")).groupBy("shared")
    return turns.select("*", shared).groupBy("shared").transformWithState(CappedSelection(cap, ttl_seconds), schema, "Append", "ProcessingTime" if ttl_seconds else "None", start)


class OnlineFilter(StatefulProcessor):
    """The forward filter with its distribution as state; turns that come early wait for those before them, and only these are put down one by one."""

    def __init__(self, model: TransitionModel) -> None:
        self.model = model.normalised()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carried = handle.getValueState("carried", "next int, p array<double>, waiting int")
        self.waiting = handle.getMapState("waiting", "turn_index int", "observation string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        m, n = self.model, range(len(self.model.states))
        at, p, waiting = self.carried.get() or (0, m.initial, 0)
        come = {row.nth: row.observation for row in rows if row.nth >= at}
        while at in come or waiting and self.waiting.containsKey((at,)):
            if waiting and self.waiting.containsKey((at,)):
                observation = self.waiting.getValue((at,))[0]
                self.waiting.removeKey((at,))
                waiting -= 1
                observation = come.pop(at, observation)
            else:
                observation = come.pop(at)
            o = m.observations.index(observation)
            q = [sum(p[i] * m.transition[i][j] for i in n) for j in n]
            q = [max(EPSILON, x / sum(q)) for x in q]
            w = [q[j] * m.emission[j][o] for j in n]
            p = [max(EPSILON, x / sum(w)) for x in w] if sum(w) > EPSILON else q
            yield Row(conv_id=key[0], nth=at, posterior=float(min(HIGH, max(LOW, sum(p[m.states.index(s)] for s in m.positive)))))
            at += 1
        for nth, observation in come.items():
            waiting += not self.waiting.containsKey((nth,))
            self.waiting.updateValue((nth,), (observation,))
        self.carried.update((at, [float(x) for x in p], waiting))

    def close(self) -> None:
        pass


def online_filter(labelled: DataFrame, model: TransitionModel) -> DataFrame:
    """labelled: a stream of conv_id, nth (0, 1, ... within a conversation), observation, in any order."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("nth", T.IntegerType()), T.StructField("posterior", T.DoubleType())])
    return labelled.groupBy("conv_id").transformWithState(OnlineFilter(model), schema, "Append", "None")


def keep_best(path: str, key: list[str], value: str, ordinal: list[str]):
    """For foreachBatch: a table that holds the best row of each key so far. A batch that is run again changes nothing."""
    from colloquy.operators.pairs import best_of

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = f"{path}/v{batch_id}"
        before = f"{path}/v{batch_id - 1}"
        rows = batch if batch_id == 0 else batch.unionByName(spark.read.parquet(before))
        best_of(rows, key, value, ordinal).write.mode("overwrite").parquet(current)

    return merge
