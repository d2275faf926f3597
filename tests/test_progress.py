"""A summary in progress after each batch, and the log of runs."""

import time
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.streaming import jobs, progress

SCHEMA = "sample_id long, axis string, at timestamp, a double, b double"


def test_summary_after_each_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [
        [(1, "x", start, 3.0, 1.0), (2, "x", start, 1.0, 1.0), (1, "y", start, 0.0, 2.0)],
        [(1, "x", start, 3.0, 1.0), (3, "x", start + timedelta(minutes=5), 1.0, 4.0)],  # the first one again
        [(4, "z", start + timedelta(minutes=9), 2.0, 1.0)],
    ]
    seen, kept = set(), []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = progress.running_summary(jobs.read_parts(spark, str(tmp_path / "in"), T._parse_datatype_string(SCHEMA)))
        stream.writeStream.outputMode("update").foreachBatch(progress.keep_latest(str(tmp_path / "table"), ["axis"])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        for sample, axis, _, a, b in batch:
            if (sample, axis) not in seen:
                seen.add((sample, axis))
                kept.append((axis, a, b))
        got = {r.axis: (r.n, r.mean_a, r.mean_b, r.gap, r.wins_rate) for r in progress.rates(progress.latest(spark, str(tmp_path / "table"), stream.schema)).collect()}
        n = Counter(axis for axis, *_ in kept)
        of = lambda axis, f: sum(f(a, b) for x, a, b in kept if x == axis) / n[axis]  # noqa: B023, E731
        assert got == {axis: (n[axis], of(axis, lambda a, b: a), of(axis, lambda a, b: b), pytest.approx(of(axis, lambda a, b: a - b)), of(axis, lambda a, b: a > b)) for axis in n}, k
    assert len(progress.versions(str(tmp_path / "table"))) <= 2
    assert progress.latest(spark, str(tmp_path / "nowhere"), stream.schema).count() == 0


def test_log_of_runs(spark, tmp_path):
    log = progress.RunLog(str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        spark.range(10).coalesce(1).write.parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).observe("seen", F.count("*").alias("n"), F.count_if(F.col("id") >= 7).alias("high"))
        rows.writeStream.queryName("fine").format("noop").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start().awaitTermination()
        broken = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).select(F.raise_error(F.lit("no")))
        with pytest.raises(Exception, match="no"):
            broken.writeStream.queryName("broken").format("noop").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start().awaitTermination()
        end = time.time() + 30
        while time.time() < end and progress.run_rows(spark, str(tmp_path / "log")).where("event = 'terminated'").count() < 2:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    rows = progress.run_rows(spark, str(tmp_path / "log"))
    assert rows.where("name = 'fine' and event = 'progress' and rows > 0").first().metrics == {"seen.n": "10", "seen.high": "3"}
    got = {r.name: (r.rows, r.state) for r in progress.run_states(rows, datetime.now(UTC), 60).collect()}
    assert got == {"fine": (10, "done"), "broken": (0, "failed")}


def test_runs_that_stand_still(spark):
    now = datetime(2024, 5, 1, 12)
    rows = [("a", "n", "started", now - timedelta(seconds=90), None, None), ("a", None, "progress", now - timedelta(seconds=61), 0, 5), ("b", None, "idle", now - timedelta(seconds=59), None, None)]
    log = spark.createDataFrame([(*r, None) for r in rows], "run string, name string, event string, at timestamp, batch long, rows long, problem string")
    got = {r.run: (r.batches, r.rows, r.state) for r in progress.run_states(log, now, 60).collect()}
    assert got == {"a": (1, 5, "stalled"), "b": (0, 0, "running")}
