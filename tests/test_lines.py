"""The source of growing lines and the sink of epochs; restoring the state of a selection."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.sources.tables import parse_lines
from colloquy.streaming import jobs, lines


@pytest.fixture
def tail(spark, tmp_path):
    """Runs the tail of tmp_path/in to its end, as a new query over one checkpoint each time, and gives the lines of this run."""
    spark.dataSource.register(lines.GrowingLines)

    def run(split=lines.SPLIT):
        got = []
        stream = spark.readStream.format("growing_lines").option("split", split).load(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return [r.line for r in sorted(got, key=lambda r: (r.file, r.start))]

    return run


def test_tail(tmp_path, tail):
    path = tmp_path / "in"
    assert tail() == []
    path.write_text('{"a": 1}\n\n{"a": 2}\n{"a"')
    assert tail() == ['{"a": 1}', '{"a": 2}']
    assert tail() == []
    with path.open("a") as f:
        f.write(': 3}\nbad {\n{"a": 4')
    assert tail() == ['{"a": 3}', "bad {"]
    with path.open("a") as f:
        f.write("}\n" + "é" * 200_000 + "\n")
    assert tail() == ['{"a": 4}', "é" * 200_000]
    path.write_text('{"a": 5}\n{"a": 6}\nhalf')  # cut off: from the beginning
    assert tail() == ['{"a": 5}', '{"a": 6}']
    os.remove(path)
    assert tail() == []


def test_tail_in_splits_of_a_folder(tmp_path, tail):
    (tmp_path / "in").mkdir()
    want = []
    for k in range(3):
        own = [f"line {k} {'x' * (j * 7 % 31)}" for j in range(40)]
        want += own
        (tmp_path / "in" / f"f{k}").write_text("\n".join(own) + "\nunfinished")
    (tmp_path / "in" / "_list").write_text("hidden\n")
    for split in (1, 2, 7, 64, 500):
        reader = lines.TailReader(str(tmp_path / "in"), split)
        parts = reader.partitions({}, reader.latestOffset())
        assert [x for p in parts for batch in reader.read(p) for x in batch.column(2).to_pylist()] == want
    assert tail(300) == want


def test_bad_lines_are_kept_apart(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("bad {",)], "line string")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("_corrupt", T.StringType())])
    assert sorted(map(tuple, parse_lines(rows, "line", schema).collect()), key=repr) == [(1, None), (None, "bad {")]


def test_epochs_are_written_once(tmp_path):
    top = tmp_path / "out"
    writer = lines.EpochWriter(str(top))
    killed = writer.write(iter([("lost",)]))  # a task whose commit message never came
    a, b, none = writer.write(iter([("one",), (None,), ("two\n",)])), writer.write(iter([("three",)])), writer.write(iter([]))
    writer.commit([a, b, none, None], 0)
    again = writer.write(iter([("one",), ("two",)]))
    writer.commit([again], 0)  # the epoch is run again after a restart
    failed = writer.write(iter([("four",)]))
    writer.abort([failed, None], 1)
    writer.commit([writer.write(iter([("five\r\n",)]))], 1)
    read = [x for f in lines.committed(str(top)) for x in open(f.removeprefix("file://")).read().splitlines()]
    assert read == ["one", "two", "three", "five"]
    assert sorted(os.listdir(top)) == sorted(["_epochs", killed.file, *(os.path.basename(f) for f in lines.committed(str(top)))])
    assert lines.committed(str(tmp_path / "nowhere")) == []


def test_sink_of_a_stream(spark, tmp_path):
    spark.dataSource.register(lines.GrowingLines)
    spark.range(100).select(F.to_json(F.struct("id")).alias("value")).repartition(4).write.text(str(tmp_path / "in"))
    stream = spark.readStream.format("text").schema("value string").option("maxFilesPerTrigger", 1).load(str(tmp_path / "in"))
    for _ in range(2):
        stream.writeStream.format("growing_lines").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    read = [json.loads(x)["id"] for f in lines.committed(str(tmp_path / "out")) for x in open(f.removeprefix("file://"))]
    assert sorted(read) == list(range(100))


def test_state_is_restored(spark, tmp_path):
    """A selection is stopped and its checkpoint lost: what was selected and looked at before doesn't come again, and counts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "conv_id long, turn_index int, qualifies boolean"
        rows = [(c, t, (c + t) % 2 == 0) for c in range(4) for t in range(6)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = jobs.read_parts(spark, str(tmp_path / "in"), T._parse_datatype_string(schema))
        selected = spark.createDataFrame([(0, 0), (1, 1), (1, 3), (1, 3)], "conv_id long, turn_index int")
        ledger = spark.createDataFrame([(0, 0), (0, 2), (2, None), (3, 1), (9, 4)], "conv_id long, turn_index int")
        # 0: one before, turn 2 looked at; 1: full; 2: none before; 3: turn 1 looked at
        want = [(0, 4), (2, 0), (2, 2), (3, 3), (3, 5)]
        for name, ttl in (("kept", None), ("aged", 3600)):
            out = jobs.capped_selection(stream, 2, jobs.selection_state(selected, ledger), ttl)
            writer = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"state-{name}"))
            read = lambda: sorted(map(tuple, spark.read.schema(out.schema).parquet(str(tmp_path / name)).collect()))  # noqa: B023, E731
            if ttl:
                query, end = writer.start(), time.time() + 90
                while time.time() < end and not ((tmp_path / name / "_spark_metadata" / "0").exists() and read() == want):
                    time.sleep(1)
                query.stop()
            else:
                writer.trigger(availableNow=True).start().awaitTermination()
            assert read() == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
