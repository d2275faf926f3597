"""A summary that goes on while judgments come in, and a log of a stream's runs with a gate for those that stand still."""

from __future__ import annotations

import itertools
import json
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from colloquy.streaming.lines import opened


def running_summary(judgments: DataFrame, late: str = "1 hour") -> DataFrame:
    """judgments: a stream of sample_id, axis, at (event time), a, b (the scores of two models). Returns axis, n, sum_a, sum_b, wins, ties, losses so far, for update mode.

    A judgment that is sent again within late counts once. There is a group for each axis, so the state of the sums is small;
    the watermark bounds that of the judgments seen.
    """
    once = judgments.withWatermark("at", late).dropDuplicatesWithinWatermark(["sample_id", "axis"])
    d = F.col("a") - F.col("b")
    return once.groupBy("axis").agg(F.count("*").alias("n"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"))


def rates(summary: DataFrame) -> DataFrame:
    """axis, n, means of both, their difference, and the shares of wins, ties and losses."""
    part = lambda c: F.col(c) / F.col("n")
    return summary.select("axis", "n", part("sum_a").alias("mean_a"), part("sum_b").alias("mean_b"), ((F.col("sum_a") - F.col("sum_b")) / F.col("n")).alias("gap"), *(part(c).alias(f"{c}_rate") for c in ("wins", "ties", "losses")))


def versions(path: str) -> list[int]:
    """The finished versions of a table that keep_latest writes, ascending."""
    store, top = opened(path)
    found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return sorted(int(x.base_name[1:]) for x in found if x.type == fs.FileType.Directory and x.base_name[1:].isdigit() and store.get_file_info(f"{x.path}/_SUCCESS").type == fs.FileType.File)


def keep_latest(path: str, key: list[str]):
    """For foreachBatch over update mode: version n of a table holds the latest row of each key after batch n. A batch that is run again writes its version again; the last two versions stay."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(path) if v < batch_id]
        rows = batch
        if before:
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{before[-1]}").join(batch.select(*key), key, "left_anti"))
        rows.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        store, top = opened(path)
        for old in before[:-1]:
            store.delete_dir(f"{top}/v{old}")

    return merge


def latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    known = versions(path)
    return spark.read.schema(schema).parquet(f"{path}/v{known[-1]}") if known else spark.createDataFrame([], schema)


LOG = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("name", T.StringType()), T.StructField("event", T.StringType()), T.StructField("at", T.StringType()),
    T.StructField("batch", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("metrics", T.MapType(T.StringType(), T.StringType())), T.StructField("problem", T.StringType()),
])


class RunLog(StreamingQueryListener):
    """Writes a small file for each event of the session's streams: started, progress (with the metrics that observe() names), idle, terminated (with its error)."""

    def __init__(self, path: str) -> None:
        self.path, self.count = path, itertools.count()

    def _write(self, run: object, event: str, at: str, **more: object) -> None:
        store, top = opened(self.path)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/{run}-{next(self.count):06d}.json") as f:
            f.write(json.dumps({"run": str(run), "event": event, "at": at} | more).encode() + b"\n")

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self._write(event.runId, "started", event.timestamp, name=event.name)

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        metrics = {f"{name}.{k}": str(v) for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        self._write(p.runId, "progress", p.timestamp, name=p.name, batch=p.batchId, rows=p.numInputRows, metrics=metrics)

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        self._write(event.runId, "idle", event.timestamp)

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self._write(event.runId, "terminated", datetime.now(UTC).isoformat(timespec="milliseconds"), problem=event.exception)


def run_rows(spark: SparkSession, path: str) -> DataFrame:
    """The log as rows, at as a timestamp."""
    return spark.read.schema(LOG).json(path).withColumn("at", F.to_timestamp("at"))


def run_states(log: DataFrame, now: datetime, stall_seconds: int) -> DataFrame:
    """For each run: name, batches and rows so far, the last sign of life, and state: done, failed, stalled (no sign for longer than stall_seconds) or running."""
    runs = log.groupBy("run").agg(
        F.max("name").alias("name"), F.count_distinct("batch").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("at").alias("last"),
        F.bool_or(F.col("event") == "terminated").alias("ended"), F.bool_or((F.col("event") == "terminated") & F.col("problem").isNotNull()).alias("failed"),
    )
    quiet = F.lit(now).cast("timestamp").cast("double") - F.col("last").cast("double") > stall_seconds
    state = F.when(F.col("failed"), "failed").when(F.col("ended"), "done").when(quiet, "stalled").otherwise("running")
    return runs.select("run", "name", "batches", "rows", "last", state.alias("state"))
