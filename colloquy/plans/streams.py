"""Queries that run a stream to its end over a table and return what it wrote."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators.turns import from_conversations
from colloquy.plans.registry import TURNS, query
from colloquy.plans.pairs import PAIRS, accepted, scored_pairs
from colloquy.plans.scoring import MODEL, filter_sql, labelled
from colloquy.sources.tables import read
from colloquy.streaming import jobs


def folder(spark: SparkSession) -> str:
    """A folder for a stream's state and output: in the shared one, or where that is unset (local tests) a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="colloquy-")
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"


#: Rows of a stream for which a part of its state is made: each part costs a worker and a store in every batch, however little it holds.
STATE_ROWS = 1 << 16


@contextmanager
def rocksdb(spark: SparkSession, rows: int) -> Iterator[None]:
    """State of arbitrary operators needs this store; its parts follow the rows, one for each core at least, and are no more than the session's."""
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value:
                spark.conf.set(name, value)
            else:
                spark.conf.unset(name)


def qualifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turns and whether they are long enough. Lengths are taken first, so that no text is sorted."""
    lengths = read(spark, sf_dir, "conversations").withColumn("text", F.length("text"))
    return from_conversations(lengths).where("role = 'assistant'").select("conv_id", "turn_index", (F.col("text") >= 60).alias("qualifies"))


def run(rows: DataFrame, job, parts: int = 3) -> DataFrame:
    """Lays rows down as part files, takes them as a stream in micro-batches, and returns the output."""
    spark, top = rows.sparkSession, folder(rows.sparkSession)
    rows.repartition(parts, "conv_id").write.parquet(f"{top}/in")
    with rocksdb(spark, spark.read.schema(rows.schema).parquet(f"{top}/in").count()):
        out = job(jobs.read_parts(spark, f"{top}/in", rows.schema))
        out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out")


@query(f"WITH {TURNS} SELECT conv_id, turn_index FROM turns WHERE role = 'assistant' AND length(text) >= 60 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn_index) <= 2")
def stream_capped_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(qualifying(spark, sf_dir), lambda stream: jobs.capped_selection(stream, 2))


@query(filter_sql() + " SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn_index) - 1 AS INTEGER) AS nth, round(posterior, 8) AS posterior FROM scored")
def stream_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn_index")) - 1).alias("nth")
    rows = labelled(spark, sf_dir).select("conv_id", nth, "observation")
    return run(rows, lambda stream: jobs.online_filter(stream, MODEL)).withColumn("posterior", F.round("posterior", 8))


@query(f"WITH {PAIRS} SELECT prompt, o_orderkey, round(score_chosen - score_rejected, 6) AS gap FROM pairs WHERE score_chosen >= 0.7 AND ((score_rejected <= 0.55 AND score_chosen - score_rejected >= 0.25) OR (score_rejected <= 0.65 AND score_chosen - score_rejected >= 0.3)) QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY round(score_chosen - score_rejected, 6) DESC, o_orderkey) = 1")
def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted pairs as they come; the best of each prompt is kept from batch to batch."""
    top = folder(spark)
    rows = accepted(scored_pairs(spark, sf_dir)).where("acceptance_rule is not null").select("prompt", "o_orderkey", F.round(F.col("score_chosen") - F.col("score_rejected"), 6).alias("gap"))
    rows.repartition(3, "o_orderkey").write.parquet(f"{top}/in")
    stream = jobs.read_parts(spark, f"{top}/in", rows.schema)
    done = stream.writeStream.foreachBatch(jobs.keep_best(f"{top}/best", ["prompt"], "gap", ["o_orderkey"])).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    batches = [p["batchId"] for p in done.recentProgress if p["numInputRows"]]
    if not batches:
        return rows.limit(0)
    return spark.read.schema(rows.schema).parquet(f"{top}/best/v{max(batches)}")


