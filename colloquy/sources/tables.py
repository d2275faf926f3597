"""Tables of the driver, record files, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("turn_index", T.LongType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task takes where a table is dealt.
TASK_ROWS = 1 << 15


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys over tasks whose number follows the rows: a table of few bytes is read in few tasks, and what a key's rows are made into would be held in them."""
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), *keys)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """One object per line. strict fails at the first bad line; otherwise bad lines are kept in the column _corrupt, so that they can be counted."""
    reader = spark.read.schema(schema)
    if strict:
        return reader.option("mode", "FAILFAST").json(path)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """All columns as text; raises if a required one is absent."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    absent = sorted(set(required) - set(rows.columns))
    if absent:
        raise ValueError(f"columns missing: {', '.join(absent)}")
    return rows


def parse_lines(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Text lines as records: the parsed fields, and the line itself in _corrupt where it is no object of the schema."""
    parsed = lines.withColumn("_parsed", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select(*[c for c in lines.columns if c != column], "_parsed.*")


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """The commit protocol of the writer makes the replacement atomic for readers of the folder's success marker."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_report(parts: list[DataFrame], path: str) -> None:
    """One CSV of frames whose columns differ: the union of their columns, absent ones empty."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    whole.write.mode("overwrite").option("header", True).csv(path)
