"""Samples under shared limits, distinctness of responses, a tail of growing lines, a selection restored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.fidelity import fidelity_errors
from colloquy.operators import matching, sampling
from colloquy.plans.conversations import turns
from colloquy.plans.judging import JUDGE, judge
from colloquy.plans.registry import TURNS, query
from colloquy.plans.streams import folder, qualifying, rocksdb
from colloquy.sources.tables import parse_lines, read
from colloquy.streaming import jobs, lines, progress

STRATA, COUNT, CAP, SEED, RESERVE = ("en", "fr", "de", "es"), 50, 3, 7, 20


def stratified_sql() -> str:
    """The strata one after the other, each under what the ones before leave of the cap, then the fill and the reserve."""
    drawn = lambda k: f"sha256('{SEED + k}:' || doc_id)"
    used = lambda before: " + ".join([f"(SELECT count(*) FROM {t} u WHERE u.source = d.source)" for t in before] or ["0"])
    none = lambda before: "".join(f" AND doc_id NOT IN (SELECT doc_id FROM {t})" for t in before)
    parts, before = [], []

    def taken(name: str, where: str, k: int, most: str) -> None:
        own = f"SELECT doc_id, source, lang, {used(before)} AS used, row_number() OVER (PARTITION BY source ORDER BY {drawn(k)}) AS place FROM documents d WHERE {where}"
        parts.append(f"{name} AS MATERIALIZED (SELECT doc_id, source, lang FROM ({own}) WHERE place <= {CAP} - used ORDER BY {drawn(k)} LIMIT {most})")
        before.append(name)

    for k, lang in enumerate(STRATA):
        taken(f"s{k}", f"lang = '{lang}'", 0, str(COUNT // len(STRATA) + (k < COUNT % len(STRATA))))
    primary = " UNION ALL ".join(f"SELECT * FROM {t}" for t in before)
    taken("fill", f"true{none(before)}", 1, f"(SELECT {COUNT} - count(*) FROM ({primary}))")
    primary += " UNION ALL SELECT * FROM fill"
    taken("reserve", f"true{none(before)}", 3, str(RESERVE))
    return f"""WITH {', '.join(parts)} SELECT doc_id AS sample_id, source AS "group", lang AS stratum, 'primary' AS role, CAST(row_number() OVER (ORDER BY {drawn(2)}) AS INTEGER) AS position FROM ({primary})
UNION ALL SELECT doc_id, source, lang, 'reserve', NULL FROM reserve"""


@query(stratified_sql())
def stratified_eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents, languages as strata and at most three of a source in all, with a reserve of twenty."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("group"), F.col("lang").alias("stratum"))
    return sampling.stratified_sample(rows, list(STRATA), COUNT, CAP, SEED, RESERVE).drop("order")


@query()
def coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred customers that cover the priorities of their orders first, then their segments and nations, rare ones before common ones."""
    customers = read(spark, sf_dir, "customer")
    kinds = [
        read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.concat(F.lit("priority:"), "o_orderpriority").alias("label"), F.lit(True).alias("first")),
        customers.select(F.col("c_custkey").alias("item"), F.concat(F.lit("segment:"), "c_mktsegment").alias("label"), F.lit(False).alias("first")),
        customers.select(F.col("c_custkey").alias("item"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("label"), F.lit(False).alias("first")),
    ]
    return sampling.coverage_sample(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).where("label is not null"), 100, SEED)


@query()
def text_distinctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three answers of a conversation, taken as those of three models."""
    answers = turns(spark, sf_dir).where("role = 'assistant'").groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn_index", "text"))), 1, 3).alias("xs")).where("size(xs) = 3")
    rows = answers.select("conv_id", *(F.element_at("xs", k)["text"].alias(name) for k, name in enumerate(("base", "basis", "random"), 1)))
    found = matching.distinctness(rows, ["conv_id"], ["base", "basis", "random"])
    return found.select("conv_id", *(F.round(c, 8).alias(c) for c in found.columns if c != "conv_id"))


@query(f"WITH {TURNS} SELECT conv_id, turn_index, CAST(length(text) AS INTEGER) AS n, false AS bad FROM turns UNION ALL SELECT NULL, NULL, NULL, true FROM conversations WHERE role = 'system'")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as lines of objects to a folder that grows between two runs of a stream over it; system turns stand for broken lines."""
    top = folder(spark)
    spark.dataSource.register(lines.GrowingLines)
    good = turns(spark, sf_dir).select(F.to_json(F.struct("conv_id", "turn_index", "text")).alias("value"), (F.col("conv_id") % 2).alias("late"))
    broken = read(spark, sf_dir, "conversations").where("role = 'system'").select(F.lit('{"conv_id": 1, "tu').alias("value"), F.lit(0).alias("late"))
    rows = good.unionByName(broken.withColumn("late", F.col("late").cast("long")))
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("_corrupt", T.StringType())])
    for late in (0, 1):
        rows.where(F.col("late") == late).select("value").write.mode("append").text(f"{top}/lines")
        stream = spark.readStream.format("growing_lines").load(f"{top}/lines")
        out = parse_lines(stream.select("line"), "line", schema).select("conv_id", "turn_index", F.length("text").alias("n"), F.col("_corrupt").isNotNull().alias("bad"))
        out = out.select(*(F.when(~F.col("bad"), F.col(c)).alias(c) for c in ("conv_id", "turn_index", "n")), "bad")
        out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out")


@query(f"WITH {TURNS} SELECT conv_id, turn_index FROM turns WHERE role = 'assistant' AND length(text) >= 60 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn_index) <= 2")
def stream_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped selection, stopped after the first turns of each conversation; its checkpoint is lost and its state comes from what it wrote. All turns come again."""
    top = folder(spark)
    rows = qualifying(spark, sf_dir)
    rows.repartition(2, "conv_id").write.parquet(f"{top}/second")
    laid = spark.read.schema(rows.schema).parquet(f"{top}/second")
    laid.where("turn_index < 3").repartition(2, "conv_id").write.parquet(f"{top}/first")
    with rocksdb(spark, laid.count()):
        def run(name: str, before: DataFrame | None) -> DataFrame:
            out = jobs.capped_selection(jobs.read_parts(spark, f"{top}/{name}", rows.schema), 2, before)
            out.writeStream.format("parquet").option("path", f"{top}/out-{name}").option("checkpointLocation", f"{top}/state-{name}").trigger(availableNow=True).start().awaitTermination()
            return spark.read.schema(out.schema).parquet(f"{top}/out-{name}")

        selected = run("first", None)
        ledger = spark.read.schema(rows.schema).parquet(f"{top}/first")
        return selected.unionByName(run("second", jobs.selection_state(selected, ledger)))


@query(f"""WITH {TURNS}, x AS (SELECT conv_id, turn_index, CAST(12 + conv_id % 40 AS VARCHAR) AS n, CAST(2 + turn_index % 9 AS VARCHAR) AS d, (conv_id + turn_index) % 4 AS v FROM turns)
SELECT conv_id, turn_index, CASE v WHEN 1 THEN n WHEN 3 THEN d ELSE '' END AS numbers, CASE WHEN v = 2 THEN 'negation' ELSE '' END AS negation, CASE WHEN v = 3 THEN 'time' ELSE '' END AS temporal_expression,
CASE WHEN v = 1 THEN 'mg' ELSE '' END AS units, CASE WHEN v = 2 THEN 'metformin' ELSE '' END AS medications, CASE WHEN v = 2 THEN 'fever' ELSE '' END AS symptoms FROM x""")
def medical_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each turn and its rendering, of which three in four lose something; what is lost is found from the two texts."""
    n, d = (12 + F.col("conv_id") % 40).cast("string"), (2 + F.col("turn_index") % 9).cast("string")
    said = F.concat(F.lit("I take "), n, F.lit(" mg of metformin and had no fever for "), d, F.lit(" days"))
    v = (F.col("conv_id") + F.col("turn_index")) % 4
    rendered = (
        F.when(v == 0, F.concat(n, F.lit("ミリグラムのメトホルミンを飲み、"), d, F.lit("日間熱はありません")))
        .when(v == 1, F.concat(F.lit("メトホルミンを飲み、"), d, F.lit("日間熱はありません")))
        .when(v == 2, F.concat(n, F.lit("mgの薬を飲み、"), d, F.lit("日間元気です")))
        .otherwise(F.concat(n, F.lit("mgのメトホルミン、熱はない")))
    )
    rows = turns(spark, sf_dir).select("conv_id", "turn_index", fidelity_errors(said, rendered).alias("e"))
    kinds = ("numbers", "negation", "temporal_expression", "units", "medications", "symptoms")
    return rows.select("conv_id", "turn_index", *(F.array_join(f"e.{k}", ",").alias(k) for k in kinds))


@query(f"""WITH {JUDGE}, w AS (SELECT sample_id, axis, max(value) FILTER (model_name = 'basis') AS a, max(value) FILTER (model_name = 'base') AS b FROM judge GROUP BY 1, 2)
SELECT axis, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a) - avg(b), 6) AS gap, round(count(*) FILTER (a > b) / count(*), 6) AS wins_rate, round(count(*) FILTER (a = b) / count(*), 6) AS ties_rate, round(count(*) FILTER (a < b) / count(*), 6) AS losses_rate
FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of two models as they come, some of them twice; what stands in the table after the last batch."""
    top = folder(spark)
    of = lambda m: F.max(F.when(F.col("model_name") == m, F.col("value")))
    rows = judge(spark, sf_dir).groupBy("sample_id", "axis").agg(of("basis").alias("a"), of("base").alias("b")).where("a is not null and b is not null")
    rows = rows.select("sample_id", "axis", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sample_id") % 60).alias("at"), "a", "b")
    rows.unionByName(rows.where("sample_id % 3 = 0")).repartition(3).write.parquet(f"{top}/in")
    summary = progress.running_summary(jobs.read_parts(spark, f"{top}/in", rows.schema))
    summary.writeStream.outputMode("update").foreachBatch(progress.keep_latest(f"{top}/summary", ["axis"])).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    found = progress.rates(progress.latest(spark, f"{top}/summary", summary.schema))
    return found.select("axis", "n", *(F.round(c, 6).alias(c) for c in found.columns[2:]))
