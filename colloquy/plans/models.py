"""Models counted from the events of twenty cohorts of users, some of them spoilt, and what checks find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators import models as M
from colloquy.plans.registry import query
from colloquy.sources.tables import read

COHORTS = 20
#: What observations have to speak of; the tenths of k are their names.
FUNCTIONS = {"low": ("tenth 0", "tenth 1"), "high": ("TENTH 9",), "middle": ("tenth 4", "tenth 5")}
#: Cohorts of which a table lacks a row, sums to less, a state has both roles or none, and that see few tenths.
NO_ROW, LESS, BOTH, BARE, FEW = 1, 2, 3, 4, 5

TABLES = f"""e AS (SELECT user_id % {COHORTS} AS model, user_id, ts, event_id, event_type AS state, 'tenth ' || (TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) // 10) AS tenth FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL),
n AS (SELECT model, state, lead(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM e),
c AS (SELECT model, 'initial' AS kind, '' AS state, state AS target, count(*) AS c FROM e GROUP BY ALL UNION ALL SELECT model, 'transition', state, target, count(*) FROM n WHERE target IS NOT NULL GROUP BY ALL
 UNION ALL SELECT model, 'emission', state, tenth, count(*) FROM e WHERE tenth IS NOT NULL AND (model <> {FEW} OR tenth IN ('tenth 0', 'tenth 4')) GROUP BY ALL),
t AS (SELECT model, kind, state, target, c / sum(c) OVER (PARTITION BY model, kind, state) * CASE WHEN model = {LESS} AND kind = 'emission' AND state = 'view' THEN 0.9 ELSE 1 END AS p FROM c WHERE NOT (model = {NO_ROW} AND kind = 'transition' AND state = 'error')),
r AS (SELECT DISTINCT model, state, CASE WHEN state = 'error' THEN 'negative' ELSE 'positive' END AS role FROM e WHERE NOT (model = {BARE} AND state = 'click') UNION ALL SELECT {BOTH}, 'view', 'negative')"""


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The models' tables and the roles of their states."""
    events = read(spark, sf_dir, "events").where("event_type is not null and user_id is not null")
    tenth = F.concat(F.lit("tenth "), F.floor(F.get_json_object("props", "$.k").try_cast("bigint") / 10).cast("string"))
    rows = events.select((F.col("user_id") % COHORTS).alias("model"), "user_id", "ts", "event_id", F.col("event_type").alias("state"), tenth.alias("tenth"))
    following = rows.withColumn("target", F.lead("state").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    initial = rows.select("model", F.lit("initial").alias("kind"), F.lit("").alias("state"), F.col("state").alias("target"))
    transition = following.where("target is not null").select("model", F.lit("transition").alias("kind"), "state", "target")
    emission = rows.where(F.col("tenth").isNotNull() & ((F.col("model") != FEW) | F.col("tenth").isin("tenth 0", "tenth 4"))).select("model", F.lit("emission").alias("kind"), "state", F.col("tenth").alias("target"))
    counted = initial.unionByName(transition).unionByName(emission).groupBy("model", "kind", "state", "target").agg(F.count("*").alias("c"))
    counted = counted.where(~((F.col("model") == NO_ROW) & (F.col("kind") == "transition") & (F.col("state") == "error")))
    less = (F.col("model") == LESS) & (F.col("kind") == "emission") & (F.col("state") == "view")
    shares = counted.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("model", "kind", "state")) * F.when(less, 0.9).otherwise(1.0))
    roles = rows.where(~((F.col("model") == BARE) & (F.col("state") == "click"))).select("model", "state", F.when(F.col("state") == "error", "negative").otherwise("positive").alias("role")).distinct()
    spoilt = spark.range(1).select(F.lit(BOTH).cast("long").alias("model"), F.lit("view").alias("state"), F.lit("negative").alias("role"))
    return shares.select("model", "kind", "state", "target", "p"), roles.unionByName(spoilt)


@query(f"""WITH {TABLES}, s AS (SELECT DISTINCT model, target AS state FROM t WHERE kind = 'initial')
SELECT DISTINCT model, kind || CASE WHEN kind = 'initial' THEN '' ELSE ' of ' || state END || ': chances don''t sum to 1' AS problem FROM t GROUP BY model, kind, state HAVING abs(sum(p) - 1) > 1e-6
UNION ALL SELECT s.model, 'transition: no row for ' || s.state FROM s ANTI JOIN (SELECT * FROM t WHERE kind = 'transition') x ON x.model = s.model AND x.state = s.state
UNION ALL SELECT s.model, 'emission: no row for ' || s.state FROM s ANTI JOIN (SELECT * FROM t WHERE kind = 'emission') x ON x.model = s.model AND x.state = s.state
UNION ALL SELECT model, 'both roles for ' || state FROM r GROUP BY model, state HAVING count(DISTINCT role) > 1
UNION ALL SELECT DISTINCT r.model, 'a role for an unknown state ' || r.state FROM r ANTI JOIN s ON s.model = r.model AND s.state = r.state
UNION ALL SELECT DISTINCT t.model, 'transition to an unknown state ' || t.target FROM t ANTI JOIN s ON s.model = t.model AND s.state = t.target WHERE t.kind = 'transition'
UNION ALL SELECT DISTINCT s.model, 'no ' || w.role || ' state' FROM s, (VALUES ('positive'), ('negative')) w(role) ANTI JOIN r ON r.model = s.model AND r.role = w.role""")
def model_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.model_problems(*tables(spark, sf_dir))


@query(f"""WITH {TABLES}, z AS (SELECT model, count(DISTINCT target) FILTER (kind = 'initial') AS states, count(DISTINCT target) FILTER (kind = 'emission') AS observations FROM t GROUP BY 1),
b AS (SELECT DISTINCT s.model FROM (SELECT model, target AS state FROM t WHERE kind = 'initial') s ANTI JOIN r ON r.model = s.model AND r.state = s.state),
f AS (SELECT model, bool_or(target IN ('tenth 0', 'tenth 1')) AS low, bool_or(target = 'tenth 9') AS high, bool_or(target IN ('tenth 4', 'tenth 5')) AS middle FROM t WHERE kind = 'emission' GROUP BY 1),
g AS (SELECT model, states, observations, model NOT IN (SELECT model FROM b) AS covered, concat_ws(',', CASE WHEN NOT coalesce(low, false) THEN 'low' END, CASE WHEN NOT coalesce(high, false) THEN 'high' END, CASE WHEN NOT coalesce(middle, false) THEN 'middle' END) AS missing FROM z LEFT JOIN f USING (model))
SELECT *, states BETWEEN 4 AND 7 AND observations BETWEEN 6 AND 10 AND covered AND missing = '' AS passed FROM g""")
def model_coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares, roles = tables(spark, sf_dir)
    descriptions = shares.where("kind = 'emission'").select("model", F.lit("observed").alias("observation"), F.col("target").alias("text")).distinct()
    return M.coverage_gate(shares, roles, descriptions, FUNCTIONS).withColumn("missing", F.array_join("missing", ","))
