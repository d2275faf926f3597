"""Conversations to samples, prompts and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import turns as T
from colloquy.plans.registry import SPLIT, TURNS, query
from colloquy.sources.tables import read


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_conversations(read(spark, sf_dir, "conversations"))


LINES = """string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'AI' END || ': ' || text, chr(10) ORDER BY turn_index)"""


@query(f"""WITH {TURNS}, w AS (
  SELECT *, lag(role) OVER o AS previous_role, CASE WHEN lead(role) OVER o = 'user' THEN lead(text) OVER o END AS next_user_turn,
    count(*) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_history
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn_index)), s AS (
  SELECT *, CASE WHEN {SPLIT} < 8 THEN 'train' ELSE 'test' END AS split, coalesce(previous_role = 'user', false) AS history_ends_with_user FROM w WHERE role = 'assistant')
SELECT conv_id, turn_index, conv_id || '#assistant-' || lpad(CAST(turn_index AS VARCHAR), 4, '0') AS sample_id, n_history, text AS response, next_user_turn, split,
  history_ends_with_user, history_ends_with_user AND next_user_turn IS NOT NULL AND split = 'train' AS dpo_eligible FROM s""")
def assistant_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.assistant_samples(turns(spark, sf_dir))
    return rows.withColumn("n_history", F.size("history").cast("long")).drop("history")


@query(f"""WITH {TURNS}, h AS (
  SELECT a.conv_id, a.turn_index, any_value(a.text) AS response, coalesce({LINES.replace('role', 'b.role').replace('text', 'b.text').replace('turn_index', 'b.turn_index')}, '') AS prompt
  FROM turns a LEFT JOIN turns b ON a.conv_id = b.conv_id AND b.turn_index < a.turn_index WHERE a.role = 'assistant' GROUP BY 1, 2)
SELECT conv_id, turn_index, prompt, response FROM h""")
def scoring_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.scoring_prompts(T.assistant_samples(turns(spark, sf_dir))).drop("next_user_turn")


@query(f"""WITH {TURNS}, h AS (
  SELECT a.conv_id, a.turn_index, {LINES.replace('role', 'b.role').replace('text', 'b.text').replace('turn_index', 'b.turn_index')} AS body
  FROM turns a LEFT JOIN turns b ON a.conv_id = b.conv_id AND b.turn_index < a.turn_index AND b.turn_index >= a.turn_index - 4 WHERE a.role = 'assistant' GROUP BY 1, 2)
SELECT conv_id, turn_index, 'Reply as the assistant.' || chr(10) || coalesce(body || chr(10), '') || 'AI:' AS prompt FROM h""")
def training_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.training_prompts(T.assistant_samples(turns(spark, sf_dir)), last=4)


@query(f"""WITH {TURNS}
SELECT a.conv_id, CAST(a.turn_index + 1 AS INTEGER) AS turn_number,
  string_agg(CASE WHEN (a.turn_index - b.turn_index) % 2 = 1 THEN 'User: ' ELSE 'AI: ' END || b.text, chr(10) ORDER BY b.turn_index) AS prompt, any_value(a.text) AS response
FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn_index BETWEEN a.turn_index - 3 AND a.turn_index - 1 GROUP BY 1, 2""")
def bounded_context_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bounded_context(turns(spark, sf_dir), last=3)


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last FROM conversations),
f AS (SELECT conv_id, count(*) AS n_turns, bool_or(role NOT IN ('user', 'assistant')) AS bad, bool_or(role <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) AS alt,
  bool_or(is_last AND role <> 'assistant') AS open_end, bool_or(coalesce(trim(text) = '', true)) AS blank FROM w GROUP BY 1)
SELECT conv_id, n_turns, CASE WHEN bad THEN 'invalid_role' WHEN blank THEN 'blank_text' WHEN alt THEN 'not_alternating' WHEN open_end THEN 'open_end' WHEN n_turns < 4 THEN 'too_short' END AS reject_reason FROM f""")
def normalize_chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reject_reasons(read(spark, sf_dir, "conversations"), min_exchanges=2)


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last FROM conversations),
f AS (SELECT conv_id, count(*) AS n_turns, bool_or(role NOT IN ('user', 'assistant')) AS bad, bool_or(role <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) AS alt,
  bool_or(is_last AND role <> 'assistant') AS open_end, bool_or(coalesce(trim(text) = '', true)) AS blank FROM w GROUP BY 1),
r AS (SELECT coalesce(CASE WHEN bad THEN 'invalid_role' WHEN blank THEN 'blank_text' WHEN alt THEN 'not_alternating' WHEN open_end THEN 'open_end' WHEN n_turns < 4 THEN 'too_short' END, 'accepted') AS reason FROM f)
SELECT reason, count(*) AS conversations FROM r GROUP BY 1""")
def candidate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize_chat_rows(spark, sf_dir).select(F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("conversations"))


@query("""WITH d AS (SELECT conv_id, count(*) + (conv_id % 3 = 0)::INT AS num_messages, count(*) FILTER (role = 'user') AS num_user_turns, count(*) FILTER (role = 'assistant') + (conv_id % 5 = 0)::INT AS num_assistant_turns, count(*) AS n,
  count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, concat_ws(',', CASE WHEN n <> num_messages THEN 'num_messages' END, CASE WHEN u <> num_user_turns THEN 'num_user_turns' END, CASE WHEN a <> num_assistant_turns THEN 'num_assistant_turns' END) AS violations FROM d""")
def conversation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    declared = rows.groupBy("conv_id").agg(
        (F.count("*") + (F.col("conv_id") % 3 == 0).cast("int")).alias("num_messages"),
        F.count_if(F.col("role") == "user").alias("num_user_turns"),
        (F.count_if(F.col("role") == "assistant") + (F.col("conv_id") % 5 == 0).cast("int")).alias("num_assistant_turns"),
    )
    return T.validate(rows, declared)


@query(f"""WITH {TURNS}, t AS (SELECT conv_id, turn_index, CASE WHEN conv_id % 2 = 0 THEN role ELSE 'assistant' END AS role, text FROM turns),
w AS (SELECT *, coalesce(lag(role) OVER o <> role, true)::INT AS change, coalesce(lag(role) OVER o = role AND lag(text) OVER o = text, false) AS repeated FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn_index)),
i AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn_index) AS island FROM w)
SELECT conv_id, CAST(island - 1 AS INTEGER) AS turn_index, role, string_agg(text, chr(10) ORDER BY turn_index) FILTER (NOT repeated) AS text, min(i.turn_index) AS first_turn, max(i.turn_index) AS last_turn, count(*) AS n_turns FROM i GROUP BY conv_id, island, role""".replace("ORDER BY turn_index) FILTER", "ORDER BY i.turn_index) FILTER"))
def merge_consecutive_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("role", F.when(F.col("conv_id") % 2 == 0, F.col("role")).otherwise("assistant"))
    return T.merge_consecutive(rows)


@query(f"""WITH {TURNS}, s AS (SELECT conv_id, turn_index, trim(CASE role WHEN 'user' THEN 'Student: ' ELSE CASE WHEN turn_index % 4 = 1 THEN 'Teacher: (probing) ' ELSE 'Teacher: ' END END || text) AS segment FROM turns)
SELECT conv_id, CAST(turn_index AS INTEGER) AS segment_index, CASE WHEN segment LIKE 'Teacher:%' THEN 'assistant' ELSE 'user' END AS role,
  nullif(regexp_extract(trim(regexp_replace(segment, '^(Teacher|Student):\\s*', '')), '^\\(([a-z_]+)\\)', 1), '') AS move,
  trim(regexp_replace(trim(regexp_replace(segment, '^(Teacher|Student):\\s*', '')), '^\\([a-z_]+\\)\\s*', '')) AS text, false AS is_blank FROM s""")
def parse_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    move = F.when(F.col("turn_index") % 4 == 1, "Teacher: (probing) ").otherwise("Teacher: ")
    lines = turns(spark, sf_dir).select("conv_id", "turn_index", F.concat(F.when(F.col("role") == "user", "Student: ").otherwise(move), "text").alias("line"))
    whole = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "line"))), lambda x: x["line"]), "|EOM|").alias("transcript"))
    return T.parse_transcript(whole).withColumn("segment_index", F.col("segment_index").cast("int"))


@query(f"""WITH {TURNS}, n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM turns)
SELECT conv_id, string_agg(CASE WHEN (n - turn_index) % 2 = 1 THEN 'AI: ' ELSE 'User: ' END || text, chr(10) ORDER BY turn_index) AS prompt FROM n GROUP BY 1""")
def role_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = turns(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "role", "text"))), lambda x: F.concat(F.when(x["role"] == "user", "User: ").otherwise("AI: "), x["text"])).alias("lines"))
    return whole.select("conv_id", F.array_join(T.reassign_roles(F.col("lines")), "\n").alias("prompt"))


@query("SELECT c.* FROM conversations c WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 6)")
def conversations_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    wanted = rows.groupBy("conv_id").count().where("count >= 6").select("conv_id")
    return rows.join(wanted, "conv_id", "left_semi")


@query(f"""WITH {TURNS} SELECT conv_id, turn_index FROM turns WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = turns.conv_id AND t.turn_index = turns.turn_index AND (t.conv_id + t.turn_index) % 3 = 0)""")
def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn_index")
    done = rows.where("(conv_id + turn_index) % 3 = 0")
    return rows.join(done, ["conv_id", "turn_index"], "left_anti")


@query(f"""WITH {TURNS} SELECT conv_id, turn_index, role FROM turns WHERE conv_id NOT IN (SELECT conv_id FROM turns WHERE role = 'assistant' AND length(text) < 60)""")
def clean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which no assistant turn fell back go on whole."""
    rows = turns(spark, sf_dir)
    bad = rows.where("role = 'assistant' and length(text) < 60").select("conv_id").distinct()
    return rows.join(bad, "conv_id", "left_anti").select("conv_id", "turn_index", "role")


@query(f"""WITH {TURNS} SELECT conv_id, turn_index, role FROM turns WHERE (conv_id, turn_index) IN (SELECT conv_id, turn_index FROM turns WHERE conv_id % 4 = turn_index % 4)""")
def allowed_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    return rows.join(rows.where("conv_id % 4 = turn_index % 4").select("conv_id", "turn_index"), ["conv_id", "turn_index"], "left_semi").select("conv_id", "turn_index", "role")


@query("""SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 6) AS mean_length, max(length(text)) AS max_length FROM conversations GROUP BY role""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.max(F.length("text")).cast("long").alias("max_length"))


@query("""WITH l AS (SELECT role, list_sort(list(length(text))) AS xs FROM conversations GROUP BY role)
SELECT role, len(xs) AS n, xs[1] AS shortest, xs[CAST(len(xs) // 2 AS INT) + 1] AS upper_median, xs[least(len(xs), CAST(floor(len(xs) * 0.9) AS INT) + 1)] AS p90, xs[len(xs)] AS longest FROM l""")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rank, not by gathering: the upper median and the element at int(0.9 n)."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("x")).groupBy("role", "x").count()
    own = Window.partitionBy("role")
    # one row for each length: the running count says which ranks it holds
    ranked = rows.withColumn("upto", F.sum("count").over(own.orderBy("x"))).withColumn("n", F.sum("count").over(own))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    return ranked.groupBy("role").agg(F.max("n").alias("n"), F.min("x").alias("shortest"), at(F.floor(F.col("n") / 2)).alias("upper_median"), at(F.floor(F.col("n") * 0.9)).alias("p90"), F.max("x").alias("longest"))


@query(f"""WITH {TURNS} SELECT conv_id, turn_index, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn_index) AS BIGINT) AS used FROM turns QUALIFY sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn_index) <= 600""")
def corpus_text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id").orderBy("turn_index")
    return turns(spark, sf_dir).withColumn("used", F.sum(F.length("text")).over(own)).where("used <= 600").select("conv_id", "turn_index", "used")
