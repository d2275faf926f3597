"""Judges' and generators' answers, prompts and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import stats as X
from colloquy.operators import turns as T
from colloquy.plans.conversations import turns
from colloquy.plans.judging import FRIEDMAN, JUDGE, judge, overall
from colloquy.plans.pairs import PAIRS, scored_pairs
from colloquy.plans.registry import LABELLED, TURNS, query
from colloquy.plans.scoring import labelled
from colloquy.sources.tables import read


@query("""WITH a AS (SELECT event_id, least(100.0, greatest(0.0, (event_id * 37 % 140) - 20))::DOUBLE AS a, least(100.0, greatest(0.0, (event_id * 53 % 140) - 20))::DOUBLE AS b, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS raw_winner FROM events)
SELECT event_id, a, b, raw_winner, CASE WHEN abs(a - b) < 1 THEN 'tie' WHEN a > b THEN 'a' ELSE 'b' END AS winner FROM a""")
def ab_judgment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores held between 0 and 100, the winner worked out from them; the judge's own word is kept beside it."""
    e = F.col("event_id")
    text = F.to_json(F.struct(((e * 37) % 140 - 20).alias("a"), ((e * 53) % 140 - 20).alias("b"), F.when(e % 2 == 0, "a").otherwise("b").alias("winner")))
    rows = read(spark, sf_dir, "events").select("event_id", F.from_json(text, "a double, b double, winner string").alias("x"))
    held = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(c)))
    rows = rows.select("event_id", held("x.a").alias("a"), held("x.b").alias("b"), F.col("x.winner").alias("raw_winner"))
    return rows.withColumn("winner", F.when(F.abs(F.col("a") - F.col("b")) < 1, "tie").when(F.col("a") > F.col("b"), "a").otherwise("b"))


@query("""WITH c AS (SELECT o_orderkey, list_distinct(list_filter(['r' || o_orderkey % 3, 'r' || o_orderkey % 5, 'r' || o_custkey % 4], lambda x: x <> 'r1')) AS xs FROM orders) SELECT o_orderkey, CAST(len(xs) AS INTEGER) AS n, len(xs) >= 2 AS enough FROM c""")
def candidate_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different candidates that aren't the chosen text; are they enough?"""
    name = lambda c, k: F.concat(F.lit("r"), (F.col(c) % k).cast("string"))
    found = F.array_distinct(F.filter(F.array(name("o_orderkey", 3), name("o_orderkey", 5), name("o_custkey", 4)), lambda x: x != "r1"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.size(found).alias("n"), (F.size(found) >= 2).alias("enough"))


@query(f"""WITH {TURNS}, h AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1) SELECT conv_id, CAST(CASE WHEN conv_id % 3 = 0 THEN 1 ELSE n END AS INTEGER) AS n_history, CASE WHEN conv_id % 3 = 0 THEN 'context' ELSE (SELECT role FROM turns t WHERE t.conv_id = h.conv_id AND turn_index = 0) END AS first_role FROM h""")
def parse_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history given as JSON, or as plain text, which is one piece of context."""
    whole = turns(spark, sf_dir).groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("j"))
    raw = whole.select("conv_id", F.when(F.col("conv_id") % 3 == 0, "plain words").otherwise(F.col("j")).alias("raw"))
    parsed = F.when(F.ltrim("raw").startswith("["), F.from_json("raw", "array<struct<role:string,text:string>>"))
    history = F.coalesce(parsed, F.array(F.struct(F.lit("context").alias("role"), F.col("raw").alias("text"))))
    return raw.select("conv_id", F.size(history).alias("n_history"), F.element_at(history, 1)["role"].alias("first_role"))


@query(f"""WITH {TURNS}, h AS (SELECT a.conv_id, a.turn_index, count(b.turn_index) AS n FROM turns a LEFT JOIN turns b ON a.conv_id = b.conv_id AND b.turn_index < a.turn_index AND b.turn_index >= a.turn_index - 4 WHERE a.role = 'assistant' GROUP BY 1, 2)
SELECT conv_id, turn_index, CAST(n AS INTEGER) AS n_lines, true AS well_formed FROM h""")
def prompt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt taken apart again: the line of instruction, the speakers' lines, the open line at the end. Texts are put on one line before."""
    flat = turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    prompts = T.training_prompts(T.assistant_samples(flat), last=4)
    lines = F.split("prompt", "\n")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    ok = F.forall(body, lambda x: x.rlike("^(User|AI): ")) & (F.element_at(lines, -1) == "AI:")
    return prompts.select("conv_id", "turn_index", F.size(body).alias("n_lines"), ok.alias("well_formed"))


@query(f"WITH {TURNS} SELECT conv_id, turn_index, true AS unchanged FROM turns WHERE role = 'assistant'")
def prompt_rewrite_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the prompt may change: the digest of all other fields before and after."""
    rows = T.scoring_prompts(T.assistant_samples(turns(spark, sf_dir)))
    others = [c for c in rows.columns if c != "prompt"]
    digest = F.sha2(F.to_json(F.struct(*others)), 256)
    changed = rows.withColumn("before", digest).withColumn("prompt", F.concat(F.lit("Context:\n"), "prompt"))
    return changed.select("conv_id", "turn_index", (digest == F.col("before")).alias("unchanged"))


@query(f"WITH {JUDGE}, p AS (SELECT DISTINCT sample_id, substr(sha256('item:' || sample_id), 1, 10) AS item FROM overall) SELECT 'public' AS kind, item, '' AS sample FROM p UNION ALL SELECT 'private', item, CAST(sample_id AS VARCHAR) FROM p")
def public_private_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What participants see names no sample; the key to it is kept apart."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id")).withColumn("item", F.substring(F.sha2(F.concat(F.lit("item:"), F.col("sample_id").cast("string")), 256), 1, 10))
    return rows.select(F.lit("public").alias("kind"), "item", F.lit("").alias("sample")).unionByName(rows.select(F.lit("private").alias("kind"), "item", F.col("sample_id").cast("string").alias("sample")))


@query("WITH s AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 10 = 0 GROUP BY 1) SELECT lang AS label, round(n / sum(n) OVER (), 8) AS share, 'supplied' AS origin FROM s")
def reference_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the supplied labels; those of the judge's own ideal labels only where none are supplied."""
    docs = read(spark, sf_dir, "documents")
    both = docs.where("doc_id % 10 = 0").select(F.col("lang").alias("label"), F.lit(1).alias("rank")).unionByName(docs.where("doc_id % 10 = 1").select("lang", F.lit(2).alias("rank")).toDF("label", "rank"))
    counts = both.groupBy("rank", "label").agg(F.count("*").alias("n"))
    first = counts.withColumn("best", F.min("rank").over(Window.partitionBy())).where("rank = best")
    return first.select("label", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8).alias("share"), F.when(F.col("rank") == 1, "supplied").otherwise("judge").alias("origin"))


@query(f"WITH {LABELLED} SELECT conv_id, turn_index, CASE WHEN conv_id % 6 = 0 THEN 'missing' WHEN turn_index % 4 = 3 THEN 'changed' ELSE 'reused' END AS status FROM labelled")
def scoring_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier scores are used again where the record's signature is the same."""
    rows = labelled(spark, sf_dir)
    signature = lambda text: F.sha2(F.concat_ws("\u0001", "conv_id", "turn_index", text), 256)
    earlier = rows.where("conv_id % 6 <> 0").select("conv_id", "turn_index", signature(F.when(F.col("turn_index") % 4 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("was"))
    both = rows.select("conv_id", "turn_index", signature(F.col("text")).alias("now")).join(earlier, ["conv_id", "turn_index"], "left")
    return both.select("conv_id", "turn_index", F.when(F.col("was").isNull(), "missing").when(F.col("was") != F.col("now"), "changed").otherwise("reused").alias("status"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_type NOT IN ('click', 'view') THEN 'label' END, CASE WHEN (event_id % 7) / 2.0 <> floor((event_id % 7) / 2.0) THEN 'not whole' END, CASE WHEN event_id % 7 > 5 THEN 'range' END) AS problems FROM events""")
def strategy_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judgment's label must be known and its score whole and in range."""
    score = (F.col("event_id") % 7) / 2.0
    problems = F.array(F.when(~F.col("event_type").isin("click", "view"), "label"), F.when(score != F.floor(score), "not whole"), F.when(F.col("event_id") % 7 > 5, "range"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(F.array_compact(problems), ",").alias("problems"))


@query(f"WITH {LABELLED} SELECT conv_id, turn_index, observation IN ('generic', 'followup') AND 0.5 + (length(text) % 5) / 10.0 >= 0.6 AS valid FROM labelled")
def validate_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(F.lit("generic"), F.lit("followup"))
    return labelled(spark, sf_dir).select("conv_id", "turn_index", (F.array_contains(known, F.col("observation")) & (0.5 + (F.length("text") % 5) / 10.0 >= 0.6)).alias("valid"))


@query(f"WITH {FRIEDMAN}, p AS (SELECT axis, exp(-chi2 / 2) AS p FROM c) SELECT axis, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, CAST(CASE axis WHEN 'empathy' THEN 1 WHEN 'guidance' THEN 2 ELSE 3 END AS INTEGER) AS place FROM p")
def axis_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    rows = X.friedman(judge(spark, sf_dir), "axis", "sample_id", 3)
    return rows.select("axis", F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("").alias("stars"), F.when(F.col("axis") == "empathy", 1).when(F.col("axis") == "guidance", 2).otherwise(3).alias("place"))


@query(f"""WITH {JUDGE}, w AS (SELECT sample_id, max(value) FILTER (model_name = 'basis') AS b, greatest(max(value) FILTER (model_name = 'base'), max(value) FILTER (model_name = 'random')) AS o FROM overall GROUP BY 1)
SELECT sample_id, round(b, 6) AS best, round(b - o, 6) AS margin FROM w WHERE round(b, 6) >= 7 AND round(b - o, 6) >= 0.5 ORDER BY margin DESC, sample_id LIMIT 20""")
def discriminative_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda m: F.max(F.when(F.col("model_name") == m, F.col("value")))
    rows = overall(spark, sf_dir).groupBy("sample_id").agg(F.round(of("basis"), 6).alias("best"), F.round(of("basis") - F.greatest(of("base"), of("random")), 6).alias("margin"))
    return rows.where("best >= 7 and margin >= 0.5").orderBy(F.desc("margin"), "sample_id").limit(20)


@query(f"""WITH {LABELLED}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sha256('g:' || conv_id || ':' || turn_index)) AS own FROM labelled), r AS (SELECT *, row_number() OVER (PARTITION BY observation ORDER BY sha256('g:' || conv_id || ':' || turn_index)) AS k FROM c WHERE own <= 2)
SELECT conv_id, turn_index, observation FROM r ORDER BY k, observation LIMIT 40""")
def gold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by turns, no conversation more than twice."""
    digest = T.hash_order("g", "conv_id", "turn_index")
    rows = labelled(spark, sf_dir).withColumn("own", F.row_number().over(Window.partitionBy("conv_id").orderBy(digest))).where("own <= 2")
    turn = rows.withColumn("k", F.row_number().over(Window.partitionBy("observation").orderBy(digest))).where("k <= 40")
    return turn.orderBy("k", "observation").limit(40).select("conv_id", "turn_index", "observation")


@query(f"WITH {PAIRS} SELECT count(*) AS n, count(DISTINCT o_orderkey) = count(*) AS is_unique, count(*) FILTER (score_chosen IS NULL) = 0 AS all_scored, count(*) FILTER (score_chosen >= 0.7 AND score_rejected <= 0.55 AND score_chosen - score_rejected >= 0.25) AS strict FROM pairs")
def arms_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = F.col("score_chosen"), F.col("score_rejected")
    return scored_pairs(spark, sf_dir).agg(F.count("*").alias("n"), (F.count_distinct("o_orderkey") == F.count("*")).alias("is_unique"), (F.count_if(c.isNull()) == 0).alias("all_scored"), F.count_if((c >= 0.7) & (r <= 0.55) & (c - r >= 0.25)).alias("strict"))


@query(r"""WITH s AS (SELECT lang, doc_id, len(regexp_extract_all(lower(text), 'tion')) + 2 * len(regexp_extract_all(lower(text), 'ment')) AS score FROM documents)
SELECT lang, doc_id, score, CASE WHEN score >= 40 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS tier FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) <= 25""")
def priority_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count(F.lower("text"), F.lit(p)).cast("long")
    rows = read(spark, sf_dir, "documents").select("lang", "doc_id", (count("tion") + 2 * count("ment")).alias("score"))
    tier = F.when(F.col("score") >= 40, "high").when(F.col("score") >= 10, "medium").otherwise("low")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))).where("k <= 25").select("lang", "doc_id", "score", tier.alias("tier"))


@query(f"""WITH {TURNS}, f AS (SELECT conv_id, bool_or(length(text) > 100) AS wordy, count(*) AS n FROM turns GROUP BY 1) SELECT CASE WHEN wordy AND n >= 6 THEN 'long' WHEN wordy THEN 'wordy' ELSE 'short' END AS stratum, count(*) AS n FROM f GROUP BY 1""")
def sample_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata from what stands in an array of turns."""
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.collect_list(F.length("text")).alias("xs"))
    wordy = F.exists("xs", lambda n: n > 100)
    return rows.groupBy(F.when(wordy & (F.size("xs") >= 6), "long").when(wordy, "wordy").otherwise("short").alias("stratum")).agg(F.count("*").alias("n"))


