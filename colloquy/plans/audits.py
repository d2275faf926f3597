"""Checks, reuse, reserves and reports over the same tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import stats as X
from colloquy.functions import text as T
from colloquy.operators import dedup as D
from colloquy.operators.turns import hash_order
from colloquy.plans.conversations import turns
from colloquy.plans.judging import JUDGE, MODELS, judge, overall, rounded
from colloquy.plans.pairs import PAIRS, scored_pairs
from colloquy.plans.registry import LABELLED, TURNS, query
from colloquy.plans.scoring import MODEL, labelled, scored
from colloquy.sources.tables import read


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query(f"""WITH {TURNS} SELECT conv_id, turn_index, concat_ws(',', CASE WHEN turn_index % 5 = 0 THEN 'response' END, CASE WHEN conv_id % 7 = 0 THEN 'prompt' END) AS problems FROM turns""")
def validate_scoring_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields that are absent or blank."""
    rows = turns(spark, sf_dir).select("conv_id", "turn_index", F.when(F.col("conv_id") % 7 == 0, " ").otherwise("p").alias("prompt"), F.when(F.col("turn_index") % 5 != 0, F.col("text")).alias("response"))
    problems = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in ("response", "prompt")]
    return rows.select("conv_id", "turn_index", F.array_join(F.array_compact(F.array(*problems)), ",").alias("problems"))


@query()
def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.sha2(T.name_key("c_name"), 256).alias("key"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), 'licen[sc]e|version|password') AS xs FROM documents) SELECT doc_id, array_to_string([x for x, i in xs if list_position(xs, x) = i], ',') AS terms FROM t WHERE len(xs) > 0")
def protected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each once, in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("licen[sc]e|version|password"), F.lit(0)))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("terms")).where("terms <> ''")


@query(f"WITH {TURNS}, b AS (SELECT conv_id, turn_index, regexp_replace(text, '\\s+', '', 'g') AS t FROM turns) SELECT conv_id, turn_index, CAST(len(list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, CAST(i AS INT), 2)))) AS INTEGER) AS n FROM b")
def cjk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn_index", F.size(T.bigrams(F.col("text"))).alias("n"))


@query(f"WITH {JUDGE} SELECT sample_id, min(category) AS consultation, count(DISTINCT category) = 1 AS consistent FROM judge GROUP BY 1")
def consultation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, sf_dir).groupBy("sample_id").agg(F.min("category").alias("consultation"), (F.count_distinct("category") == 1).alias("consistent"))


@query(f"WITH {PAIRS} SELECT prompt, count(DISTINCT o_custkey % 2) = 1 AS consistent FROM pairs GROUP BY 1")
def template_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = F.sha2((F.col("o_custkey") % 2).cast("string"), 256)
    return scored_pairs(spark, sf_dir).groupBy("prompt").agg((F.count_distinct(signature) == 1).alias("consistent"))


@query(f"""WITH {JUDGE}, w AS (SELECT sample_id, round(max(value) FILTER (model_name = 'basis') - max(value) FILTER (model_name = 'base'), 6) AS gap FROM overall GROUP BY 1) SELECT CASE WHEN abs(gap) < 0.5 THEN 'close' WHEN gap > 0 THEN 'win' ELSE 'loss' END AS stratum, count(*) AS n FROM w GROUP BY 1""")
def oracle_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda m: F.max(F.when(F.col("model_name") == m, F.col("value")))
    rows = overall(spark, sf_dir).groupBy("sample_id").agg(F.round(of("basis") - of("base"), 6).alias("gap"))
    return rows.groupBy(F.when(F.abs("gap") < 0.5, "close").when(F.col("gap") > 0, "win").otherwise("loss").alias("stratum")).agg(F.count("*").alias("n"))


@query(f"WITH {JUDGE} SELECT o.sample_id, o.model_name, p.p_name AS response, round(o.value, 6) AS value FROM overall o JOIN part p ON p.p_partkey = o.sample_id")
def join_responses_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("response"))
    return rounded(overall(spark, sf_dir).join(responses, "sample_id").select("sample_id", "model_name", "response", "value"), "value")


@query(f"""WITH {JUDGE}, w AS (SELECT category, max(value) FILTER (model_name = 'basis') - max(value) FILTER (model_name = 'base') AS d FROM overall GROUP BY sample_id, category)
SELECT category, count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS high FROM w GROUP BY 1""")
def user_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.paired_differences(overall(spark, sf_dir), ["sample_id", "category"], "basis", "base")
    half = 1.96 * F.stddev_samp("d") / F.sqrt(F.count("*"))
    return rounded(rows.groupBy("category").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), (F.avg("d") - half).alias("low"), (F.avg("d") + half).alias("high")), "mean", "low", "high")


@query(f"""WITH {JUDGE} SELECT a.axis AS axis, count(*) FILTER (a.value > b.value) AS wins, count(*) FILTER (a.value = b.value) AS ties, count(*) FILTER (a.value < b.value) AS losses FROM judge a JOIN judge b USING (sample_id, axis) WHERE a.model_name = 'basis' AND b.model_name = 'random' GROUP BY 1""")
def strategy_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    rows = X.paired_differences(judge(spark, sf_dir), ["axis", "sample_id"], "basis", "random")
    return rows.groupBy("axis").agg(F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'late' ELSE 'early' END AS reason FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def quarantine_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries accumulate by key; the later one stands."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    old = docs.where("doc_id % 2 = 0 or doc_id % 3 = 0").select("doc_id", F.lit("early").alias("reason"), F.lit(0).alias("at"))
    new = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("late").alias("reason"), F.lit(1).alias("at"))
    return old.unionByName(new).groupBy("doc_id").agg(F.max_by("reason", "at").alias("reason"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'run2' WHEN doc_id % 3 = 0 THEN 'run1' END AS restored_from FROM documents")
def resume_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record from the latest earlier run that has it; null: still to be done."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    runs = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("run2").alias("run")).unionByName(docs.where("doc_id % 3 = 0").select("doc_id", F.lit("run1").alias("run")))
    return docs.join(runs.groupBy("doc_id").agg(F.max("run").alias("restored_from")), "doc_id", "left")


REUSE = "CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN score_chosen < 0.2 THEN 'low_chosen' WHEN score_rejected > 0.8 THEN 'high_rejected' END"


def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an earlier pair can't be used again under the present conditions; the first reason that holds."""
    rows = scored_pairs(spark, sf_dir)
    before = rows.where("o_orderkey % 11 <> 0").select("o_orderkey", F.lit(True).alias("found"))
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("score_chosen") < 0.2, "low_chosen").when(F.col("score_rejected") > 0.8, "high_rejected")
    return rows.join(before, "o_orderkey", "left").select("o_orderkey", reason.alias("reason"))


@query(f"WITH {PAIRS} SELECT o_orderkey, {REUSE} AS reason FROM pairs")
def reuse_mismatch_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mismatches(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT coalesce({REUSE}, 'reused') AS reason, count(*) AS n FROM pairs GROUP BY 1")
def reuse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mismatches(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("reused")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM labels) AS candidates, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphans, (SELECT count(*) FROM documents) AS pool")
def pool_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, and candidates that the pool doesn't have."""
    docs = read(spark, sf_dir, "documents").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = read(spark, sf_dir, "labels").join(docs, "doc_id", "left").agg(F.count("*").alias("candidates"), F.count_if(F.col("known").isNull()).alias("orphans"))
    return rows.crossJoin(read(spark, sf_dir, "documents").agg(F.count("*").alias("pool")))  # two frames of one row


@query("SELECT lang, doc_id, is_reserve FROM (SELECT lang, doc_id, doc_id % 4 = 3 AS is_reserve FROM documents WHERE doc_id % 5 <> 0) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY is_reserve, doc_id) <= 15")
def reserve_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primaries that passed, then reserves, up to the quota of each cell."""
    rows = read(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select("lang", "doc_id", (F.col("doc_id") % 4 == 3).alias("is_reserve"))
    own = Window.partitionBy("lang").orderBy("is_reserve", "doc_id")
    return rows.withColumn("k", F.row_number().over(own)).where("k <= 15").drop("k")


@query(f"""WITH {LABELLED}, r AS (SELECT 'random' AS grp, conv_id, turn_index FROM labelled ORDER BY sha256('9:' || conv_id || ':' || turn_index) LIMIT 40), l AS (SELECT 'long' AS grp, conv_id, turn_index FROM labelled ORDER BY length(text) DESC, conv_id, turn_index LIMIT 40)
SELECT * FROM r UNION ALL SELECT * FROM l""")
def selection_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    one = rows.orderBy(hash_order("9", "conv_id", "turn_index")).limit(40).select(F.lit("random").alias("grp"), "conv_id", "turn_index")
    return one.unionByName(rows.orderBy(F.desc(F.length("text")), "conv_id", "turn_index").limit(40).select(F.lit("long").alias("grp"), "conv_id", "turn_index"))


@query(f"""WITH {LABELLED}, r AS (SELECT 'random' AS grp, conv_id, turn_index FROM labelled ORDER BY sha256('9:' || conv_id || ':' || turn_index) LIMIT 40), l AS (SELECT 'long' AS grp, conv_id, turn_index FROM labelled ORDER BY length(text) DESC, conv_id, turn_index LIMIT 40), u AS (SELECT * FROM r UNION ALL SELECT * FROM l),
k AS (SELECT conv_id, turn_index, string_agg(grp, ',' ORDER BY grp) AS groups FROM u GROUP BY 1, 2) SELECT groups, count(*) AS n FROM k GROUP BY 1""")
def selection_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many are in which groups at once."""
    rows = selection_groups(spark, sf_dir).groupBy("conv_id", "turn_index").agg(F.array_join(F.array_sort(F.collect_list("grp")), ",").alias("groups"))
    return rows.groupBy("groups").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT text, count(*) AS copies FROM documents GROUP BY 1) SELECT copies, count(*) AS groups, min(length(text)) AS shortest, round(avg(length(text)), 6) AS mean, max(length(text)) AS longest FROM g GROUP BY 1")
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n")).agg(F.count("*").alias("copies"))
    return rows.groupBy("copies").agg(F.count("*").alias("groups"), F.min("n").alias("shortest"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("longest"))


@query("SELECT source, count(*) AS texts, sum(length(text))::BIGINT AS characters, substr(min(text), 1, 40) AS first_text FROM documents GROUP BY 1")
def small_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.length("text")).cast("long").alias("characters"), F.substring(F.min("text"), 1, 40).alias("first_text"))


@query(f"""WITH {LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY observation ORDER BY sha256('f:' || conv_id || ':' || turn_index)) AS k FROM labelled) SELECT conv_id, turn_index, observation FROM r ORDER BY k, observation LIMIT 12""")
def fewshot_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("observation").orderBy(hash_order("f", "conv_id", "turn_index"))
    rows = labelled(spark, sf_dir).withColumn("k", F.row_number().over(own)).where("k <= 12")
    return rows.orderBy("k", "observation").limit(12).select("conv_id", "turn_index", "observation")


@query(f"""WITH {LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn_index) AS own FROM labelled), o AS (SELECT conv_id, turn_index, observation, row_number() OVER (PARTITION BY observation ORDER BY conv_id) AS k FROM r WHERE own = 1) SELECT conv_id, turn_index, observation FROM o ORDER BY k, observation LIMIT 30""")
def qid_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn of each conversation, then the labels by turns."""
    best = labelled(spark, sf_dir).groupBy("conv_id").agg(F.max_by(F.struct("turn_index", "observation"), F.struct(F.length("text").alias("n"), (-F.col("turn_index")).alias("t"))).alias("x")).select("conv_id", "x.*")
    rows = best.withColumn("k", F.row_number().over(Window.partitionBy("observation").orderBy("conv_id"))).where("k <= 30")
    return rows.orderBy("k", "observation").limit(30).select("conv_id", "turn_index", "observation")


@query(f"""WITH {TURNS} SELECT CASE WHEN turn_index <= 1 THEN 'opening' WHEN turn_index <= 4 THEN 'middle' ELSE 'late' END AS stage, role, count(*) AS n FROM turns GROUP BY 1, 2""")
def eval_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("turn_index") <= 1, "opening").when(F.col("turn_index") <= 4, "middle").otherwise("late")
    return turns(spark, sf_dir).groupBy(stage.alias("stage"), "role").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN regexp_matches(event_type, 'click|view') THEN 'retryable' WHEN event_type LIKE '%err%' THEN 'fatal' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1""")
def fallback_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").rlike("click|view"), "retryable").when(F.col("event_type").contains("err"), "fatal").otherwise("other")
    return read(spark, sf_dir, "events").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH {TURNS}, a AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn_index) AS r, string_agg(CASE WHEN conv_id % 4 = 0 AND turn_index = 1 THEN 'user' ELSE role END, ',' ORDER BY turn_index) AS t FROM turns GROUP BY 1) SELECT conv_id, r = t AS aligned FROM a""")
def aligned_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same number of turns and same order of roles as the translation has."""
    changed = F.when((F.col("conv_id") % 4 == 0) & (F.col("turn_index") == 1), "user").otherwise(F.col("role"))
    roles = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn_index", c.alias("r")))), lambda x: x["r"])
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(roles(F.col("role")).alias("a"), roles(changed).alias("b"))
    return rows.select("conv_id", (F.col("a") == F.col("b")).alias("aligned"))


@query(f"""WITH {LABELLED}, p AS (SELECT observation AS a, lead(observation) OVER (PARTITION BY conv_id ORDER BY turn_index) AS b, CAST(least(9, floor(turn_index * 10 / count(*) OVER (PARTITION BY conv_id))) AS INTEGER) AS part FROM labelled) SELECT a, b, count(*) AS n, min(part) AS earliest FROM p WHERE b IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 100""")
def slot_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id")
    part = F.least(F.lit(9), F.floor(F.col("turn_index") * 10 / F.count("*").over(own))).cast("int")
    rows = labelled(spark, sf_dir).withColumn("b", F.lead("observation").over(own.orderBy("turn_index"))).withColumn("part", part).where("b is not null")
    return rows.groupBy(F.col("observation").alias("a"), "b").agg(F.count("*").alias("n"), F.min("part").alias("earliest")).orderBy(F.desc("n"), "a", "b").limit(100)


@query(f"""WITH {LABELLED} SELECT CASE WHEN 0.5 + (length(text) % 5) / 10.0 >= 0.8 THEN 'bypass' ELSE 'second_opinion' END AS route, count(*) AS n FROM labelled GROUP BY 1""")
def confidence_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.when(0.5 + (F.length("text") % 5) / 10.0 >= 0.8, "bypass").otherwise("second_opinion")
    return labelled(spark, sf_dir).groupBy(route.alias("route")).agg(F.count("*").alias("n"))


def diverse_choice(rows: DataFrame, key: list[str], count: int, weight: float = 0.8) -> DataFrame:
    """rows: key, score, tokens. One round for each choice: the row with the best score less its likeness to what is chosen, ties by score and key; then all others' likeness is brought up to date with it."""
    chosen, left = [], D.reliable(rows.withColumn("likeness", F.lit(0.0)))
    for _ in range(count):
        value = weight * F.col("score") - (1 - weight) * F.col("likeness")
        best = left.withColumn("value", value).orderBy(F.desc("value"), F.desc("score"), *key).first()
        if best is None:
            break
        chosen.append((*(best[k] for k in key), best.value))
        other = F.array(*map(F.lit, best.tokens)) if best.tokens else F.array().cast("array<string>")
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(best[k])) for k in key))
        left = D.reliable(left.where(~same).withColumn("likeness", F.greatest("likeness", T.jaccard(F.col("tokens"), other))))
    return rows.sparkSession.createDataFrame(chosen, ", ".join(f"`{k}` {kind}" for k, kind in rows.select(*key).dtypes) + ", mmr_score double")


@query()
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diverse choice from all scored turns."""
    rows = scored(spark, sf_dir).select("conv_id", "turn_index", F.round("selection_score", 8).alias("score"), D.tokens(F.col("text")).alias("tokens"))
    return diverse_choice(rows, ["conv_id", "turn_index"], 15)


@query()
def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omnibus tests by axis, and pairwise ones for the axes where those are significant."""
    rows = judge(spark, sf_dir)
    omnibus = X.friedman(rows, "axis", "sample_id", 3)
    pairs = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1 :]]
    parts = [X.sign_test(X.paired_differences(rows, ["axis", "sample_id"], a, b), "axis").withColumn("pair", F.lit(f"{a} - {b}")) for a, b in pairs]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    post = X.holm(whole.where(F.col("p").isNotNull()), "p", ["axis"]).join(omnibus.where("p < 0.05").select("axis"), "axis", "left_semi")
    return rounded(omnibus.select("axis", F.lit("friedman").alias("test"), "p").unionByName(post.select("axis", F.col("pair").alias("test"), F.col("adjusted").alias("p"))), "p")
