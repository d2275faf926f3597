"""Preference pairs from scored turns, text checks, and survey answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import pairs as P
from colloquy.plans.conversations import turns
from colloquy.plans.registry import TURNS, query
from colloquy.sources.tables import read

#: Terms that occur in the tables' invented prose.
GENERAL, MATHS, CONFUSION = ("the", "of"), ("ing", "tion"), ("tha", "ent")

SCORES = "(('0x' || substr(md5('{}:' || o_orderkey), 1, 6))::BIGINT % 1000) / 1000.0"
PAIRS = f"""pairs AS (SELECT o_orderkey, o_custkey, 'p' || (o_custkey % 300) AS prompt, 'r' || o_orderkey AS response, {SCORES.format('c')} AS score_chosen, {SCORES.format('r')} AS score_rejected, {SCORES.format('p')} AS posterior FROM orders)"""


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of made-up pairs, one per order, from digests of the key."""
    score = lambda seed: (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("o_orderkey").cast("string"))), 1, 6), 16, 10).cast("long") % 1000) / 1000.0
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rows.select("*", F.concat(F.lit("p"), (F.col("o_custkey") % 300).cast("string")).alias("prompt"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("response"), score("c").alias("score_chosen"), score("r").alias("score_rejected"), score("p").alias("posterior"))


RULE = "CASE WHEN score_chosen < 0.7 THEN NULL WHEN score_rejected <= 0.55 AND score_chosen - score_rejected >= 0.25 THEN 'strict' WHEN score_rejected <= 0.65 AND score_chosen - score_rejected >= 0.3 THEN 'gap_rescue' END"
SKIP = "CASE WHEN score_chosen < 0.7 THEN 'low_chosen' WHEN score_rejected > 0.55 THEN 'high_rejected' ELSE 'small_gap' END"


def accepted(rows: DataFrame) -> DataFrame:
    c, r = F.col("score_chosen"), F.col("score_rejected")
    rule = P.acceptance_rule(c, r)
    return rows.withColumn("acceptance_rule", rule).withColumn("skip_reason", F.when(rule.isNull(), P.skip_reason(c, r)))


@query(f"WITH {PAIRS}, a AS (SELECT {RULE} AS acceptance_rule, CASE WHEN {RULE} IS NULL THEN {SKIP} END AS skip_reason FROM pairs) SELECT acceptance_rule, skip_reason, count(*) AS n FROM a GROUP BY 1, 2")
def pair_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(scored_pairs(spark, sf_dir)).groupBy("acceptance_rule", "skip_reason").agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS}, b AS (SELECT prompt, first(response ORDER BY posterior DESC, o_orderkey) FILTER (posterior >= 0.65) AS chosen, first(response ORDER BY posterior, o_orderkey) FILTER (posterior <= 0.35) AS rejected, max(posterior) FILTER (posterior >= 0.65) AS c, min(posterior) FILTER (posterior <= 0.35) AS r FROM pairs GROUP BY 1)
SELECT prompt, chosen, rejected, round(c, 6) AS score_chosen, round(r, 6) AS score_rejected FROM b WHERE chosen IS NOT NULL AND rejected IS NOT NULL AND chosen <> rejected""")
def same_prompt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.same_prompt_pairs(scored_pairs(spark, sf_dir), ["o_orderkey"])
    return rows.select("prompt", "chosen", "rejected", F.round("score_chosen", 6).alias("score_chosen"), F.round("score_rejected", 6).alias("score_rejected"))


@query(f"""WITH {PAIRS}, k AS (SELECT o_custkey, max(score_chosen) AS score_chosen FROM pairs GROUP BY 1), c AS (SELECT k.o_custkey, k.score_chosen, p.o_orderkey AS candidate_index, p.response AS rejected, k.score_chosen - p.score_rejected AS gap FROM k JOIN pairs p USING (o_custkey))
SELECT o_custkey, candidate_index, rejected, round(gap, 6) AS gap FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY gap DESC, candidate_index) = 1""")
def best_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_pairs(spark, sf_dir)
    chosen = rows.groupBy("o_custkey").agg(F.max("score_chosen").alias("score_chosen"), F.lit("chosen").alias("chosen"))
    candidates = rows.select("o_custkey", F.col("o_orderkey").alias("candidate_index"), F.col("response").alias("candidate"), F.col("score_rejected").alias("score_candidate")).join(chosen, "o_custkey")
    return P.best_rejected(candidates, ["o_custkey"]).withColumn("gap", F.round("gap", 6))


@query(f"""WITH {PAIRS}, a AS (SELECT *, {RULE} AS rule, round(score_chosen - score_rejected, 6) AS gap FROM pairs), b AS (SELECT * FROM a WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY gap DESC, o_orderkey) = 1)
SELECT o_custkey, o_orderkey, gap, rule FROM b ORDER BY gap DESC, o_orderkey LIMIT 200""")
def pairs_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted pairs, the widest gap of each source, in descending gap, as many as wanted."""
    rows = accepted(scored_pairs(spark, sf_dir)).where("acceptance_rule is not null").withColumn("gap", F.round(F.col("score_chosen") - F.col("score_rejected"), 6))
    best = P.best_of(rows, ["o_custkey"], "gap", ["o_orderkey"])
    return best.orderBy(F.desc("gap"), "o_orderkey").limit(200).select("o_custkey", "o_orderkey", "gap", F.col("acceptance_rule").alias("rule"))


@query(f"WITH {PAIRS} SELECT prompt, o_orderkey, round(score_chosen - score_rejected, 6) AS gap FROM pairs QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY round(score_chosen - score_rejected, 6) DESC, o_orderkey) = 1")
def dedup_best_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_pairs(spark, sf_dir).select("prompt", "o_orderkey", F.round(F.col("score_chosen") - F.col("score_rejected"), 6).alias("gap"))
    return P.best_of(rows, ["prompt"], "gap", ["o_orderkey"])


@query(f"""WITH {PAIRS}, a AS (SELECT *, {RULE} AS rule, round(score_chosen - score_rejected, 6) AS gap FROM pairs)
SELECT o_orderkey, round(score_chosen, 6) AS score_chosen, gap FROM a WHERE rule IS NULL AND score_chosen >= 0.6 AND gap > 0 ORDER BY round(score_chosen, 6) DESC, gap DESC, o_orderkey LIMIT 40""")
def ranked_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accepted(scored_pairs(spark, sf_dir)).withColumn("gap", F.round(F.col("score_chosen") - F.col("score_rejected"), 6)).where("acceptance_rule is null and score_chosen >= 0.6 and gap > 0")
    return rows.select("o_orderkey", F.round("score_chosen", 6).alias("score_chosen"), "gap").orderBy(F.desc("score_chosen"), F.desc("gap"), "o_orderkey").limit(40)


@query(f"""WITH {PAIRS}, g AS (SELECT DISTINCT prompt FROM pairs WHERE prompt IN ('p1', 'p2', 'p3')), s AS (SELECT prompt, o_orderkey FROM pairs WHERE prompt NOT IN (SELECT prompt FROM g) ORDER BY score_chosen DESC, o_orderkey LIMIT 50), r AS (SELECT prompt, o_orderkey FROM pairs WHERE prompt NOT IN (SELECT prompt FROM g) ORDER BY sha256('arm:' || o_orderkey) LIMIT 50),
gp AS (SELECT prompt, min(o_orderkey) AS o_orderkey FROM pairs WHERE prompt IN (SELECT prompt FROM g) GROUP BY 1)
SELECT 'selected' AS arm, prompt, o_orderkey, false AS is_gold FROM s UNION ALL SELECT 'random', prompt, o_orderkey, false FROM r UNION ALL SELECT a, prompt, o_orderkey, true FROM gp, (VALUES ('selected'), ('random')) x(a)""")
def training_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_pairs(spark, sf_dir)
    gold = rows.where(F.col("prompt").isin("p1", "p2", "p3")).groupBy("prompt").agg(F.min("o_orderkey").alias("o_orderkey"))
    own = rows.join(gold.select("prompt"), "prompt", "left_anti")
    size = 50
    chosen = own.orderBy(F.desc("score_chosen"), "o_orderkey").limit(size).select("prompt", "o_orderkey")
    drawn = own.orderBy(F.sha2(F.concat(F.lit("arm:"), F.col("o_orderkey").cast("string")), 256)).limit(size).select("prompt", "o_orderkey")
    return P.arms(chosen, drawn, gold, size, ["o_orderkey"]).select("arm", "prompt", "o_orderkey", "is_gold")


@query(f"WITH {PAIRS} SELECT count(*) AS n, round(avg(ln(1 + exp(-0.1 * (10 * score_chosen - 10 * score_rejected)))), 6) AS loss, round(avg((score_chosen > score_rejected)::INT), 6) AS accuracy FROM pairs")
def dpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_pairs(spark, sf_dir).select((10 * F.col("score_chosen")).alias("logp_chosen"), (10 * F.col("score_rejected")).alias("logp_rejected"))
    out = P.dpo_loss(rows)
    return out.select("n", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


#: The four minima of an audit.
MINIMA = {"quality": 0.78, "chosen_alignment": 0.70, "rejected_contrast": 0.65, "naturalness": 0.75}


@query(f"""WITH {PAIRS}, v AS (SELECT o_orderkey, posterior >= 0.2 AS model_pass, score_chosen AS quality, greatest(posterior, score_chosen) AS chosen_alignment, 1 - score_rejected AS rejected_contrast, (score_chosen + posterior) / 2 + 0.3 AS naturalness FROM pairs)
SELECT o_orderkey, model_pass AND quality >= 0.78 AND chosen_alignment >= 0.70 AND rejected_contrast >= 0.65 AND naturalness >= 0.75 AS passed,
concat_ws(',', CASE WHEN NOT model_pass THEN 'model' END, CASE WHEN quality < 0.78 THEN 'quality' END, CASE WHEN chosen_alignment < 0.70 THEN 'chosen_alignment' END, CASE WHEN rejected_contrast < 0.65 THEN 'rejected_contrast' END, CASE WHEN naturalness < 0.75 THEN 'naturalness' END) AS short FROM v""")
def audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair passes if the auditor lets it and no score is short of its minimum; what it falls short of, in order."""
    c = F.col
    rows = scored_pairs(spark, sf_dir).select(
        "o_orderkey", (c("posterior") >= 0.2).alias("model"), c("score_chosen").alias("quality"), F.greatest("posterior", "score_chosen").alias("chosen_alignment"),
        (1 - c("score_rejected")).alias("rejected_contrast"), ((c("score_chosen") + c("posterior")) / 2 + 0.3).alias("naturalness"),
    )
    short = [F.when(~c("model"), "model"), *(F.when(c(name) < least, name) for name, least in MINIMA.items())]
    out = rows.select("o_orderkey", F.concat_ws(",", *short).alias("short"))
    return out.select("o_orderkey", (c("short") == "").alias("passed"), "short")


@query(f"""WITH {PAIRS}, v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE response END AS chosen, CASE WHEN o_orderkey % 5 = 0 THEN response ELSE 'x' || response END AS rejected, prompt FROM pairs)
SELECT o_orderkey, concat_ws(',', CASE WHEN trim(chosen) = '' THEN 'blank chosen' END, CASE WHEN chosen = rejected THEN 'chosen equals rejected' END) AS violations FROM v""")
def validate_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_pairs(spark, sf_dir)
    shown = rows.select("o_orderkey", "prompt", F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("response")).alias("chosen"), F.when(F.col("o_orderkey") % 5 == 0, F.col("response")).otherwise(F.concat(F.lit("x"), "response")).alias("rejected"))
    return P.violations(shown, ["prompt", "chosen", "rejected"]).select("o_orderkey", "violations")


@query("""WITH j AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'label ' || event_type ELSE '{"label": "' || event_type || '", "score": ' || round(value / 10, 3) || '}' END AS payload FROM events WHERE value IS NOT NULL),
p AS (SELECT event_id, regexp_extract(payload, '"label": "([a-z_]+)"', 1) AS label, TRY_CAST(regexp_extract(payload, '"score": ([-0-9.e]+)', 1) AS DOUBLE) AS score FROM j)
SELECT nullif(label, '') AS label, count(*) AS n, count(*) FILTER (score > 1) AS clamped FROM p GROUP BY 1""")
def parse_label_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's answer as JSON; text that is none has no label. Scores are held between 0 and 1."""
    text = F.concat(F.lit('{"label": "'), "event_type", F.lit('", "score": '), F.round(F.col("value") / 10, 3).cast("string"), F.lit("}"))
    rows = read(spark, sf_dir, "events").where("value is not null").select(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("label "), "event_type")).otherwise(text).alias("payload"))
    parsed = rows.select(F.from_json("payload", "label string, score double").alias("x")).select("x.label", "x.score")
    return parsed.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 1).alias("clamped"))


@query("""SELECT lang, count(*) FILTER (contains(lower(text), 'the') OR contains(lower(text), 'of')) AS general, count(*) FILTER (contains(lower(text), 'ing') OR contains(lower(text), 'tion')) AS maths, count(*) FILTER (contains(lower(text), 'tha') OR contains(lower(text), 'ent')) AS confusion FROM documents GROUP BY 1""")
def domain_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"general": GENERAL, "maths": MATHS, "confusion": CONFUSION}
    return read(spark, sf_dir, "documents").groupBy("lang").agg(*(F.count_if(X.contains_any(F.col("text"), terms)).alias(name) for name, terms in flags.items()))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\b(?:idiot|loser|scum)\b', '[word]', 'g'), '[0-9]{4,}', '[number]', 'g') AS text FROM documents""")
def sanitise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.sanitised(F.col("text"), ("idiot", "loser", "scum")).alias("text"))


@query("""SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}') AS digest FROM conversations""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.canonical_hash("turn", "role", "conv_id").alias("digest"))


@query(r"""WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '(?:^|[^0-9.])([0-9]+(?:\.[0-9]+)?)', 1)) AS xs FROM documents) SELECT doc_id, CAST(len(xs) AS INTEGER) AS n FROM n WHERE len(xs) > 0""")
def numeric_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a translation without any would miss."""
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", F.size(F.array_distinct(X.numerals(F.col("text")))).alias("n")).where("n > 0")


@query(f"""WITH {TURNS}, b AS (SELECT conv_id, turn_index, regexp_replace(text, '\\s+', '', 'g') AS t FROM turns), g AS (SELECT conv_id, turn_index, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, CAST(i AS INT), 2))) AS xs FROM b),
p AS (SELECT a.conv_id, a.turn_index, len(list_intersect(a.xs, b.xs)) / len(list_distinct(list_concat(a.xs, b.xs))) AS s FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn_index = a.turn_index - 2)
SELECT conv_id, turn_index, round(s, 6) AS similarity FROM p""")
def question_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of a turn to the same speaker's turn before, by pairs of characters."""
    own = Window.partitionBy("conv_id").orderBy("turn_index")
    rows = turns(spark, sf_dir).select("conv_id", "turn_index", "text", F.lag(F.struct("text"), 2).over(own).alias("before")).where("before is not null")
    rows = rows.select("conv_id", "turn_index", X.bigrams(F.col("text")).alias("xs"), X.bigrams(F.col("before.text")).alias("before"))
    return rows.select("conv_id", "turn_index", F.round(X.jaccard(F.col("xs"), F.col("before")), 6).alias("similarity"))


@query(r"""SELECT doc_id, length(text) >= 20 AS long_enough, NOT regexp_matches(text, '[.!?"]\s*$') AS unfinished, length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) AS unbalanced FROM documents""")
def response_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", (F.length(text) >= 20).alias("long_enough"), (~text.rlike(r'[.!?"]\s*$')).alias("unfinished"), (count("(") != count(")")).alias("unbalanced"))


@query("""SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def survey_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of a participant to an item stands."""
    rows = read(spark, sf_dir, "events")
    last = rows.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return last.select("user_id", "event_type", "x.event_id", F.round("x.value", 6).alias("value"))


LIKERT = "CAST(1 + event_id % 5 AS INTEGER)"


@query(f"""WITH r AS (SELECT event_id, user_id, {LIKERT} AS rating, event_id % 2 = 0 AS flipped FROM events) SELECT user_id, sum((rating - 3) * CASE WHEN flipped THEN -1 ELSE 1 END)::BIGINT AS total, count(*) AS n FROM r GROUP BY 1""")
def likert_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings 1 to 5 as -2 to 2, turned round where the positions were swapped."""
    value = (1 + F.col("event_id") % 5 - 3) * F.when(F.col("event_id") % 2 == 0, -1).otherwise(1)
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(value).cast("long").alias("total"), F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT user_id, event_id, unnest(['A', 'B', 'C']) AS position, unnest([{LIKERT}, CAST(1 + (event_id + 1) % 7 AS INTEGER), CAST(1 + (event_id + 3) % 7 AS INTEGER)]) AS rating FROM events) SELECT event_id, user_id, position, rating FROM r""")
def survey_export_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).select("event_id", "user_id", F.explode("ratings").alias("position", "rating"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as JSON, parsed to a map of positions."""
    e = F.col("event_id")
    text = F.to_json(F.create_map(F.lit("A"), (1 + e % 5).cast("int"), F.lit("B"), (1 + (e + 1) % 7).cast("int"), F.lit("C"), (1 + (e + 3) % 7).cast("int")))
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.from_json(text, "map<string,int>").alias("ratings"))


@query(f"""WITH r AS (SELECT user_id, event_id, unnest(['A', 'B', 'C']) AS position, unnest([{LIKERT}, CAST(1 + (event_id + 1) % 7 AS INTEGER), CAST(1 + (event_id + 3) % 7 AS INTEGER)]) AS rating FROM events),
m AS (SELECT CASE WHEN (ascii(position) - 65 + user_id) % 3 = 0 THEN 'base' WHEN (ascii(position) - 65 + user_id) % 3 = 1 THEN 'basis' ELSE 'random' END AS model_name, rating FROM r)
SELECT model_name, count(*) AS n, round(avg(rating), 6) AS mean FROM m GROUP BY 1""")
def survey_ratings_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions mapped back to models by the participant's order."""
    rows = ratings(spark, sf_dir).select("user_id", F.explode("ratings").alias("position", "rating"))
    place = ((F.ascii("position") - 65 + F.col("user_id")) % 3).cast("int")
    return rows.groupBy(F.element_at(F.array(*map(F.lit, ("base", "basis", "random"))), place + 1).alias("model_name")).agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean"))


@query("SELECT event_type AS choice, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def final_choice_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("choice")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS n_valid FROM events GROUP BY 1")
def scan_jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that parse and those that don't, counted by kind."""
    from pyspark.sql import types as T

    from colloquy.sources.tables import parse_lines

    schema = T.StructType([T.StructField("_corrupt", T.StringType()), T.StructField("k", T.StringType())])
    rows = parse_lines(read(spark, sf_dir, "events").select("event_type", "props"), "props", schema)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("_corrupt").isNull()).alias("n_valid"))


@query("""SELECT doc_id, lang, source FROM (SELECT *, 1 AS pool FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT *, 2 FROM documents WHERE doc_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pool) = 1""")
def pool_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several pools as one: of rows with one key the earliest pool's stands."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    pools = [docs.where("doc_id % 3 = 0").withColumn("pool", F.lit(1)), docs.where("doc_id % 2 = 0").withColumn("pool", F.lit(2))]
    return pools[0].unionByName(pools[1]).groupBy("doc_id").agg(F.min_by(F.struct("lang", "source"), "pool").alias("x")).select("doc_id", "x.lang", "x.source")


@query(f"""WITH {PAIRS} SELECT g.o_orderkey FROM pairs g WHERE g.prompt = 'p5' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.o_orderkey = g.o_orderkey AND p.score_chosen >= 0.5)""")
def gold_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold pairs that the training arm lacks."""
    rows = scored_pairs(spark, sf_dir)
    return rows.where("prompt = 'p5'").select("o_orderkey").join(rows.where("score_chosen >= 0.5").select("o_orderkey"), "o_orderkey", "left_anti")
