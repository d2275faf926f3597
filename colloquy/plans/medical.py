"""Consultations, annotations and splits over the conversations table, whose turns stand for utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators import consultation as C
from colloquy.plans.registry import query
from colloquy.sources.tables import read

#: Word lists of the queries, and what users say in the conversations of each kind (conv_id modulo six): first, and in later turns.
LISTS = C.HealthLists(("cough", "fever", "asthma", "chest pain"), ("cough", "asthma"), ("since yesterday",), ("damn",), (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",))
FIRST = ("I have had a cough since Monday and my chest hurts", "What is asthma and how is it treated", "Please write a short story about a fever", "Tell me about trains", "My head aches, mail me at ann.lee@example.org", "Damn fever, should I see a doctor")
LATER = ("It is worse at night for me", "ok")


def consultations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations with other words: users speak by the kind of conversation, others as they did."""
    rows = read(spark, sf_dir, "conversations")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    kind = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("conv_id") % len(texts)).cast("int") + 1)
    said = F.when(F.col("role") != "user", F.lit("I see.")).when(F.col("nth") == 1, kind(FIRST)).otherwise(kind(LATER))
    return rows.withColumn("nth", nth).select("conv_id", "turn", "role", said.alias("text"))


@query("SELECT conv_id, bool_or(role = 'user') AND conv_id % 6 IN (0, 5) AS consultation FROM conversations GROUP BY conv_id")
def personal_consultation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.personal_consultation(consultations(spark, sf_dir), "conv_id", "turn", LISTS.domain)


@query("""WITH u AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n, conv_id % 6 AS k FROM conversations GROUP BY conv_id)
SELECT conv_id, n > 0 AND k IN (0, 1, 2, 5) AS health, n > 0 AND k IN (0, 1) AS respiratory, n > 0 AND k IN (0, 5) AS personal, n > 1 AND k % 2 = 0 AS followup_information,
n > 0 AND k IN (1, 3) AS single_knowledge, n > 0 AND k = 4 AS explicit_pii, n > 0 AND k = 5 AS toxic_text FROM u""")
def health_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.health_flags(consultations(spark, sf_dir), "conv_id", "turn", LISTS)


#: What assistants say, by turn modulo ten; all but the first two are unsafe.
ADVICE = ("Do not stop taking notes of your dose diary.", "Please take 5 apples and see a doctor.", "Just double your insulin", "Fine! Take 500 mg now", "So you must take 2.5 ml of it", "You definitely have it", "You don't need to visit a hospital", "薬は今日から中止しましょう", "50mgを毎日飲んでください", "受診は必要ありません")


@query("SELECT conv_id, turn, turn % 10 >= 2 AS unsafe FROM conversations WHERE role = 'assistant'")
def unsafe_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = F.element_at(F.array(*map(F.lit, ADVICE)), (F.col("turn") % len(ADVICE)).cast("int") + 1)
    return rows.select("conv_id", "turn", C.unsafe_advice(said).alias("unsafe"))


INTENT = "CASE WHEN length(text) % 3 = 0 THEN 'Inquire' WHEN length(text) % 3 = 1 THEN 'inform ' END"
SLOT = "CASE WHEN role = 'user' THEN 'symptom' WHEN length(text) % 5 = 0 THEN 'History' END"
ANNOTATIONS = f"""a AS (SELECT conv_id, turn, 'first' AS variant, {INTENT} AS intent, {SLOT} AS slot FROM conversations
UNION ALL SELECT conv_id, turn, 'second', CASE WHEN length(text) % 7 = 0 THEN 'chitchat' ELSE {INTENT} END, {SLOT} FROM conversations)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators' labels of each turn, by its length; they differ on some turns."""
    n = F.length("text")
    intent = F.when(n % 3 == 0, "Inquire").when(n % 3 == 1, "inform ")
    slot = F.when(F.col("role") == "user", "symptom").when(n % 5 == 0, "History")
    rows = read(spark, sf_dir, "conversations")
    first = rows.select("conv_id", "turn", F.lit("first").alias("variant"), intent.alias("intent"), slot.alias("slot"))
    second = rows.select("conv_id", "turn", F.lit("second").alias("variant"), F.when(n % 7 == 0, "chitchat").otherwise(intent).alias("intent"), slot.alias("slot"))
    return first.unionByName(second)


@query(f"""WITH {ANNOTATIONS}, x AS (SELECT 'intent' AS kind, lower(trim(intent)) AS name FROM a UNION ALL SELECT 'slot', lower(trim(slot)) FROM a),
s AS (SELECT conv_id, turn, variant, string_agg(coalesce(intent, '-') || '/' || coalesce(slot, '-'), ',' ORDER BY intent, slot) AS said FROM a GROUP BY ALL)
SELECT kind, name, count(*) AS n FROM x WHERE name <> '' GROUP BY 1, 2
UNION ALL SELECT 'disagreement', 'turns', count(*) FILTER (k > 1) FROM (SELECT count(DISTINCT said) AS k FROM s GROUP BY conv_id, turn)""")
def annotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.annotation_summary(annotations(spark, sf_dir), "conv_id", "turn")


@query(f"""WITH {ANNOTATIONS} SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list(lower(trim(intent))) FILTER (trim(intent) <> ''))), ','), '') AS intents, coalesce(array_to_string(list_sort(list_distinct(list(lower(trim(slot))) FILTER (trim(slot) <> ''))), ','), '') AS slots FROM a GROUP BY 1, 2""")
def sample_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents and slots of each turn, of all annotators, sorted."""
    of = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.lower(F.trim(c))))), ",")
    return annotations(spark, sf_dir).groupBy("conv_id", "turn").agg(of("intent").alias("intents"), of("slot").alias("slots"))


@query("""WITH u AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 11 <> 0 GROUP BY 1), a AS (SELECT conv_id, count(*) FILTER (conv_id % 4 <> 0 OR turn > 0) AS n FROM conversations WHERE conv_id % 13 <> 0 GROUP BY 1)
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, CASE WHEN a.n IS NULL THEN 'missing annotations' WHEN u.n IS NULL THEN 'missing utterances' ELSE 'lengths differ' END AS problem FROM u FULL JOIN a ON u.conv_id = a.conv_id WHERE a.n IS NULL OR u.n IS NULL OR a.n <> u.n""")
def align_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues and annotations by key: the same keys, and as many annotations as utterances. Some are made to miss."""
    rows = read(spark, sf_dir, "conversations")
    utterances = rows.where("conv_id % 11 <> 0").groupBy("conv_id").agg(F.collect_list("turn").alias("items"))
    marks = rows.where("conv_id % 13 <> 0").groupBy("conv_id").agg(F.collect_list(F.when((F.col("conv_id") % 4 != 0) | (F.col("turn") > 0), F.col("turn"))).alias("items"))
    return C.aligned_annotations(utterances, marks, "conv_id")


GROUPS = "g AS (SELECT sha256('[' || CAST(to_json(text) AS VARCHAR) || ']') AS digest, min(doc_id) AS representative, string_agg(doc_id, ',' ORDER BY doc_id) AS members, count(*) - 1 AS merged, bool_and(lang = 'de') AS outside FROM documents GROUP BY text)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.to_json(F.array("text")), 256)
    return read(spark, sf_dir, "documents").select("doc_id", "lang", digest.alias("digest"))


@query(f"WITH {GROUPS} SELECT digest, representative, members, merged FROM g WHERE merged > 0")
def merge_annotation_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.merged_variants(variants(spark, sf_dir), "digest", "doc_id").where("merged > 0")
    return rows.select("digest", "representative", F.array_join("members", ",").alias("members"), "merged")


@query(f"WITH {GROUPS}, o AS (SELECT digest, row_number() OVER (ORDER BY sha256('17:' || digest)) AS k FROM g WHERE NOT outside) SELECT g.digest, CASE WHEN g.outside THEN 'test' WHEN k <= 60 THEN 'train' WHEN k <= 90 THEN 'validation' ELSE 'test' END AS split FROM g LEFT JOIN o USING (digest)")
def assign_official_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of fixed size by content; what lies outside the domain is test alone."""
    groups = variants(spark, sf_dir).groupBy("digest").agg(F.bool_and(F.col("lang") == "de").alias("outside"))
    return C.official_splits(groups, "digest", "outside", "17", (60, 30))
