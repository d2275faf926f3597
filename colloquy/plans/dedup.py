"""Duplicates, topics, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators import dedup as D
from colloquy.operators.turns import hash_order
from colloquy.plans.conversations import turns
from colloquy.plans.registry import TURNS, query
from colloquy.sources.tables import read

TOKENS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text, lang")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_dedup(documents(spark, sf_dir), "doc_id", "text", "lang").select("doc_id", "copies")


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n_tokens, list_aggregate(list_sort({TOKENS}), 'string_agg', ' ') AS token_set FROM documents WHERE len({TOKENS}) > 0")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = documents(spark, sf_dir).select("doc_id", F.array_sort(D.tokens(F.col("text"))).alias("t")).where(F.size("t") > 0)
    return sets.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("token_set"))


SIMHASH = f"""t AS (SELECT doc_id, unnest({TOKENS}) AS token FROM documents), h AS (SELECT doc_id, ('0x' || substr(sha256(token), 1, 16))::UBIGINT AS h FROM t),
b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM h, range(64) r(i) GROUP BY 1, 2),
p AS (SELECT doc_id, sum(CASE WHEN s >= 0 THEN (1::HUGEINT << i::INT) ELSE 0 END) AS simhash FROM b GROUP BY 1)"""


@query(f"WITH {SIMHASH} SELECT doc_id, CAST(simhash % 4294967296 AS BIGINT) AS low, CAST(simhash // 4294967296 AS BIGINT) AS high FROM p")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).where(F.size(D.tokens(F.col("text"))) > 0)
    prints = D.simhash64(rows, "doc_id", "text")
    return prints.select("doc_id", F.col("simhash").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("low"), F.shiftrightunsigned("simhash", 32).alias("high"))


@query(f"""WITH {SIMHASH}, s AS (SELECT doc_id, list_sort({TOKENS}) AS tokens FROM documents WHERE len({TOKENS}) > 0), c AS (SELECT tokens, min(doc_id) AS doc_id FROM s GROUP BY 1),
k AS (SELECT p.doc_id, i, (p.simhash // CAST(power(65536, i) AS HUGEINT)) % 65536 AS v FROM p JOIN c USING (doc_id), range(4) r(i)),
m AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.i = y.i AND x.v = y.v AND x.doc_id < y.doc_id),
j AS (SELECT a, b, len(list_intersect(x.tokens, y.tokens)) / len(list_distinct(list_concat(x.tokens, y.tokens))) AS jaccard FROM m JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b),
g AS (SELECT * FROM j WHERE jaccard >= 0.8),
n AS (SELECT a, b, round(jaccard, 8) AS jaccard FROM g)
SELECT 'pair' AS kind, a AS doc_id, b AS class, jaccard FROM n
UNION ALL SELECT 'member', d.doc_id, coalesce(c.doc_id, d.doc_id), NULL FROM documents d LEFT JOIN c ON c.tokens = list_sort({TOKENS})""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of class representatives, and each document's class (the first document with its token set)."""
    rows = documents(spark, sf_dir)
    pairs = D.near_pairs(rows, "doc_id", "text", 0.8).select(F.lit("pair").alias("kind"), F.col("a").alias("doc_id"), F.col("b").alias("class"), F.round("jaccard", 8).alias("jaccard"))
    return pairs.unionByName(D.membership(rows, "doc_id", "text").select(F.lit("member").alias("kind"), "doc_id", "class", F.lit(None).cast("double").alias("jaccard")))


@query()
def near_dup_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.greedy_filter(documents(spark, sf_dir), "doc_id", "text", 0.8)


SPLIT_SQL = "SELECT doc_id, text, lang, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents"


def with_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))


@query(f"WITH s AS ({SPLIT_SQL}) SELECT sha256('[' || CAST(to_json(text) AS VARCHAR) || ']') AS digest, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS copies FROM s GROUP BY text HAVING count(DISTINCT split) > 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.split_leakage(with_split(spark, sf_dir), "split", "text")


@query(f"WITH s AS ({SPLIT_SQL}) SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM s WHERE split = 'test') AS quarantined FROM s WHERE split = 'train'")
def quarantine_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows whose content the test split has too are set apart."""
    rows = with_split(spark, sf_dir).select("doc_id", "split", F.sha2("text", 256).alias("digest"))
    test = rows.where("split = 'test'").select("digest").distinct().withColumn("hit", F.lit(True))
    return rows.where("split = 'train'").join(test, "digest", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("quarantined"))


@query(f"WITH s AS ({SPLIT_SQL}) SELECT lang, count(*) AS leaked FROM (SELECT DISTINCT lang, text FROM s WHERE split = 'train' INTERSECT SELECT DISTINCT lang, text FROM s WHERE split = 'test') GROUP BY 1")
def eval_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_split(spark, sf_dir).select("lang", F.sha2("text", 256).alias("digest"), "split")
    both = rows.where("split = 'train'").select("lang", "digest").intersect(rows.where("split = 'test'").select("lang", "digest"))
    return both.groupBy("lang").agg(F.count("*").alias("leaked"))


VECTORS = f"""t AS (SELECT doc_id, unnest({TOKENS}) AS token FROM documents), n AS (SELECT doc_id, CAST(('0x' || substr(sha256(token), 1, 8))::UBIGINT % 2048 AS INTEGER) AS slot, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2),
v AS (SELECT doc_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS value FROM n),
bt AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark), bn AS (SELECT CAST(('0x' || substr(sha256(token), 1, 8))::UBIGINT % 2048 AS INTEGER) AS slot, count(*)::DOUBLE AS n FROM bt GROUP BY 1),
r AS (SELECT slot, n / (SELECT sqrt(sum(n * n)) FROM bn) AS r FROM bn), s AS (SELECT doc_id, sum(value * coalesce(r, 0)) AS similarity FROM v LEFT JOIN r USING (slot) GROUP BY 1)"""


def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each document to all benchmark items taken as one text."""
    items = read(spark, sf_dir, "benchmark").select(F.lit(0).alias("ref"), F.explode(D.tokens(F.col("text"))).alias("token")).distinct()
    slot = (F.conv(F.substring(F.sha2("token", 256), 1, 8), 16, 10).cast("long") % 2048).cast("int")
    counts = items.groupBy("ref", slot.alias("slot")).agg(F.count("*").cast("double").alias("n"))
    reference = counts.select("slot", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("ref")))).alias("value"))
    return D.topic_similarity(D.topic_vectors(documents(spark, sf_dir), "doc_id", "text"), reference, "doc_id")


@query(f"WITH {VECTORS} SELECT doc_id, round(similarity, 8) AS similarity FROM s")
def topic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_scores(spark, sf_dir).select("doc_id", F.round("similarity", 8).alias("similarity"))


@query(f"WITH {VECTORS} SELECT doc_id, round(similarity, 8) AS similarity FROM s ORDER BY round(similarity, 8) DESC, doc_id LIMIT 50")
def topic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_similarity(spark, sf_dir).orderBy(F.desc("similarity"), "doc_id").limit(50)


@query(f"""WITH {TURNS}, c AS (SELECT DISTINCT conv_id FROM turns), r AS (SELECT conv_id, sha256('42:' || conv_id) AS o FROM c), n AS (SELECT conv_id, row_number() OVER (ORDER BY o) AS k, count(*) OVER () AS n FROM r)
SELECT conv_id, CASE WHEN k <= round_even(n * 0.15, 0) THEN 'validation' ELSE 'train' END AS split FROM n""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split of exact size in hash order. The cut is the hash at that rank: it is found by count, and no row is numbered in one task."""
    rows = turns(spark, sf_dir).select("conv_id").distinct().withColumn("o", hash_order("42", "conv_id"))
    return exact_split(rows, 0.15)


def exact_split(rows: DataFrame, share: float) -> DataFrame:
    n = rows.count()
    wanted = int(rows.sparkSession.range(1).select(F.bround(F.lit(n * share), 0)).first()[0])
    if not wanted:
        return rows.select("conv_id", F.lit("train").alias("split"))
    # the hash's leading digits narrow the search to one prefix, whose rows are few
    prefix = rows.groupBy(F.substring("o", 1, 4).alias("p")).count()
    counted = prefix.withColumn("upto", F.sum("count").over(Window.orderBy("p")))
    edge = counted.where(F.col("upto") >= wanted).orderBy("p").first()
    rank = wanted - (edge["upto"] - edge["count"])
    cut = rows.where(F.substring("o", 1, 4) == edge["p"]).orderBy("o").limit(rank).agg(F.max("o")).first()[0]
    return rows.select("conv_id", F.when(F.col("o") <= cut, "validation").otherwise("train").alias("split"))


@query(f"WITH {TURNS} SELECT conv_id, turn_index FROM turns WHERE role = 'assistant' ORDER BY sha256('7:' || conv_id || ':' || turn_index) LIMIT 60")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where("role = 'assistant'").orderBy(hash_order("7", "conv_id", "turn_index")).limit(60).select("conv_id", "turn_index")


@query("""WITH c AS (SELECT DISTINCT lang, source FROM documents), r AS (SELECT d.lang, d.source, d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY sha256('q:' || d.doc_id)) AS k FROM documents d)
SELECT lang, doc_id FROM r WHERE k <= 20""")
def category_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("lang").orderBy(hash_order("q", "doc_id"))
    return documents(spark, sf_dir).withColumn("k", F.row_number().over(own)).where("k <= 20").select("lang", "doc_id")


@query("""WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('p:' || doc_id)) AS k FROM documents)
SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY lang ORDER BY k, source) AS INTEGER) AS position FROM r QUALIFY position <= 40""")
def priority_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a tier (language) the buckets (sources) take turns."""
    own = Window.partitionBy("lang", "source").orderBy(hash_order("p", "doc_id"))
    turn = Window.partitionBy("lang").orderBy("k", "source")
    rows = documents(spark, sf_dir).withColumn("k", F.row_number().over(own)).where("k <= 40")
    return rows.withColumn("position", F.row_number().over(turn)).where("position <= 40").select("doc_id", "lang", "source", "position")


@query("""WITH t AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT d.lang, d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY t.n, d.doc_id) AS k FROM documents d JOIN t USING (lang, source))
SELECT lang, doc_id FROM r WHERE k <= 10""")
def rarity_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("lang", "source", "doc_id")
    rare = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang").orderBy("n", "doc_id")
    return rows.join(rare, ["lang", "source"]).withColumn("k", F.row_number().over(own)).where("k <= 10").select("lang", "doc_id")


@query("""WITH r AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY sha256('v:' || doc_id)) - 1) % 3 AS v FROM documents)
SELECT doc_id, CAST(v AS INTEGER) AS version, CASE v WHEN 0 THEN 'ABC' WHEN 1 THEN 'BCA' ELSE 'CAB' END AS response_order FROM r""")
def counterbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("lang").orderBy(hash_order("v", "doc_id"))
    rows = documents(spark, sf_dir).withColumn("version", ((F.row_number().over(own) - 1) % 3).cast("int"))
    return rows.select("doc_id", "version", F.element_at(F.array(F.lit("ABC"), F.lit("BCA"), F.lit("CAB")), F.col("version") + 1).alias("response_order"))


@query(f"""WITH RECURSIVE {TURNS}, l AS (SELECT conv_id, turn_index, length(text)::BIGINT AS n FROM turns), f AS (
 SELECT conv_id, turn_index, n AS used, 1::BIGINT AS items, 0::BIGINT AS batch FROM l WHERE turn_index = 0
 UNION ALL SELECT l.conv_id, l.turn_index, CASE WHEN f.used + l.n > 400 OR f.items >= 3 THEN l.n ELSE f.used + l.n END, CASE WHEN f.used + l.n > 400 OR f.items >= 3 THEN 1 ELSE f.items + 1 END, f.batch + (f.used + l.n > 400 OR f.items >= 3)::BIGINT
 FROM f JOIN l ON l.conv_id = f.conv_id AND l.turn_index = f.turn_index + 1)
SELECT conv_id, turn_index, batch FROM f""")
def char_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in batches of at most three and 400 characters; one that doesn't fit starts the next."""
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", F.length("text").cast("long").alias("n")))).alias("xs"))

    def step(acc, x):
        new = (acc["items"] > 0) & ((acc["used"] + x["n"] > 400) | (acc["items"] >= 3))
        batch = acc["batch"] + new.cast("long")
        return F.struct(F.when(new, x["n"]).otherwise(acc["used"] + x["n"]).alias("used"), F.when(new, F.lit(1).cast("long")).otherwise(acc["items"] + 1).alias("items"), batch.alias("batch"), F.concat(acc["out"], F.array(F.struct(x["turn_index"].alias("turn_index"), batch.alias("batch")))).alias("out"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("used"), zero.alias("items"), zero.alias("batch"), F.array().cast("array<struct<turn_index:int,batch:bigint>>").alias("out"))
    out = rows.select("conv_id", F.explode(F.aggregate("xs", start, step, lambda acc: acc["out"])).alias("x"))
    return out.select("conv_id", "x.turn_index", "x.batch")
