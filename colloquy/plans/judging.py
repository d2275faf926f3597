"""Judge scores of several models: summaries, comparisons and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import stats as X
from colloquy.operators.dedup import reliable
from colloquy.plans.registry import query
from colloquy.sources.tables import dealt, read

MODELS, AXES = ("base", "basis", "random"), ("empathy", "guidance", "safety")
WEIGHTS = (0.5, 0.3, 0.2)

JUDGE = """judge AS (SELECT p_partkey AS sample_id, p_brand AS category, m.model AS model_name, a.axis AS axis, CAST(1 + (p_partkey * (m.k + 3) + p_size * (a.k + 2) + m.k * a.k) % 10 AS DOUBLE) AS value
 FROM part, (VALUES ('base', 1), ('basis', 2), ('random', 3)) m(model, k), (VALUES ('empathy', 1), ('guidance', 2), ('safety', 3)) a(axis, k)),
 overall AS (SELECT sample_id, category, model_name, avg(value) AS value FROM judge GROUP BY ALL)"""


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample, model and axis, made from the parts: key, brand and size give the score. A sample's rows lie in one task, so that what is grouped by sample isn't shuffled again."""
    rows = dealt(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    pairs = F.array(*(F.struct(F.lit(m).alias("model_name"), F.lit(i).alias("m"), F.lit(a).alias("axis"), F.lit(j).alias("a")) for i, m in enumerate(MODELS, 1) for j, a in enumerate(AXES, 1)))
    rows = rows.withColumn("x", F.explode(pairs))
    value = 1 + (F.col("p_partkey") * (F.col("x.m") + 3) + F.col("p_size") * (F.col("x.a") + 2) + F.col("x.m") * F.col("x.a")) % 10
    return rows.select(F.col("p_partkey").alias("sample_id"), F.col("p_brand").alias("category"), "x.model_name", "x.axis", value.cast("double").alias("value"))


def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, sf_dir).groupBy("sample_id", "category", "model_name").agg(F.avg("value").alias("value"))


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in rows.columns))


@query(f"WITH {JUDGE} SELECT model_name, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM overall GROUP BY 1")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overall(spark, sf_dir).groupBy("model_name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")), "mean", "sd")


@query(f"WITH {JUDGE} SELECT model_name, axis, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM judge GROUP BY 1, 2")
def axis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judge(spark, sf_dir).groupBy("model_name", "axis").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")), "mean", "sd")


@query(f"""WITH {JUDGE} SELECT a.model_name AS left_model, b.model_name AS right_model, count(*) AS n, count(*) FILTER (round(a.value - b.value, 6) >= 0.25) AS wins, count(*) FILTER (abs(round(a.value - b.value, 6)) < 0.25) AS ties, count(*) FILTER (round(a.value - b.value, 6) <= -0.25) AS losses
FROM overall a JOIN overall b ON a.sample_id = b.sample_id AND a.model_name < b.model_name GROUP BY 1, 2""")
def pairwise_winrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pivot instead of a self-join: each sample's models stand in one row."""
    wide = overall(spark, sf_dir).groupBy("sample_id").pivot("model_name", list(MODELS)).agg(F.first("value"))
    pairs = F.array(*(F.struct(F.lit(a).alias("left_model"), F.lit(b).alias("right_model"), F.round(F.col(a) - F.col(b), 6).alias("d")) for i, a in enumerate(MODELS) for b in MODELS[i + 1 :]))
    d = F.col("d")
    return wide.select(F.explode(pairs).alias("x")).select("x.*").where("d is not null").groupBy("left_model", "right_model").agg(F.count("*").alias("n"), F.count_if(d >= 0.25).alias("wins"), F.count_if(F.abs(d) < 0.25).alias("ties"), F.count_if(d <= -0.25).alias("losses"))


@query(f"""WITH {JUDGE}, w AS (SELECT sample_id, any_value(category) AS category, max(value) FILTER (model_name = 'basis') - max(value) FILTER (model_name = 'base') AS gap FROM overall GROUP BY 1)
SELECT coalesce(category, 'all') AS category, count(*) AS n, round(avg(gap), 6) AS mean_gap, count(*) FILTER (gap > 0) AS wins, count(*) FILTER (gap = 0) AS ties, count(*) FILTER (gap < 0) AS losses FROM w GROUP BY ROLLUP (category)""")
def judgment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.max(F.when(F.col("model_name") == "basis", F.col("value"))) - F.max(F.when(F.col("model_name") == "base", F.col("value")))
    wide = overall(spark, sf_dir).groupBy("sample_id", "category").agg(gap.alias("gap"))
    out = wide.rollup("category").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.count_if(F.col("gap") > 0).alias("wins"), F.count_if(F.col("gap") == 0).alias("ties"), F.count_if(F.col("gap") < 0).alias("losses"))
    return out.withColumn("category", F.coalesce("category", F.lit("all")))


WEIGHTED = "sum(value * CASE axis WHEN 'empathy' THEN 0.5 WHEN 'guidance' THEN 0.3 ELSE 0.2 END)"


@query(f"WITH {JUDGE}, s AS (SELECT sample_id, model_name, round({WEIGHTED}, 6) AS score FROM judge GROUP BY 1, 2) SELECT model_name, sample_id, score FROM s QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY score DESC, sample_id) <= 5")
def weighted_axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five samples of each model by weighted axes."""
    weight = F.element_at(F.create_map(*(F.lit(x) for item in zip(AXES, WEIGHTS, strict=True) for x in item)), F.col("axis"))
    scores = judge(spark, sf_dir).groupBy("sample_id", "model_name").agg(F.round(F.sum(F.col("value") * weight), 6).alias("score"))
    own = Window.partitionBy("model_name").orderBy(F.desc("score"), "sample_id")
    return scores.withColumn("k", F.row_number().over(own)).where("k <= 5").select("model_name", "sample_id", "score")


@query(f"WITH {JUDGE}, j AS (SELECT * FROM overall WHERE NOT (sample_id % 11 = 0 AND model_name = 'random')) SELECT sample_id, model_name, round(value, 6) AS value FROM j WHERE sample_id IN (SELECT sample_id FROM j GROUP BY 1 HAVING count(DISTINCT model_name) = 3)")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overall(spark, sf_dir).where("not (sample_id % 11 = 0 and model_name = 'random')")
    return rounded(X.complete_cases(rows, ["sample_id"], 3).select("sample_id", "model_name", "value"), "value")


RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY axis, sample_id ORDER BY value) + (count(*) OVER (PARTITION BY axis, sample_id, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY axis, sample_id, value) AS t FROM judge)"


@query(f"WITH {JUDGE}, {RANKED} SELECT axis, model_name, round(avg(rk), 6) AS mean_rank FROM r GROUP BY 1, 2")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.average_ranks(judge(spark, sf_dir), ["axis", "sample_id"], "value").groupBy("axis", "model_name").agg(F.round(F.avg("rank"), 6).alias("mean_rank"))


FRIEDMAN = f"""{JUDGE}, {RANKED}, s AS (SELECT axis, model_name, sum(rk) AS r, count(*) AS n FROM r GROUP BY 1, 2), q AS (SELECT axis, sum(r * r) AS s, max(n) AS n FROM s GROUP BY 1), t AS (SELECT axis, sum(t * t - 1) AS t FROM r GROUP BY 1),
 c AS (SELECT axis, n, (12.0::DOUBLE * s / (n * 12) - 12.0::DOUBLE * n) / (1.0::DOUBLE - t / (n * 24)) AS chi2 FROM q JOIN t USING (axis))"""


@query(f"WITH {FRIEDMAN} SELECT axis, n, round(chi2, 6) AS chi2, round(chi2 / (n * 2), 6) AS kendall_w, round(exp(-chi2 / 2), 6) AS p FROM c")
def friedman3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.friedman(judge(spark, sf_dir), "axis", "sample_id", 3), "chi2", "kendall_w", "p")


@query()
def friedman4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(spark, sf_dir)
    own = F.struct("model_name", "value")
    fourth = F.struct(F.lit("gold").alias("model_name"), F.greatest(F.lit(1.0), F.col("value") - F.col("sample_id") % 3).alias("value"))
    four = rows.select("sample_id", "axis", F.inline(F.when(F.col("model_name") == "base", F.array(own, fourth)).otherwise(F.array(own))))
    return rounded(X.friedman(four, "axis", "sample_id", 4), "chi2", "kendall_w", "p")


@query(f"WITH {FRIEDMAN}, p AS (SELECT axis, exp(-chi2 / 2) AS p FROM c), h AS (SELECT axis, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p) + 1)) AS st FROM p) SELECT axis, round(p, 6) AS p, round(max(st) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM h")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.holm(X.friedman(judge(spark, sf_dir), "axis", "sample_id", 3).select("axis", "p"), "p"), "p", "adjusted")


DIFFS = "d AS (SELECT axis, sample_id, max(value) FILTER (model_name = 'basis') - max(value) FILTER (model_name = 'base') AS d FROM judge GROUP BY 1, 2)"


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.paired_differences(judge(spark, sf_dir), ["axis", "sample_id"], "basis", "base")


@query(f"""WITH {JUDGE}, {DIFFS}, m AS (SELECT axis, d, rank() OVER (PARTITION BY axis ORDER BY abs(d)) + (count(*) OVER (PARTITION BY axis, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
b AS (SELECT axis, (sum(r) FILTER (d > 0) - sum(r) FILTER (d < 0)) / sum(r) AS rank_biserial FROM m GROUP BY 1)
SELECT axis, count(*) AS n, round(avg(d) / stddev_samp(d), 6) AS dz, count(*) FILTER (d >= 1) AS wins, count(*) FILTER (abs(d) < 1) AS ties, count(*) FILTER (d <= -1) AS losses, round(any_value(rank_biserial), 6) AS rank_biserial FROM d JOIN b USING (axis) GROUP BY 1""")
def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.effect_sizes(differences(spark, sf_dir), "axis", 1.0), "dz", "rank_biserial")


@query(f"""WITH RECURSIVE {JUDGE}, {DIFFS}, c AS (SELECT axis, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses FROM d GROUP BY 1),
f AS (SELECT axis, wins + losses AS n, least(wins, losses) AS low, 0::BIGINT AS i, -(wins + losses) * ln(2.0::DOUBLE) AS lg FROM c UNION ALL SELECT axis, n, low, i + 1, lg + ln((n - i)::DOUBLE / (i + 1)) FROM f WHERE i < low)
SELECT c.axis, any_value(wins) AS wins, any_value(losses) AS losses, round(least(1.0, 2 * sum(exp(lg))), 6) AS p FROM c JOIN f ON c.axis = f.axis GROUP BY 1""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.sign_test(differences(spark, sf_dir), "axis"), "p")


@query(f"""WITH {JUDGE}, {DIFFS}, o AS (SELECT axis, abs(avg(d)) AS o FROM d GROUP BY 1), m AS (SELECT axis, g.k, abs(avg(d * CASE WHEN substr(md5('perm:' || g.k || ':' || sample_id), 1, 1) < '8' THEN 1.0 ELSE -1.0 END)) AS m FROM d, range(1, 51) g(k) GROUP BY 1, 2)
SELECT axis, round((count(*) FILTER (m >= o - 1e-12) + 1) / 51, 6) AS p FROM m JOIN o USING (axis) GROUP BY 1""")
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.permutation_p(differences(spark, sf_dir), "axis", "sample_id", 50), "p")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.interval(X.bootstrap_means(overall(spark, sf_dir), "model_name", "sample_id", 100), "model_name", 100), "low", "high")


@query(f"WITH {JUDGE} SELECT model_name, category, count(*) AS n, round(avg(value), 6) AS mean FROM overall GROUP BY 1, 2")
def cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means within a cluster first, so that a cluster counts once in what follows."""
    return rounded(overall(spark, sf_dir).groupBy("model_name", "category").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overall(spark, sf_dir).groupBy("model_name", "category").agg(F.avg("value").alias("value"))
    return rounded(X.interval(X.bootstrap_means(rows, "model_name", "category", 100), "model_name", 100, "linear"), "low", "high")


@query(f"""WITH {JUDGE}, s AS (SELECT j.*, p_type AS kind FROM judge j JOIN part ON p_partkey = sample_id), u AS (SELECT axis, model_name, value, 'category' AS stratum_type, category AS stratum FROM s UNION ALL SELECT axis, model_name, value, 'kind', kind FROM s)
SELECT axis, stratum_type, stratum, model_name, count(*) AS n, round(avg(value), 6) AS mean FROM u GROUP BY ALL""")
def strata_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets over two kinds of strata in one pass."""
    kinds = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_type").alias("kind"))
    rows = judge(spark, sf_dir).join(kinds, "sample_id")
    out = spark.sql("SELECT axis, category, kind, model_name, count(*) AS n, round(avg(value), 6) AS mean, grouping(category) AS g FROM {rows} GROUP BY GROUPING SETS ((axis, model_name, category), (axis, model_name, kind))", rows=rows)
    return out.select("axis", F.when(F.col("g") == 0, "category").otherwise("kind").alias("stratum_type"), F.when(F.col("g") == 0, F.col("category")).otherwise(F.col("kind")).alias("stratum"), "model_name", "n", "mean")


@query(f"""WITH {JUDGE}, w AS (SELECT sample_id, max(value) FILTER (model_name = 'basis') - greatest(max(value) FILTER (model_name = 'base'), max(value) FILTER (model_name = 'random')) AS margin FROM overall GROUP BY 1)
SELECT sample_id, round(margin, 6) AS margin FROM w ORDER BY round(margin, 6) DESC, sample_id DESC LIMIT 30""")
def margin_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = overall(spark, sf_dir).groupBy("sample_id").pivot("model_name", list(MODELS)).agg(F.first("value"))
    rows = wide.select("sample_id", F.round(F.col("basis") - F.greatest("base", "random"), 6).alias("margin"))
    return rows.orderBy(F.desc("margin"), F.desc("sample_id")).limit(30)


@query(f"""WITH {JUDGE}, a AS (SELECT category, model_name, avg(value) AS m FROM overall GROUP BY 1, 2) SELECT x.category, x.model_name, round(x.m - b.m, 6) AS gap FROM a x LEFT JOIN a b ON b.category = x.category AND b.model_name = 'base' AND x.category <> 'Brand#11'""")
def baseline_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap to a baseline summary; null where the baseline has no such category."""
    means = overall(spark, sf_dir).groupBy("category", "model_name").agg(F.avg("value").alias("m"))
    base = means.where("model_name = 'base' and category <> 'Brand#11'").select("category", F.col("m").alias("b"))
    return means.join(base, "category", "left").select("category", "model_name", F.round(F.col("m") - F.col("b"), 6).alias("gap"))


@query(f"""WITH {JUDGE}, w AS (SELECT max(value) FILTER (model_name = 'basis') - max(value) FILTER (model_name = 'base') AS g FROM overall GROUP BY sample_id)
SELECT CASE WHEN round(g, 6) <= -2 THEN 'much worse' WHEN round(g, 6) < 0 THEN 'worse' WHEN round(g, 6) = 0 THEN 'same' WHEN round(g, 6) < 2 THEN 'better' ELSE 'much better' END AS bucket, count(*) AS n FROM w GROUP BY 1""")
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.round(F.max(F.when(F.col("model_name") == "basis", F.col("value"))) - F.max(F.when(F.col("model_name") == "base", F.col("value"))), 6)
    rows = overall(spark, sf_dir).groupBy("sample_id").agg(g.alias("g"))
    name = F.when(F.col("g") <= -2, "much worse").when(F.col("g") < 0, "worse").when(F.col("g") == 0, "same").when(F.col("g") < 2, "better").otherwise("much better")
    return rows.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {JUDGE}, f AS (SELECT * FROM overall WHERE sample_id % 2 = 0 OR model_name <> 'random'), k AS (SELECT sample_id, string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS models FROM f GROUP BY 1)
SELECT models, count(*) AS samples, models = 'base,basis,random' AS complete FROM k GROUP BY 1""")
def merge_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overall(spark, sf_dir)
    merged = rows.where("model_name <> 'random'").unionByName(rows.where("model_name = 'random' and sample_id % 2 = 0"))
    models = merged.groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_set("model_name")), ",").alias("models"))
    return models.groupBy("models").agg(F.count("*").alias("samples")).withColumn("complete", F.col("models") == ",".join(MODELS))


@query(f"""WITH {JUDGE}, b AS (SELECT DISTINCT sample_id, CASE sample_id % 3 WHEN 0 THEN ['base', 'basis', 'random'] WHEN 1 THEN ['basis', 'random', 'base'] ELSE ['random', 'base', 'basis'] END AS o FROM judge)
SELECT sample_id, CAST(i AS INTEGER) AS position, o[i + 1] AS model_name FROM b, range(3) r(i)""")
def blind_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = F.array(*(F.array(*map(F.lit, x)) for x in (MODELS, MODELS[1:] + MODELS[:1], MODELS[2:] + MODELS[:2])))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"))
    return rows.select("sample_id", F.posexplode(F.element_at(orders, (F.col("sample_id") % 3 + 1).cast("int"))).alias("position", "model_name"))


@query(f"""WITH {JUDGE} SELECT substr(sha256('blind:' || sample_id || ':' || model_name), 1, 12) AS blind_id, sample_id, model_name, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY sha256('wave:' || sample_id || ':' || model_name)) AS INTEGER) AS wave FROM overall""")
def blind_answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda seed: F.sha2(F.concat_ws(":", F.lit(seed), F.col("sample_id").cast("string"), "model_name"), 256)
    wave = F.row_number().over(Window.partitionBy("sample_id").orderBy(digest("wave")))
    return overall(spark, sf_dir).select(F.substring(digest("blind"), 1, 12).alias("blind_id"), "sample_id", "model_name", wave.alias("wave"))


@query(f"""WITH {JUDGE}, w AS (SELECT sample_id, max(value) FILTER (model_name = 'basis') AS dpo, max(value) FILTER (model_name = 'base') AS base, substr(md5('ab:' || sample_id), 1, 1) < '8' AS base_first FROM overall GROUP BY 1)
SELECT sample_id, base_first, round(CASE WHEN base_first THEN base ELSE dpo END, 6) AS score_a, round(CASE WHEN base_first THEN dpo ELSE base END, 6) AS score_b, round(dpo - base, 6) AS gap, CASE WHEN round(abs(dpo - base), 6) < 0.25 THEN 'tie' WHEN dpo > base THEN 'dpo' ELSE 'base' END AS winner FROM w""")
def ab_unblind(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda m: F.max(F.when(F.col("model_name") == m, F.col("value")))
    rows = overall(spark, sf_dir).groupBy("sample_id").agg(of("basis").alias("dpo"), of("base").alias("base")).withColumn("base_first", F.substring(F.md5(F.concat(F.lit("ab:"), F.col("sample_id").cast("string"))), 1, 1) < "8")
    shown = rows.withColumn("a", F.when(F.col("base_first"), F.col("base")).otherwise(F.col("dpo"))).withColumn("b", F.when(F.col("base_first"), F.col("dpo")).otherwise(F.col("base")))
    gap = F.round(F.when(F.col("base_first"), F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b")), 6)
    winner = F.when(F.abs(gap) < 0.25, "tie").when(gap > 0, "dpo").otherwise("base")
    return shown.select("sample_id", "base_first", F.round("a", 6).alias("score_a"), F.round("b", 6).alias("score_b"), gap.alias("gap"), winner.alias("winner"))


@query(f"""WITH {JUDGE}, s AS (SELECT x.axis AS dropped, sample_id, model_name, avg(value) AS v FROM judge, (VALUES ('empathy'), ('guidance'), ('safety')) x(axis) WHERE judge.axis <> x.axis GROUP BY ALL)
SELECT dropped, model_name, round(avg(v), 6) AS mean FROM s GROUP BY 1, 2""")
def axis_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means without one axis each: a row feeds the two ablations that keep its axis."""
    others = F.explode(F.filter(F.array(*map(F.lit, AXES)), lambda a: a != F.col("axis")))
    rows = judge(spark, sf_dir).withColumn("dropped", others).groupBy("dropped", "sample_id", "model_name").agg(F.avg("value").alias("v"))
    return rows.groupBy("dropped", "model_name").agg(F.round(F.avg("v"), 6).alias("mean"))


@query(f"""WITH {JUDGE}, w AS (SELECT sample_id, any_value(category) AS category, max(value) FILTER (model_name = 'basis') - greatest(max(value) FILTER (model_name = 'base'), max(value) FILTER (model_name = 'random')) AS advantage FROM overall GROUP BY 1)
SELECT category, sample_id, round(advantage, 6) AS advantage FROM w QUALIFY row_number() OVER (PARTITION BY category ORDER BY round(advantage, 6) DESC, sample_id) <= 2""")
def representative_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = overall(spark, sf_dir).groupBy("sample_id", "category").pivot("model_name", list(MODELS)).agg(F.first("value"))
    rows = wide.select("category", "sample_id", F.round(F.col("basis") - F.greatest("base", "random"), 6).alias("advantage"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("advantage"), "sample_id"))).where("k <= 2").drop("k")


@query("""SELECT s.* FROM (SELECT c_custkey AS sample_id, UNNEST(['base', 'basis', 'random']) AS model_name, UNNEST([c_name, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'r' || c_custkey END]) AS response FROM customer) s WHERE trim(response) <> ''""")
def unpivot_model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each response that isn't blank."""
    wide = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("base"), F.col("c_mktsegment").alias("basis"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit("r"), F.col("c_custkey").cast("string"))).alias("random"))
    return wide.unpivot(["sample_id"], list(MODELS), "model_name", "response").where(F.trim("response") != "")


@query("""WITH s AS (SELECT doc_id, quality AS gold, CASE WHEN length(text) > 400 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)), c AS (SELECT l.label AS label, count(*) FILTER (gold = l.label AND predicted = l.label) AS tp, count(*) FILTER (gold <> l.label AND predicted = l.label) AS fp, count(*) FILTER (gold = l.label AND predicted <> l.label) AS fn FROM s, (VALUES (0), (1)) l(label) GROUP BY 1)
SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold"))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 400).cast("int").alias("predicted")).join(gold, "doc_id")
    return per_label(rows)


def per_label(rows: DataFrame) -> DataFrame:
    """rows: gold, predicted. The confusion counts are taken first, so a label's figures come from a handful of rows."""
    cells = rows.groupBy("gold", "predicted").count()
    marked = cells.withColumn("label", F.explode(F.array_distinct(F.array("gold", "predicted"))))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    hit, told = F.col("gold") == F.col("label"), F.col("predicted") == F.col("label")
    out = marked.groupBy("label").agg(of(hit & told).alias("tp"), of(~hit & told).alias("fp"), of(hit & ~told).alias("fn"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("label", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("""WITH p AS (SELECT lang AS label, count(*) / sum(count(*)) OVER () AS p FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), q AS (SELECT lang AS label, count(*) / sum(count(*)) OVER () AS q FROM documents WHERE doc_id % 2 = 1 GROUP BY 1),
m AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q USING (label))
SELECT round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END), 6) AS jsd, round(0.5 * sum(abs(p - q)), 6) AS tvd, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS entropy, round(max(p), 6) AS mode_ratio FROM m""")
def strategy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between two label distributions: a table of the labels, with a column for each."""
    rows = read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.count_if(F.col("doc_id") % 2 == 0).alias("a"), F.count_if(F.col("doc_id") % 2 == 1).alias("b"))
    whole = Window.partitionBy()
    m = rows.select((F.col("a") / F.sum("a").over(whole)).alias("p"), (F.col("b") / F.sum("b").over(whole)).alias("q"))
    p, q = F.col("p"), F.col("q")
    part = lambda x: F.when(x > 0, 0.5 * x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return m.agg(F.round(F.sum(part(p) + part(q)), 6).alias("jsd"), F.round(0.5 * F.sum(F.abs(p - q)), 6).alias("tvd"), F.round(-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0)), 6).alias("entropy"), F.round(F.max(p), 6).alias("mode_ratio"))


@query("""WITH s AS (SELECT p_partkey AS k, (p_retailprice % 100) / 100 AS x, (p_size * 7 % 100) / 100 AS y FROM part), r AS (SELECT *, row_number() OVER (ORDER BY x DESC, k) AS rx, row_number() OVER (ORDER BY y DESC, k) AS ry, count(*) OVER () AS n FROM s)
SELECT max(n) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(stddev_pop(x), 6) AS sd_x, round(avg(abs(x - y)), 6) AS mean_gap, round(1 - 6 * sum((rx - ry) * (rx - ry))::DOUBLE / (max(n)::DOUBLE * (max(n)::DOUBLE * max(n) - 1)), 6) AS spearman, round(count(*) FILTER (rx <= 50 AND ry <= 50) / 50, 6) AS overlap FROM r""")
def compare_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal ranks, made by range partition: within one by row number, between them by counts."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") % 100 / 100).alias("x"), (F.col("p_size") * 7 % 100 / 100).alias("y"))
    ranked = ordinal(ordinal(rows, "x", "rx"), "y", "ry")
    n = F.count("*").cast("double")
    return ranked.agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.stddev_pop("x"), 6).alias("sd_x"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mean_gap"),
                      F.round(1 - 6 * F.sum((F.col("rx") - F.col("ry")) * (F.col("rx") - F.col("ry"))).cast("double") / (n * (n * n - 1)), 6).alias("spearman"), F.round(F.count_if((F.col("rx") <= 50) & (F.col("ry") <= 50)) / 50, 6).alias("overlap"))


def ordinal(rows: DataFrame, value: str, name: str) -> DataFrame:
    """name: the row's place by descending value, then k. The ranges are checkpointed, so that both branches see the same."""
    dealt = reliable(rows.repartitionByRange(F.desc(value), "k").withColumn("_part", F.spark_partition_id()))
    dealt = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(value), "k")))
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_n", "_before")
