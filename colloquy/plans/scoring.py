"""Labels of a rule, the forward filters over them, and what is selected by their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators import scoring as S
from colloquy.plans.conversations import turns
from colloquy.plans.registry import LABELLED, TURNS, query

MODEL = S.TransitionModel(
    states=("opening", "deepening", "closing", "off_style"),
    observations=("generic", "followup", "elaborate"),
    positive=("deepening", "closing"),
    negative=("opening", "off_style"),
    initial=(0.40, 0.30, 0.10, 0.20),
    transition=((0.45, 0.35, 0.05, 0.15), (0.10, 0.55, 0.25, 0.10), (0.15, 0.20, 0.55, 0.10), (0.30, 0.20, 0.05, 0.45)),
    emission=((0.45, 0.30, 0.25), (0.10, 0.55, 0.35), (0.15, 0.25, 0.60), (0.70, 0.20, 0.10)),
)
BINARY = S.BinaryModel(observations=("generic", "followup", "elaborate"), prior=0.45, positive=(0.15, 0.45, 0.40), negative=(0.55, 0.25, 0.20))
PREFER_STATES, PREFER_OBSERVATIONS = ["deepening", "closing"], ["followup"]


def observation():
    """The rule that stands in for a judge: by the length of the text."""
    n = F.length("text")
    return F.when(n < 60, "generic").when(n % 2 == 0, "followup").otherwise("elaborate")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn_index", "text", observation().alias("observation"))


def filter_sql(where: str = "", start: str = "") -> str:
    """A recursive query over the turns of each conversation, one column per state."""
    m = MODEL.normalised()
    n = range(len(m.states))
    initial = ", ".join(f"{x!r}::DOUBLE AS p{k}" for k, x in enumerate(m.initial))
    sums = ", ".join("(" + " + ".join(f"p{j} * {m.transition[j][k]!r}::DOUBLE" for j in n) + f") AS a{k}" for k in n)
    total = " + ".join(f"a{k}" for k in n)
    predicted = ", ".join(f"greatest(1e-12, a{k} / ({total})) AS q{k}" for k in n)
    emission = lambda k: "CASE observation " + " ".join(f"WHEN '{o}' THEN {m.emission[k][i]!r}::DOUBLE" for i, o in enumerate(m.observations)) + " END"
    weighed = ", ".join(f"q{k} * ({emission(k)}) AS w{k}" for k in n)
    evidence = " + ".join(f"w{k}" for k in n)
    posterior = ", ".join(f"greatest(1e-12, w{k} / ({evidence})) AS p{k}" for k in n)
    carried = ", ".join(f"p{k}" for k in n)
    positive = [m.states.index(s) for s in m.positive]
    mass = lambda c: f"greatest(0.001, least(0.999, {' + '.join(f'{c}{k}' for k in positive)}))"
    seed = start or f"SELECT DISTINCT conv_id, 0::BIGINT AS k, {initial} FROM labelled"
    return f"""WITH RECURSIVE {LABELLED}, l AS (SELECT conv_id, turn_index, observation, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index) AS k FROM labelled {where}),
f AS (
  SELECT s.*, NULL::INTEGER AS turn_index, NULL::VARCHAR AS observation, NULL::DOUBLE AS prior FROM ({seed}) s
  UNION ALL
  SELECT conv_id, k, {posterior}, turn_index, observation, {mass('q')} AS prior FROM (
    SELECT *, {weighed} FROM (SELECT conv_id, k, turn_index, observation, {predicted} FROM (
      SELECT l.conv_id, l.k, l.turn_index, l.observation, {sums} FROM f JOIN l ON l.conv_id = f.conv_id AND l.k = f.k + 1)))
), scored AS (SELECT conv_id, turn_index, observation, prior, {mass('p')} AS posterior, {carried},
  CASE greatest({carried}) {' '.join(f"WHEN p{k} THEN '{s}'" for k, s in enumerate(m.states))} END AS most_likely_state FROM f WHERE turn_index IS NOT NULL)"""


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn_index", "observation", F.round("prior", 8).alias("prior"), F.round("posterior", 8).alias("posterior"), F.round("delta", 8).alias("delta"), *(F.round(F.col("state_posteriors")[k], 8).alias(f"p_{s}") for k, s in enumerate(MODEL.states)), "most_likely_state")


SHOWN = "conv_id, turn_index, observation, round(prior, 8) AS prior, round(posterior, 8) AS posterior, round(posterior - prior, 8) AS delta, " + ", ".join(f"round(p{k}, 8) AS p_{s}" for k, s in enumerate(MODEL.states)) + ", most_likely_state"


@query(filter_sql() + f" SELECT {SHOWN} FROM scored")
def hmm_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.forward_filter(labelled(spark, sf_dir), MODEL))


@query(filter_sql() + f" SELECT {SHOWN} FROM scored WHERE turn_index >= 3")
def hmm_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turns are scored and stored; the rest go on from the last stored distribution."""
    rows = labelled(spark, sf_dir)
    stored = S.forward_filter(rows.where("turn_index < 3"), MODEL).groupBy("conv_id").agg(F.max_by("state_posteriors", "turn_index").alias("start"))
    return rounded(S.forward_filter(rows.where("turn_index >= 3").join(stored, "conv_id", "left"), MODEL, start="start"))


@query((filter_sql() + f" SELECT {SHOWN}, is_fallback FROM scored JOIN (SELECT conv_id, turn_index, (conv_id + turn_index) % 7 = 0 AS is_fallback FROM labelled) USING (conv_id, turn_index)").replace("SELECT conv_id, turn_index, text, CASE", "SELECT conv_id, turn_index, text, CASE WHEN (conv_id + turn_index) % 7 = 0 THEN 'generic' ELSE CASE").replace("'elaborate' END AS observation", "'elaborate' END END AS observation"))
def hmm_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn without a usable label takes the negative fallback and says so."""
    failed = (F.col("conv_id") + F.col("turn_index")) % 7 == 0
    rows = labelled(spark, sf_dir).withColumn("is_fallback", failed)
    label = F.coalesce(F.when(~failed, F.col("observation")), F.lit(S.negative_fallback(MODEL)))
    scored = rounded(S.forward_filter(rows.withColumn("observation", label), MODEL))
    return scored.join(rows.select("conv_id", "turn_index", "is_fallback"), ["conv_id", "turn_index"])


def binary_sql() -> str:
    c = lambda xs: "CASE observation " + " ".join(f"WHEN '{o}' THEN {x!r}::DOUBLE" for o, x in zip(BINARY.observations, xs, strict=True)) + " END"
    return f"""WITH RECURSIVE {LABELLED}, l AS (SELECT conv_id, turn_index, observation, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index) AS k FROM labelled),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, NULL::INTEGER AS turn_index, NULL::VARCHAR AS observation, NULL::DOUBLE AS prior, {BINARY.prior!r}::DOUBLE AS p FROM labelled
  UNION ALL SELECT conv_id, k, turn_index, observation, p AS prior, greatest(0.001, least(0.999, a * b / (a * b + c * (1 - b)))) AS p FROM (
    SELECT l.conv_id, l.k, l.turn_index, l.observation, f.p, greatest(0.001, least(0.999, f.p)) AS b, {c(BINARY.positive).replace('observation', 'l.observation')} AS a, {c(BINARY.negative).replace('observation', 'l.observation')} AS c
    FROM f JOIN l ON l.conv_id = f.conv_id AND l.k = f.k + 1))
SELECT conv_id, turn_index, observation, round(prior, 8) AS prior, round(p, 8) AS posterior, round(p - prior, 8) AS delta FROM f WHERE turn_index IS NOT NULL"""


@query(binary_sql())
def binary_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.binary_filter(labelled(spark, sf_dir), BINARY)
    return rows.select("conv_id", "turn_index", "observation", *(F.round(c, 8).alias(c) for c in ("prior", "posterior", "delta")))


SCORE_SQL = "posterior + CASE WHEN most_likely_state IN ('deepening', 'closing') THEN 0.2 ELSE 0 END + CASE WHEN observation = 'followup' THEN 0.25 ELSE 0 END + least(0.1, greatest(0, (length(text) % 10) / 5.0) * 0.05)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    out = S.forward_filter(rows, MODEL).join(rows.select("conv_id", "turn_index", "text"), ["conv_id", "turn_index"])
    value = S.selection_score(F.col("most_likely_state"), F.col("observation"), F.col("posterior"), (F.length("text") % 10) / 5.0, PREFER_STATES, PREFER_OBSERVATIONS)
    return out.withColumn("selection_score", value)


SCORED_SQL = filter_sql() + f", s AS (SELECT scored.*, text, {SCORE_SQL} AS score FROM scored JOIN (SELECT conv_id, turn_index, text FROM labelled) USING (conv_id, turn_index))"


@query(SCORED_SQL + " SELECT conv_id, turn_index, round(score, 8) AS selection_score FROM s")
def selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("conv_id", "turn_index", F.round("selection_score", 8).alias("selection_score"))


def selected(rows: DataFrame, min_posterior: float, per_dialogue: int, limit: int) -> DataFrame:
    """High posteriors, the best few of each conversation, then the best of all."""
    own = Window.partitionBy("conv_id").orderBy(F.desc(F.round("selection_score", 8)), "turn_index")
    capped = rows.where(F.col("posterior") >= min_posterior).withColumn("own_rank", F.row_number().over(own)).where(F.col("own_rank") <= per_dialogue)
    return capped.orderBy(F.desc(F.round("selection_score", 8)), "conv_id", "turn_index").limit(limit)


@query(SCORED_SQL + """, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 8) DESC, turn_index) AS own_rank FROM s WHERE posterior >= 0.5 AND turn_index >= 1)
SELECT conv_id, turn_index, observation, most_likely_state, round(posterior, 8) AS posterior, round(score, 8) AS selection_score FROM c WHERE own_rank <= 2 ORDER BY round(score, 8) DESC, conv_id, turn_index LIMIT 100""")
def select_high_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selected(scored(spark, sf_dir).where("turn_index >= 1"), 0.5, 2, 100)
    return rows.select("conv_id", "turn_index", "observation", "most_likely_state", F.round("posterior", 8).alias("posterior"), F.round("selection_score", 8).alias("selection_score"))


@query(SCORED_SQL + """ SELECT conv_id, turn_index, own_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 8) DESC, turn_index) AS INTEGER) AS own_rank FROM s) WHERE own_rank <= 2""")
def per_dialogue_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy(F.desc(F.round("selection_score", 8)), "turn_index")
    return scored(spark, sf_dir).withColumn("own_rank", F.row_number().over(own)).where("own_rank <= 2").select("conv_id", "turn_index", "own_rank")


@query(SCORED_SQL + """ SELECT observation, most_likely_state, count(*) AS n, round(avg(posterior), 6) AS mean_posterior, count(*) FILTER (posterior >= 0.5) AS n_high FROM s GROUP BY ALL""")
def pool_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("observation", "most_likely_state").agg(F.count("*").alias("n"), F.round(F.avg("posterior"), 6).alias("mean_posterior"), F.count_if(F.col("posterior") >= 0.5).alias("n_high"))


EMISSIONS_SQL = "e(state, observation, p, is_positive, is_negative) AS (VALUES " + ", ".join(f"('{s}', '{o}', {p!r}::DOUBLE, {a}, {b})" for s, o, p, a, b in S.emission_table(MODEL)) + ")"


def emissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.emission_table(MODEL), "state string, observation string, p double, is_positive boolean, is_negative boolean")


@query(f"""WITH {EMISSIONS_SQL}, m AS (SELECT observation, avg(p) FILTER (is_positive) - avg(p) FILTER (is_negative) AS margin FROM e GROUP BY 1)
SELECT observation, round(margin, 8) AS margin, CASE WHEN margin > 0 THEN 'preferred' WHEN margin < 0 THEN 'excluded' ELSE 'neutral' END AS classification FROM m""")
def selection_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.selection_labels(emissions(spark)).withColumn("margin", F.round("margin", 8))


@query(f"""WITH {EMISSIONS_SQL} SELECT observation, round(max(p) FILTER (is_positive), 8) AS best_positive, round(max(p) FILTER (is_negative), 8) AS best_negative,
abs(max(p) FILTER (is_positive) - max(p) FILTER (is_negative)) >= 0.1 AS separates FROM e GROUP BY 1""")
def emission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, neg = F.max(F.when(F.col("is_positive"), F.col("p"))), F.max(F.when(F.col("is_negative"), F.col("p")))
    return emissions(spark).groupBy("observation").agg(F.round(pos, 8).alias("best_positive"), F.round(neg, 8).alias("best_negative"), (F.abs(pos - neg) >= 0.1).alias("separates"))


@query(f"""WITH {EMISSIONS_SQL} SELECT 'generic' AS observation, round(sum(p) FILTER (is_negative AND observation = 'generic'), 8) AS negative_mass FROM e""")
def negative_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = S.negative_fallback(MODEL)
    return emissions(spark).where(F.col("is_negative") & (F.col("observation") == label)).groupBy("observation").agg(F.round(F.sum("p"), 8).alias("negative_mass"))


@query(f"""WITH {LABELLED}, s AS (SELECT *, CASE WHEN length(text) % 5 < 2 THEN 'confused' WHEN length(text) % 5 < 4 THEN 'partial' ELSE 'solved' END AS state FROM labelled),
n AS (SELECT state, lead(state) OVER (PARTITION BY conv_id ORDER BY turn_index) AS next_state FROM s)
SELECT state, next_state, count(*) AS n FROM n WHERE next_state IS NOT NULL GROUP BY ALL""")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy("turn_index")
    return extracted(spark, sf_dir).withColumn("next_state", F.lead("state").over(own)).where("next_state is not null").groupBy("state", "next_state").agg(F.count("*").alias("n"))


STATES = ("confused", "partial", "solved")
EXTRACTED = LABELLED + """, x AS (SELECT conv_id, turn_index, observation AS strategy, CASE WHEN length(text) % 5 < 2 THEN 'confused' WHEN length(text) % 5 < 4 THEN 'partial' ELSE 'solved' END AS state,
 0.5 + (length(text) % 5) / 10.0 AS confidence FROM labelled)"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text") % 5
    state = F.when(n < 2, "confused").when(n < 4, "partial").otherwise("solved")
    return labelled(spark, sf_dir).select("conv_id", "turn_index", F.col("observation").alias("strategy"), state.alias("state"), (0.5 + n / 10.0).alias("confidence"))


def smoothed(rows: DataFrame, given: str, of: str, givens: list[str], values: list[str], alpha: float = 0.5) -> DataFrame:
    """Chances of one label given another, from sums of confidences, each value smoothed by alpha; both label sets are small and fixed."""
    spark = rows.sparkSession
    universe = spark.createDataFrame([(g, v) for g in givens for v in values], f"{given} string, {of} string")
    counts = rows.groupBy(given, of).agg(F.sum("confidence").alias("c"))
    full = universe.join(counts, [given, of], "left").na.fill(0.0, ["c"])
    total = F.sum("c").over(Window.partitionBy(given))
    return full.select(given, of, ((F.col("c") + alpha) / (total + alpha * len(values))).alias("p"))


SMOOTH_SQL = """t AS (SELECT s.state, o.strategy, coalesce(sum(confidence), 0) AS c FROM (VALUES ('confused'), ('partial'), ('solved')) s(state) CROSS JOIN (VALUES ('generic'), ('followup'), ('elaborate')) o(strategy)
 LEFT JOIN x ON x.state = s.state AND x.strategy = o.strategy GROUP BY 1, 2), p AS (SELECT state, strategy, (c + 0.5) / (sum(c) OVER (PARTITION BY state) + 1.5) AS p FROM t)"""


def strategy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(extracted(spark, sf_dir), "state", "strategy", list(STATES), list(MODEL.observations))


@query(f"WITH {EXTRACTED}, {SMOOTH_SQL} SELECT state, strategy, round(p, 8) AS p FROM p")
def smoothed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy_table(spark, sf_dir).withColumn("p", F.round("p", 8))


@query(f"WITH {EXTRACTED}, {SMOOTH_SQL} SELECT conv_id, turn_index, round(ln(p), 8) AS log_likelihood FROM x JOIN p USING (state, strategy)")
def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).join(strategy_table(spark, sf_dir), ["state", "strategy"]).select("conv_id", "turn_index", F.round(F.ln("p"), 8).alias("log_likelihood"))


@query(f"WITH {EXTRACTED}, {SMOOTH_SQL}, r AS (SELECT conv_id, turn_index, round(ln(p), 8) AS v FROM x JOIN p USING (state, strategy)) SELECT conv_id, turn_index, round(cume_dist() OVER (ORDER BY v), 8) AS percentile FROM r")
def calibrated_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the calibration values that are at most this one: counted by distinct value, of which there are few."""
    raw = component_scores(spark, sf_dir)
    values = raw.groupBy("log_likelihood").count()
    ordered = Window.orderBy("log_likelihood")
    table = values.withColumn("upto", F.sum("count").over(ordered)).withColumn("n", F.sum("count").over(Window.partitionBy()))
    return raw.join(table, "log_likelihood").select("conv_id", "turn_index", F.round(F.col("upto") / F.col("n"), 8).alias("percentile"))


@query(f"""WITH {LABELLED} SELECT observation, count(*) AS n, round(count(*) FILTER ((conv_id + turn_index) % 7 = 0) / count(*), 8) AS fallback_rate, count(DISTINCT conv_id) FILTER ((conv_id + turn_index) % 7 = 0) AS conversations_with_fallback FROM labelled GROUP BY 1""")
def fallback_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("conv_id") + F.col("turn_index")) % 7 == 0
    return labelled(spark, sf_dir).groupBy("observation").agg(F.count("*").alias("n"), F.round(F.count_if(bad) / F.count("*"), 8).alias("fallback_rate"), F.count_distinct(F.when(bad, F.col("conv_id"))).alias("conversations_with_fallback"))


@query(f"""WITH {LABELLED} SELECT count(*) AS n, round(count(*) FILTER (observation = 'generic') / count(*), 8) AS generic_rate, count(DISTINCT observation) AS labels, count(*) FILTER (observation = 'generic') / count(*) <= 0.5 AND count(DISTINCT observation) >= 3 AS passes FROM labelled""")
def pilot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    generic = F.count_if(F.col("observation") == "generic") / F.count("*")
    return labelled(spark, sf_dir).agg(F.count("*").alias("n"), F.round(generic, 8).alias("generic_rate"), F.count_distinct("observation").alias("labels"), ((generic <= 0.5) & (F.count_distinct("observation") >= 3)).alias("passes"))


@query(f"""WITH RECURSIVE {TURNS}, c AS (SELECT conv_id, count(*) AS size, row_number() OVER (ORDER BY conv_id) AS k FROM turns GROUP BY 1),
f AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, false AS taken UNION ALL SELECT c.k, f.used + CASE WHEN f.used < 200 AND (f.used = 0 OR f.used + c.size <= 200) THEN c.size ELSE 0 END, f.used < 200 AND (f.used = 0 OR f.used + c.size <= 200) FROM f JOIN c ON c.k = f.k + 1)
SELECT conv_id, size FROM c JOIN f USING (k) WHERE taken""")
def conversation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in order until 200 turns are reached; one that doesn't fit is skipped, later ones may."""
    sizes = turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("size"))
    return within_budget(sizes, 200)


def within_budget(sizes: DataFrame, most: int) -> DataFrame:
    """sizes: conv_id, size. At most `most` conversations of each size can be taken, so the fold sees no more than that many of each."""
    first = Window.partitionBy("size").orderBy("conv_id")
    kept = sizes.where(F.col("size") > 0).withColumn("nth", F.row_number().over(first)).where((F.col("nth") - 1) * F.col("size") <= most)
    xs = kept.agg(F.array_sort(F.collect_list(F.struct("conv_id", "size"))).alias("xs"))

    def step(acc, x):
        take = (acc["used"] < most) & ((acc["used"] == 0) | (acc["used"] + x["size"] <= most))
        return F.when(take, F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)

    folded = xs.select(F.aggregate("xs", F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<conv_id:bigint,size:bigint>>").alias("out")), step, lambda acc: acc["out"]).alias("out"))
    return folded.select(F.explode("out").alias("x")).select("x.conv_id", "x.size")
