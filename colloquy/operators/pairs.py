"""Preference pairs: pairing, acceptance, finalisation and arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def acceptance_rule(chosen: Column, rejected: Column, min_chosen: float = 0.70, max_rejected: float = 0.55, min_gap: float = 0.25, rescue_rejected: float | None = 0.65, rescue_gap: float | None = 0.30) -> Column:
    """strict, else gap_rescue, else null."""
    gap = chosen - rejected
    rule = F.when(chosen < min_chosen, None).when((rejected <= max_rejected) & (gap >= min_gap), "strict")
    if rescue_rejected is not None and rescue_gap is not None:
        rule = rule.when((rejected <= rescue_rejected) & (gap >= rescue_gap), "gap_rescue")
    return rule


def skip_reason(chosen: Column, rejected: Column, min_chosen: float = 0.70, max_rejected: float = 0.55) -> Column:
    """Why a pair that no rule accepts is left out: the first that holds."""
    return F.when(chosen < min_chosen, "low_chosen").when(rejected > max_rejected, "high_rejected").otherwise("small_gap")


def same_prompt_pairs(scored: DataFrame, order: list[str], min_chosen: float = 0.65, max_rejected: float = 0.35) -> DataFrame:
    """scored: prompt, response, posterior. The best and worst response of each prompt, the first by order winning ties, if they differ."""
    chosen, rejected = F.col("posterior") >= min_chosen, F.col("posterior") <= max_rejected
    rows = scored.groupBy("prompt").agg(
        F.max_by(F.when(chosen, F.struct("response", "posterior")), F.when(chosen, F.struct("posterior", *[(-F.col(c)).alias(c) for c in order]))).alias("c"),
        F.min_by(F.when(rejected, F.struct("response", "posterior")), F.when(rejected, F.struct("posterior", *order))).alias("r"),
    )
    pairs = rows.where("c is not null and r is not null and c.response <> r.response")
    return pairs.select("prompt", F.col("c.response").alias("chosen"), F.col("r.response").alias("rejected"), F.col("c.posterior").alias("score_chosen"), F.col("r.posterior").alias("score_rejected"))


def best_rejected(candidates: DataFrame, key: list[str]) -> DataFrame:
    """candidates: key, chosen, score_chosen, candidate_index, candidate, score_candidate. The one with the widest gap, the first winning ties; those equal to the chosen text don't count."""
    gap = F.col("score_chosen") - F.col("score_candidate")
    ok = candidates.where("candidate <> chosen").withColumn("gap", gap)
    return ok.groupBy(*key).agg(F.max_by(F.struct("candidate", "candidate_index", "gap"), F.struct("gap", (-F.col("candidate_index")).alias("i"))).alias("best")).select(*key, "best.candidate_index", F.col("best.candidate").alias("rejected"), "best.gap")


def best_of(rows: DataFrame, key: list[str], value: str, ordinal: list[str]) -> DataFrame:
    """One row of each key: the highest value, the first by ordinal winning ties."""
    own = Window.partitionBy(*key).orderBy(F.desc(value), *ordinal)
    return rows.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")


def arms(selected: DataFrame, baseline: DataFrame, gold: DataFrame, size: int, order: list) -> DataFrame:
    """Two training arms of equal size with the same gold pairs; gold prompts are kept out of either arm's own pairs."""
    def arm(name: str, rows: DataFrame) -> DataFrame:
        own = rows.join(gold.select("prompt"), "prompt", "left_anti").orderBy(*order).limit(size).withColumn("is_gold", F.lit(False))
        return own.unionByName(gold.withColumn("is_gold", F.lit(True))).withColumn("arm", F.lit(name))

    return arm("selected", selected).unionByName(arm("random", baseline))


def violations(rows: DataFrame, required: list[str]) -> DataFrame:
    """rows with violations: which required texts are absent or blank, and equal answers."""
    checks = [F.when(F.col(c).isNull() | (F.trim(c) == ""), F.lit(f"blank {c}")) for c in required]
    checks.append(F.when(F.col("chosen") == F.col("rejected"), F.lit("chosen equals rejected")))
    return rows.withColumn("violations", F.array_join(F.array_compact(F.array(*checks)), ","))


def dpo_loss(pairs: DataFrame, beta: float = 0.1) -> DataFrame:
    """Mean logistic loss of the log-probability margins."""
    margin = F.col("logp_chosen") - F.col("logp_rejected")
    return pairs.agg(F.count("*").alias("n"), F.avg(F.log1p(F.exp(-beta * margin))).alias("loss"), F.avg((margin > 0).cast("double")).alias("accuracy"))
