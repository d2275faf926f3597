"""Paired non-parametric statistics as aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rank: 1 for the smallest of a group, ties sharing their mean rank; ties: how many share it."""
    own = Window.partitionBy(*by).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return rows.withColumn("ties", ties).withColumn("rank", F.rank().over(own) + (F.col("ties") - 1) / 2)


def complete_cases(rows: DataFrame, block: list[str], models: int) -> DataFrame:
    """Rows of the blocks that have each model once and a value for it."""
    own = Window.partitionBy(*block)
    # the models of a block are few; a block without a key is none
    full = (F.count("value").over(own) == models) & (F.size(F.collect_set("model_name").over(own)) == models)
    marked = rows.withColumn("_full", full & F.expr(" and ".join(f"`{c}` is not null" for c in block)))
    return marked.where("_full").drop("_full")


def friedman(rows: DataFrame, group: str, block: str, models: int) -> DataFrame:
    """group, n, chi2, kendall_w, p: for three models the chi-square tail with two degrees of freedom, for four that with three, in closed form."""
    if models not in (3, 4):
        raise ValueError("three or four models")
    ranked = average_ranks(complete_cases(rows, [group, block], models), [group, block], "value")
    # each member of a tie of t adds t^2 - 1, so the tie adds t^3 - t
    sums = ranked.groupBy(group, "model_name").agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    k = models
    total = sums.groupBy(group).agg(F.sum(F.col("r") * F.col("r")).alias("s"), F.max("n").alias("n"), F.sum("t").alias("t"))
    raw = 12.0 * F.col("s") / (F.col("n") * k * (k + 1)) - 3.0 * F.col("n") * (k + 1)
    correction = 1.0 - F.col("t") / (F.col("n") * (k**3 - k))
    rest = raw if k == 3 else F.lit(0.0)
    out = total.withColumn("chi2", F.when(correction > 0, raw / correction).otherwise(rest))
    x = F.greatest(F.col("chi2"), F.lit(0.0))
    p = F.exp(-x / 2) if k == 3 else chi3_tail(x)
    return out.select(group, "n", "chi2", (F.col("chi2") / (F.col("n") * (k - 1))).alias("kendall_w"), p.alias("p"))


def chi3_tail(x: Column) -> Column:
    """erfc(sqrt(x / 2)) + sqrt(2 x / pi) exp(-x / 2), the complementary error function to about 1e-7 by a rational approximation."""
    z = F.sqrt(x / 2)
    t = 1.0 / (1.0 + 0.5 * z)
    # fixed values: coefficients of the Chebyshev fit of erfc
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    series = F.lit(0.0)
    for c in reversed(terms):
        series = series * t + c
    return t * F.exp(-z * z + series) + F.sqrt(2 * x / F.lit(3.141592653589793)) * F.exp(-x / 2)


def holm(rows: DataFrame, p: str, family: list[str] = ()) -> DataFrame:
    """adjusted: p times the number of hypotheses from it on, never below an earlier one, 1 at most."""
    whole = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    order = whole.orderBy(p)
    stepped = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(whole) - F.row_number().over(order) + 1))
    return rows.withColumn("stepped", stepped).withColumn("adjusted", F.max("stepped").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("stepped")


def paired_differences(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    pivoted = rows.groupBy(*keys).agg(F.max(F.when(F.col("model_name") == left, F.col("value"))).alias("a"), F.max(F.when(F.col("model_name") == right, F.col("value"))).alias("b"))
    return pivoted.where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))


def effect_sizes(differences: DataFrame, group: str, threshold: float = 0.0) -> DataFrame:
    """n, dz, rank_biserial (ties of |d| share their mean rank, zeros left out), wins, ties, losses: a gap equal to a positive threshold is a win."""
    magnitude = differences.where("d <> 0").withColumn("m", F.abs("d"))
    # ranks by distinct value: counts of |d| are few, so no group is sorted whole
    sizes = magnitude.groupBy(group, "m").agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    own = Window.partitionBy(group).orderBy("m")
    ranked = sizes.withColumn("r", F.sum("c").over(own) - (F.col("c") - 1) / 2)
    biserial = ranked.groupBy(group).agg(((F.sum(F.col("r") * F.col("up")) - F.sum(F.col("r") * (F.col("c") - F.col("up")))) / F.sum(F.col("r") * F.col("c"))).alias("rank_biserial"))
    up = (F.col("d") >= threshold) if threshold > 0 else (F.col("d") > 0)
    down = (F.col("d") <= -threshold) if threshold > 0 else (F.col("d") < 0)
    base = differences.groupBy(group).agg(F.count("*").alias("n"), (F.avg("d") / F.stddev_samp("d")).alias("dz"), F.count_if(up).alias("wins"), F.count_if(~up & ~down).alias("ties"), F.count_if(down).alias("losses"))
    return base.join(biserial, group, "left")


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, taken eight places further on, where it is exact to the last digits."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.ln(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return series - sum((F.ln(n.cast("double") + k) for k in range(2, 9)), F.ln(n.cast("double") + 1))


def sign_test(differences: DataFrame, group: str) -> DataFrame:
    """Exact two-sided p of the signs: the smaller tail of a fair binomial, doubled.

    Terms are summed from the largest down; beyond some twelve standard deviations they add nothing, so their number grows
    with the root of that of the signs.
    """
    counts = differences.groupBy(group).agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"))
    n, low = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    first = log_factorial(n) - log_factorial(low) - log_factorial(n - low) - n * F.lit(0.6931471805599453)
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def step(acc: Column, i: Column) -> Column:  # C(n, i - 1) = C(n, i) * i / (n - i + 1)
        log = acc["log"] + F.ln(i / (n - i + 1))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    last = F.greatest(F.lit(1).cast("long"), low - F.ceil(12 * F.sqrt(n.cast("double"))) - 50)
    terms = F.when(low >= 1, F.sequence(low, last, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, start, step, lambda acc: acc["sum"])
    return counts.select(group, "wins", "losses", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p"))


def permutation_p(differences: DataFrame, group: str, key: str, draws: int, seed: str = "perm") -> DataFrame:
    """(hits + 1) / (draws + 1) of the sign-flip test; the sign of a difference in a draw is a hash of seed, draw and key."""
    observed = differences.groupBy(group).agg(F.abs(F.avg("d")).alias("observed"))
    flips = differences.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    sign = F.when(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"), F.col(key).cast("string"))), 1, 1) < "8", 1.0).otherwise(-1.0)
    means = flips.groupBy(group, "draw").agg(F.abs(F.avg(F.col("d") * sign)).alias("m"))
    return means.join(observed, group).groupBy(group).agg(((F.count_if(F.col("m") >= F.col("observed") - 1e-12) + 1) / F.lit(draws + 1)).alias("p"))


def bootstrap_means(rows: DataFrame, group: str, key: str, draws: int, seed: str = "boot") -> DataFrame:
    """group, draw, mean: each row weighs as often as a Poisson draw of mean 1 says, a hash of seed, draw and key, so that no row is looked up by place."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    # fixed values: the distribution function of a Poisson variable of mean 1
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    weight = sum(((u >= F.lit(c)).cast("double") for c in cuts[1:]), (u >= F.lit(cuts[0])).cast("double"))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    return drawn.groupBy(group, "draw").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"))


def interval(means: DataFrame, group: str, draws: int, method: str = "lower_index") -> DataFrame:
    """low, high of 95 %: lower_index takes int(q (n - 1)), count_index int(q n), linear interpolates."""
    if method == "linear":
        return means.groupBy(group).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    at = (lambda q: int(q * (draws - 1))) if method == "lower_index" else (lambda q: min(draws - 1, int(q * draws)))
    ranked = means.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy("mean")) - 1)
    return ranked.groupBy(group).agg(F.max(F.when(F.col("k") == at(0.025), F.col("mean"))).alias("low"), F.max(F.when(F.col("k") == at(0.975), F.col("mean"))).alias("high"))
