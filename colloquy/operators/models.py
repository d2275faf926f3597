"""Checks of many models at once, each given as rows of its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States and observations that a usable model has, at least and at most.
STATES, OBSERVATIONS = (4, 7), (6, 10)


def model_problems(tables: DataFrame, roles: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """tables: model, kind (initial, transition, emission), state (of initial: any), target, p; roles: model, state, role (positive, negative). Returns model, problem: a row for each thing that is wrong.

    The states of a model are those of its initial table. A row of a table has to sum to 1, each state needs its row in the
    other tables, chances lie between 0 and 1, targets of transitions and states with roles are states, no state has both
    roles and both occur. Repeated problems stand once; models without problems have no row.
    """
    named = lambda rows, text: rows.select("model", (F.lit(text) if isinstance(text, str) else text).alias("problem"))
    at = F.when(F.col("kind") == "initial", F.lit("")).otherwise(F.concat(F.lit(" of "), F.coalesce("state", F.lit("?"))))
    states = tables.where("kind = 'initial'").select("model", F.col("target").alias("state")).distinct()
    found = [
        named(tables.where("p is null or p < 0 or p > 1 or isnan(p)"), F.concat("kind", at, F.lit(": a chance outside 0 to 1"))),
        named(tables.groupBy("model", "kind", at.alias("at")).agg(F.sum("p").alias("p")).where(F.abs(F.col("p") - 1) > tolerance), F.concat("kind", "at", F.lit(": chances don't sum to 1"))),
        named(tables.where("kind = 'transition'").join(states.withColumnRenamed("state", "target"), ["model", "target"], "left_anti"), F.concat(F.lit("transition to an unknown state "), F.coalesce("target", F.lit("?")))),
        named(roles.join(states, ["model", "state"], "left_anti"), F.concat(F.lit("a role for an unknown state "), F.coalesce("state", F.lit("?")))),
        named(roles.groupBy("model", "state").agg(F.count_distinct("role").alias("n")).where("n > 1"), F.concat(F.lit("both roles for "), "state")),
    ]
    for kind in ("transition", "emission"):
        found.append(named(states.join(tables.where(F.col("kind") == kind), ["model", "state"], "left_anti"), F.concat(F.lit(f"{kind}: no row for "), "state")))
    for role in ("positive", "negative"):
        found.append(named(states.select("model").distinct().join(roles.where(F.col("role") == role), "model", "left_anti"), f"no {role} state"))
    return reduce(DataFrame.unionByName, found).distinct()


def coverage_gate(tables: DataFrame, roles: DataFrame, descriptions: DataFrame, functions: dict[str, tuple[str, ...]]) -> DataFrame:
    """descriptions: model, observation, text. Returns for each model: states, observations, covered (all states have a role), missing (functions of which no observation speaks, in order), passed.

    An observation speaks of a function if its name or text holds one of the function's words, whatever their case.
    """
    sizes = tables.groupBy("model").agg(
        F.count_distinct(F.when(F.col("kind") == "initial", F.col("target"))).alias("states"), F.count_distinct(F.when(F.col("kind") == "emission", F.col("target"))).alias("observations")
    )
    states = tables.where("kind = 'initial'").select("model", F.col("target").alias("state")).distinct()
    bare = states.join(roles, ["model", "state"], "left_anti").groupBy("model").agg(F.count("*").alias("bare"))
    said = F.lower(F.concat_ws(" ", "observation", F.coalesce("text", F.lit(""))))
    speaks = lambda words: reduce(lambda a, b: a | b, (said.contains(w.lower()) for w in words), F.lit(False))
    spoken = descriptions.groupBy("model").agg(*(F.bool_or(speaks(words)).alias(f"function {k}") for k, words in enumerate(functions.values())))
    lacks: list[Column] = [F.when(~F.coalesce(f"function {k}", F.lit(False)), F.lit(name)) for k, name in enumerate(functions)]
    rows = sizes.join(bare, "model", "left").join(spoken, "model", "left")
    rows = rows.select("model", "states", "observations", (F.coalesce("bare", F.lit(0)) == 0).alias("covered"), F.array_compact(F.array(*lacks)).alias("missing"))
    fits = F.col("states").between(*STATES) & F.col("observations").between(*OBSERVATIONS) & F.col("covered") & (F.size("missing") == 0)
    return rows.withColumn("passed", fits)
