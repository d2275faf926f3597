"""Probabilistic scores of assistant turns: a forward filter over hidden states, and its two-state form."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12
LOW, HIGH = 0.001, 0.999


@dataclass(frozen=True)
class TransitionModel:
    """states in order; initial, transition and emission chances by position; positive: the wanted states."""

    states: tuple[str, ...]
    observations: tuple[str, ...]
    positive: tuple[str, ...]
    negative: tuple[str, ...]
    initial: tuple[float, ...]
    transition: tuple[tuple[float, ...], ...]
    emission: tuple[tuple[float, ...], ...]
    descriptions: dict = field(default_factory=dict)

    def problems(self) -> list[str]:
        """All that is wrong with the model, none if it can be used."""
        found = []
        if set(self.positive) & set(self.negative):
            found.append("a state is both positive and negative")
        if not self.positive or not self.negative or not set(self.positive) | set(self.negative) <= set(self.states):
            found.append("positive and negative states must be known and not empty")
        for name, rows, width in (("initial", (self.initial,), len(self.states)), ("transition", self.transition, len(self.states)), ("emission", self.emission, len(self.observations))):
            if name != "initial" and len(rows) != len(self.states):
                found.append(f"{name}: a state has no row")
            for k, row in enumerate(rows):
                if len(row) != width:
                    found.append(f"{name} {k}: {len(row)} entries, {width} wanted")
                elif any(not 0 < x < 1 for x in row):
                    found.append(f"{name} {k}: chances must lie between 0 and 1")
                elif abs(sum(row) - 1) > 0.05:
                    found.append(f"{name} {k}: sums to {sum(row):.3f}")
        return found

    def normalised(self) -> TransitionModel:
        if self.problems():
            raise ValueError("; ".join(self.problems()))
        even = lambda row: tuple(x / sum(row) for x in row)
        return TransitionModel(self.states, self.observations, self.positive, self.negative, even(self.initial), tuple(map(even, self.transition)), tuple(map(even, self.emission)), self.descriptions)


@dataclass(frozen=True)
class BinaryModel:
    observations: tuple[str, ...]
    prior: float
    positive: tuple[float, ...]
    negative: tuple[float, ...]


def _array(values: tuple) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _mass(p: Column, keep: list[int]) -> Column:
    """Chance of some states, kept away from 0 and 1; what is carried on isn't."""
    total = F.lit(0.0)
    for k in keep:
        total = total + p[k]
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), total))


def _normalised(p: Column, n: int, otherwise: Column) -> Column:
    total = p[0]
    for k in range(1, n):
        total = total + p[k]
    return F.when(total <= EPSILON, otherwise).otherwise(F.transform(p, lambda x: F.greatest(F.lit(EPSILON), x / total)))


def forward_filter(labelled: DataFrame, model: TransitionModel, start: str | None = None) -> DataFrame:
    """labelled: conv_id, turn_index, observation (and start, an array column of state chances to go on from, if named).

    Returns a row per turn with prior, posterior, delta, state_posteriors and most_likely_state. The first turn passes through the
    transition too. Conversations are folded in parallel; a conversation's turns are one array.
    """
    m = model.normalised()
    n = len(m.states)
    keep = [m.states.index(s) for s in m.positive]
    initial = _array(m.initial)
    columns = [_array(tuple(row[k] for row in m.transition)) for k in range(n)]
    emission = F.create_map(*(x for k, o in enumerate(m.observations) for x in (F.lit(o), _array(tuple(row[k] for row in m.emission)))))

    def predict(p: Column) -> Column:
        def into(k: int) -> Column:
            total = F.lit(0.0)
            for j in range(n):
                total = total + p[j] * columns[k][j]
            return total

        return _normalised(F.array(*(into(k) for k in range(n))), n, initial)

    def step(acc: Column, turn: Column) -> Column:
        predicted = predict(acc["p"])
        # a struct in between, so that the prediction is worked out once
        return F.element_at(
            F.transform(
                F.array(F.struct(predicted.alias("q"), F.element_at(emission, turn["observation"]).alias("e"))),
                lambda x: F.element_at(
                    F.transform(
                        F.array(_normalised(F.array(*(x["q"][k] * x["e"][k] for k in range(n))), n, x["q"])),
                        lambda p: F.struct(p.alias("p"), F.concat(acc["out"], F.array(F.struct(turn["turn_index"].alias("turn_index"), turn["observation"].alias("observation"), _mass(x["q"], keep).alias("prior"), _mass(p, keep).alias("posterior"), p.alias("p")))).alias("out")),
                    ),
                    1,
                ),
            ),
            1,
        )

    empty = F.array().cast("array<struct<turn_index:int,observation:string,prior:double,posterior:double,p:array<double>>>")
    folded = labelled.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn_index").cast("int").alias("turn_index"), "observation"))).alias("xs"), *([F.first(start, ignorenulls=True).alias("start")] if start else []))
    begin = F.coalesce("start", initial) if start else initial
    out = folded.select("conv_id", F.explode(F.aggregate("xs", F.struct(begin.alias("p"), empty.alias("out")), step, lambda acc: acc["out"])).alias("t"))
    names = F.array(*map(F.lit, m.states))
    likely = F.element_at(names, F.array_position("t.p", F.array_max("t.p")).cast("int"))
    return out.select("conv_id", "t.turn_index", "t.observation", "t.prior", "t.posterior", (F.col("t.posterior") - F.col("t.prior")).alias("delta"), F.col("t.p").alias("state_posteriors"), likely.alias("most_likely_state"))


def binary_filter(labelled: DataFrame, model: BinaryModel) -> DataFrame:
    """The two-state form: the posterior of a turn, kept between bounds, is the prior of the next."""
    chance = F.create_map(*(x for o, a, b in zip(model.observations, model.positive, model.negative, strict=True) for x in (F.lit(o), _array((a, b)))))

    def step(acc: Column, turn: Column) -> Column:
        prior = acc["p"]
        bounded = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), prior))
        c = F.element_at(chance, turn["observation"])
        evidence = c[0] * bounded + c[1] * (1.0 - bounded)
        posterior = F.when(evidence <= EPSILON, bounded).otherwise(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), c[0] * bounded / evidence)))
        return F.struct(posterior.alias("p"), F.concat(acc["out"], F.array(F.struct(turn["turn_index"].alias("turn_index"), turn["observation"].alias("observation"), prior.alias("prior"), posterior.alias("posterior")))).alias("out"))

    empty = F.array().cast("array<struct<turn_index:int,observation:string,prior:double,posterior:double>>")
    folded = labelled.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn_index").cast("int").alias("turn_index"), "observation"))).alias("xs"))
    out = folded.select("conv_id", F.explode(F.aggregate("xs", F.struct(F.lit(model.prior).alias("p"), empty.alias("out")), step, lambda acc: acc["out"])).alias("t"))
    return out.select("conv_id", "t.*", (F.col("t.posterior") - F.col("t.prior")).alias("delta"))


def emission_table(model: TransitionModel) -> list[tuple]:
    """(state, observation, chance, is_positive, is_negative) of each pair: a small frame's rows."""
    return [(s, o, float(model.emission[i][j]), s in model.positive, s in model.negative) for i, s in enumerate(model.states) for j, o in enumerate(model.observations)]


def selection_labels(emissions: DataFrame, method: str = "mean_difference", margin: float = 0.0, most: int = 4) -> DataFrame:
    """observation, margin, classification. mean_difference keeps at most four labels of either kind; state_specific_margin compares maxima and keeps all."""
    pos, neg = F.when(F.col("is_positive"), F.col("p")), F.when(F.col("is_negative"), F.col("p"))
    if method == "mean_difference":
        rows = emissions.groupBy("observation").agg((F.avg(pos) - F.avg(neg)).alias("margin"))
        from pyspark.sql import Window

        best = F.row_number().over(Window.orderBy(F.desc("margin"), "observation"))
        worst = F.row_number().over(Window.orderBy("margin", "observation"))
        kind = F.when((F.col("margin") > 0) & (F.col("best") <= most), "preferred").when((F.col("margin") < 0) & (F.col("worst") <= most), "excluded").otherwise("neutral")
        return rows.withColumn("best", best).withColumn("worst", worst).select("observation", "margin", kind.alias("classification"))
    if method != "state_specific_margin":
        raise ValueError(f"unknown method {method}")
    rows = emissions.groupBy("observation").agg((F.max(pos) - F.max(neg)).alias("margin"))
    return rows.select("observation", "margin", F.when(F.col("margin") >= margin, "preferred").when(F.col("margin") <= -margin, "excluded").otherwise("neutral").alias("classification"))


def selection_score(state: Column, observation: Column, posterior: Column, observation_score: Column, prefer_states: list[str], prefer_observations: list[str], low_states: list[str] = ()) -> Column:
    score = posterior + F.when(state.isin(*prefer_states), 0.20).otherwise(0.0) + F.when(observation.isin(*prefer_observations), 0.25).otherwise(0.0)
    if low_states:
        score = score - F.when(state.isin(*low_states), 0.20).otherwise(0.0)
    return score + F.coalesce(F.least(F.lit(0.10), F.greatest(F.lit(0.0), observation_score) * 0.05), F.lit(0.0))


def negative_fallback(model: TransitionModel, known: tuple[str, ...] = ("generic_or_unrelated", "off_style", "generic", "blocking")) -> str:
    """The observation taken where none could be judged: a known one that the model has, else that which the negative states emit most."""
    for label in known:
        if label in model.observations:
            return label
    sums = {o: sum(model.emission[model.states.index(s)][j] for s in model.negative) for j, o in enumerate(model.observations)}
    return max(sums, key=lambda o: sums[o])
