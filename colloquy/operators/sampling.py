"""Samples under shared limits: strata with quotas and a cap on groups, and labels that take turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.dedup import reliable


def drawn(seed: int, key: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def within_cap(rows: DataFrame, used: DataFrame | None, cap: int) -> DataFrame:
    """rows: group, order. Those that come first in their group, as many as used (group, n) leaves of the cap."""
    place = F.row_number().over(Window.partitionBy("group").orderBy("order"))
    if used is None:
        return rows.withColumn("place", place).where(F.col("place") <= cap).drop("place")
    # groups are few names, null among them: compared null-safe
    left = rows.withColumn("place", place).alias("r").join(used.alias("u"), F.col("r.group").eqNullSafe(F.col("u.group")), "left")
    return left.where(F.col("place") <= cap - F.coalesce("n", F.lit(0))).select("r.*").drop("place")


def stratified_sample(samples: DataFrame, strata: list[str], count: int, cap: int, seed: int, reserve: int = 0) -> DataFrame:
    """samples: sample_id (unique), group, stratum. Returns sample_id, group, stratum, role (primary, reserve), position (primary: from 1) and order.

    Strata come in the order of strata with equal quotas, the first ones one more; in each the samples in a drawn order, no
    group more than cap times in all strata together. What quotas leave open is filled from all samples of these strata and
    others in a second order, under the same cap; the reserve (its size, or -1 for all) in a third. A group's places go to
    its first samples in an order, so a stratum is one window and one limit; only the chosen are carried on. Raises
    ValueError where the samples don't suffice.
    """
    rows = reliable(samples.select("sample_id", "group", "stratum"))
    quota = {s: count // len(strata) + (k < count % len(strata)) for k, s in enumerate(strata)}
    chosen: DataFrame | None = None

    def taken(pool: DataFrame, by: int, most: int | None) -> DataFrame:
        used = chosen.groupBy("group").agg(F.count("*").alias("n")) if chosen is not None else None
        found = within_cap(pool.withColumn("order", drawn(by, "sample_id")), used, cap)
        return reliable(found if most is None else found.orderBy("order").limit(most))

    for stratum in strata:
        if quota[stratum]:
            more = taken(rows.where(F.col("stratum") == stratum), seed, quota[stratum])
            chosen = more if chosen is None else chosen.unionByName(more)
    n = chosen.count() if chosen is not None else 0
    rest = lambda: rows.join(chosen.select("sample_id"), "sample_id", "left_anti") if chosen is not None else rows
    if n < count:
        more = taken(rest(), seed + 1, count - n)
        chosen = more if chosen is None else chosen.unionByName(more)
        n = chosen.count()
    if n != count:
        raise ValueError(f"{n} of {count} samples found")
    if chosen is None:
        return rows.limit(0).select("*", F.lit("").alias("role"), F.lit(0).alias("position"), F.lit("").alias("order"))
    primary = chosen.withColumn("order", drawn(seed + 2, "sample_id"))
    primary = primary.withColumn("position", F.row_number().over(Window.orderBy("order")))  # count rows
    out = primary.select("sample_id", "group", "stratum", F.lit("primary").alias("role"), "position", "order")
    if not reserve:
        return out
    more = taken(rest(), seed + 3, None if reserve < 0 else reserve)
    return out.unionByName(more.select("sample_id", "group", "stratum", F.lit("reserve").alias("role"), F.lit(None).cast("int").alias("position"), "order"))


def coverage_sample(labels: DataFrame, count: int, seed: int) -> DataFrame:
    """labels: item, label, first (whether labels of its kind come before others). Returns item, label, turn, place: count items that cover the labels.

    Labels take turns, those of the first kind before others, then rare before common ones; each takes the next item of its
    own drawn order that none has taken. Who takes an item is found for all at once: each label is asked at which turn it would
    come to each of its items if others took what they now seem to, the earliest gets it, and so on until nothing changes up to
    the moment (turn and label) of the last item wanted. If two rounds agree up to a moment, so does what taking turns gives:
    a label's items before that moment are then its own in both, and what it passed over was taken earlier. Later moments
    are not waited for. Of a label's list the first count items suffice.
    """
    labels = labels.where("label is not null").groupBy("item", "label").agg(F.max("first").alias("first"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    slots = sizes.select("label", F.row_number().over(Window.orderBy(F.desc("first"), "n", "label")).alias("slot"))  # a row a label
    listed = Window.partitionBy("label").orderBy(drawn(seed, "item"), "item")
    lists = labels.withColumn("at", F.row_number().over(listed)).where(F.col("at") <= count).join(slots, "label")
    lists = reliable(lists.select("item", "label", "first", "slot", "at"))  # with first, so that sizes and lists read the same shuffle
    owner = reliable(lists.groupBy("item").agg(F.min(F.struct("at", "slot")).alias("best")))
    before = Window.partitionBy("slot").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        known = lists.select("item", "slot", "at").join(owner.select("item", F.col("best").alias("was")), "item")
        turn = 1 + F.coalesce(F.sum((F.col("was.slot") == F.col("slot")).cast("int")).over(before), F.lit(0))
        asked = known.select("item", "was", F.struct(turn.cast("int").alias("at"), "slot").alias("offer"))
        owner = reliable(asked.groupBy("item").agg(F.min("offer").alias("best"), F.first("was").alias("was")))
        last = owner.orderBy("best").limit(count).agg(F.max("best").alias("last"))
        if owner.where("best <> was").crossJoin(F.broadcast(last)).where("least(best, was) <= last").isEmpty():
            break
    chosen = owner.select("item", F.col("best.at").alias("turn"), F.col("best.slot").alias("slot")).orderBy("turn", "slot").limit(count)
    place = F.row_number().over(Window.orderBy("turn", "slot"))  # count rows
    return chosen.join(lists.select("item", "slot", "label"), ["item", "slot"]).select("item", "label", "turn", place.alias("place"))
