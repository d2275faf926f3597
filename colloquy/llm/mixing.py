"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import checkpointed, table

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Documents that one bucket rounds on its own; each leaves one fractional document per source at most.
BUCKET_DOCS = 4096
#: Residues that one node of the reduction tree combines.
FAN_IN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sizes: source, size. Returns source, source_size, target for each source: the sources in code point order, null last, weigh by turns as in weights and share the given part of all sizes; no target is above most times its source.

    The sources are filled in ascending order of cap by weight: while a source's cap is below its share of what is left, it gets
    its cap; the others share the rest by weight.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = totals.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = weighed.withColumn("fill", left / weight).withColumn("full", F.col("level") <= F.col("fill"))
    # the first source that isn't full sets the level of all from there on
    filled = filled.withColumn("fill", F.first(F.when(~F.col("full"), F.col("fill")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("fill") * F.col("weight")).alias("target"))


def draw(seed: int, *parts: object) -> float:
    """A number in [0, 1) that depends on its arguments only."""
    return xxhash.xxh64_intdigest(repr(parts), seed) / 2.0**64


def pivot(p: float, q: float, size: float, other: float, u: float) -> tuple[float, float]:
    """Moves chance between two documents until one is 0 or 1, keeping p * size + q * other and, on average, both."""
    up = min((1 - p) * size, q * other)  # words of chance that can go from the second to the first
    down = min(p * size, (1 - q) * other)
    if u * (up + down) < down:
        move = up
    else:
        move = -down
    p, q = p + move / size, q - move / other
    snap = lambda x: 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
    return snap(p), snap(q)


def round_units(units: Iterator[tuple], seed: int) -> Iterator[tuple]:
    """units: (group, key, size, chance), by group. Yields (key, 0 or 1) for those settled and (key, size, chance) for the one of each group that isn't."""
    group = held = None
    for own, key, size, chance in units:
        if held is not None and own != group:
            yield held
            held = None
        group = own
        if chance in (0.0, 1.0) or size <= 0:
            yield key, int(chance)
            continue
        if held is None:
            held = key, size, chance
            continue
        p, q = pivot(held[2], chance, held[1], size, draw(seed, held[0], key))
        first, second = (held[0], held[1], p), (key, size, q)
        held = None
        for x in (first, second):
            if x[2] in (0.0, 1.0):
                yield x[0], int(x[2])
            elif held is None:
                held = x
    if held is not None:
        yield held


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """Every row of docs (doc_id, text, source; with its other columns) with mix_size, mix_source_size, mix_target and mix_copies.

    A document's size is its number of words (null text: 0). Each of a source's documents is wanted target / source_size times;
    the whole part is taken as is, the fraction is rounded by the pivotal method: two documents exchange chance until one
    of them is decided, so that a source's words stay at its target but for one undecided document. Buckets of about
    BUCKET_DOCS documents round on their own, by a hash of doc_id; what they leave undecided is combined in a tree with
    FAN_IN residues of a source at each node, and the last one of a source is drawn. All draws are hashes of doc_ids and
    the seed, so that reruns agree. Documents of no words are taken once (0 words either way). Null sources are one source,
    the last. Rows with one doc_id, null included, are decided one by one. An empty table gives no rows.
    """
    sized = docs.withColumn("mix_size", word_count(F.col("text")))
    decided = decide(sized.select("doc_id", "source", F.col("mix_size").alias("size")), weights, share, most, seed)
    # rows with one doc_id and size are alike for the decision; both sides are numbered in an order that reruns keep
    rank = lambda *by: F.row_number().over(Window.partitionBy("doc_id", "source", "mix_size").orderBy(*by))
    decided = decided.select("doc_id", "source", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_copies"))
    content = F.xxhash64(*(F.col(c).cast("string") for c in docs.columns))
    a, b = sized.withColumn("mix_content", content).withColumn("mix_rank", rank("mix_content")), decided.withColumn("mix_rank", rank("mix_copies"))
    same = a.doc_id.eqNullSafe(b.doc_id) & a.source.eqNullSafe(b.source) & (a.mix_size == b.mix_size) & (a.mix_rank == b.mix_rank)
    return a.join(b, same).select(*(a[c] for c in docs.columns), a.mix_size, b.mix_source_size, b.mix_target, b.mix_copies)


def decide(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """sized: doc_id, source, size. Returns those with source_size, target, copies."""
    sized = checkpointed(sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "size"))
    targets = checkpointed(source_targets(sized, weights, share, most))
    buckets = max(1, -(-sized.count() // BUCKET_DOCS))
    known = targets.select(F.col("source").alias("of"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0).alias("wanted"))
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket and source in a fixed order; copies is null for what a bucket leaves undecided."""

        def units() -> Iterator[tuple]:
            for batch in batches:
                for doc, source, size, source_size, target, wanted, bucket in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    base = int(np.floor(min(wanted, most) + 1e-12))
                    yield (bucket, source), (doc, source, size, source_size, target, bucket, base), size, max(0.0, wanted - base)

        out: list[tuple] = []
        for key, *rest in round_units(units(), seed):
            settled = len(rest) == 1
            out.append((*key[:6], key[6] + rest[0] if settled else key[6], None if settled else rest[1]))
            if len(out) == 8192:
                yield given(out)
                out = []
        if out:
            yield given(out)

    names = ["doc_id", "source", "size", "source_size", "target", "bucket", "copies", "chance"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.float64()]

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    ordered = rows.select("doc_id", "source", "size", "source_size", "target", "wanted", "bucket").repartition("bucket").sortWithinPartitions("bucket", "source", F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size")
    rounded = checkpointed(ordered.mapInArrow(first, "doc_id long, source string, size long, source_size long, target double, bucket int, copies long, chance double"))
    open_units = rounded.where("chance is not null").select("source", "bucket", "size", "chance")
    added = settle(open_units, buckets, seed)
    late = rounded.where("chance is not null").join(added, rounded.source.eqNullSafe(added.of) & (rounded.bucket == added.at))
    late = late.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.col("added")).alias("copies"))
    return rounded.where("chance is null").select(*late.columns).unionByName(late)


def settle(units: DataFrame, buckets: int, seed: int) -> DataFrame:
    """units: source, bucket, size, chance. Returns of, at (source and bucket), added: the reduction tree."""
    node = "of string, at int, size long, chance double, added long"
    current = units.select(F.col("source").alias("of"), F.col("bucket").alias("at"), "size", "chance")
    done = None
    while True:
        final = buckets <= FAN_IN

        def combine(batches: Iterator[pa.RecordBatch], final: bool = final) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for of, at, size, chance, group in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                        yield (group, of), (of, at), size, chance

            out = []
            for key, *rest in round_units(rows(), seed + 1):
                if len(rest) == 1:
                    out.append((*key, None, None, rest[0]))
                elif final:
                    out.append((*key, None, None, int(draw(seed + 2, key) < rest[1])))
                else:
                    out.append((*key, *rest, None))
            if out:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["of", "at", "size", "chance", "added"])

        grouped = current.withColumn("group", F.lit(0) if final else F.pmod(F.col("at"), F.lit(-(-buckets // FAN_IN))))
        settled = checkpointed(grouped.repartition("group", "of").sortWithinPartitions("group", "of", "at").mapInArrow(combine, node))
        some = settled.where("added is not null").select("of", "at", "added")
        done = some if done is None else done.unionByName(some)
        if final:
            return done
        current, buckets = settled.where("added is null").select("of", "at", "size", "chance"), -(-buckets // FAN_IN)


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its own columns."""
    rows = mix(docs, seed=seed).withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies").cast("int")))).where("mix_copy > 0")
    return rows.select(*docs.columns)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decide(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
