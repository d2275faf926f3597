"""Exact and near duplicates of records by their ASCII tokens."""

from __future__ import annotations

import math
import tempfile
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def exact_dedup(rows: DataFrame, key: str, *content: str) -> DataFrame:
    """The first row by key of each distinct content; aggregated before it is shuffled, so copies cost little."""
    digest = F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in content))), 256)
    return rows.groupBy(digest.alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def _number(hexadecimal: Column) -> Column:
    """16 hexadecimal digits as a signed long."""
    high, low = F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("long"), F.conv(F.substring(hexadecimal, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


#: Sums, each of which holds a count in its low bits and another above so many.
LANES, LANE_BITS = 32, 31
#: Longs of a sketch, 512 bits in all.
SKETCH = [f"s{k}" for k in range(8)]


def fingerprints(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """key (unique), simhash: bit i is set if at least half of the tokens' SHA-256 prefixes have it; without tokens all are. Also the columns of a sketch, of which a bit is set if an odd number of tokens hash to it: two sets' sketches differ in no more bits than the sets in tokens.

    Two counts share a sum; an array holds no more tokens than a lane counts to, so that no count reaches its neighbour.
    """
    hashed = rows.select(key, F.explode_outer(tokens).alias("token")).select(key, F.when(F.col("token").isNotNull(), _number(F.sha2("token", 256))).alias("h"))
    bit = lambda i: F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1).cast("long"))
    lane = lambda i: bit(i) + F.shiftleft(bit(i + LANES), LANE_BITS)
    # places by the upper bits, which are mixed anew
    place = F.xxhash64("h")
    flipped = lambda k: F.when(F.col("h").isNotNull() & (F.shiftrightunsigned(place, 6).bitwiseAND(F.lit(7).cast("long")) == k), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int")))
    odd = [F.coalesce(F.bit_xor(flipped(k)), F.lit(0).cast("long")).alias(c) for k, c in enumerate(SKETCH)]
    sums = hashed.groupBy(key).agg(*odd, F.count("h").alias("n"), *(F.coalesce(F.sum(lane(i)), F.lit(0)).alias(f"lane{i}") for i in range(LANES)))
    zero, out = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(64):
        count = F.shiftrightunsigned(f"lane{i % LANES}", LANE_BITS * (i // LANES)).bitwiseAND(F.lit((1 << LANE_BITS) - 1).cast("long"))
        out = out.bitwiseOR(F.when(2 * count >= F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(zero))
    return sums.select(key, out.alias("simhash"), *SKETCH)


def simhash64(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, simhash of each row's distinct tokens."""
    return fingerprints(rows.select(key, tokens(F.col(text)).alias("t")), key, "t").select(key, "simhash")


def classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, tokens of the first row of each distinct token set that isn't empty, and copies."""
    # asked of the text, so that its tokens are taken once
    some = F.coalesce(F.lower(text).rlike("[a-z0-9]"), F.lit(False))
    sets = rows.where(some).select(key, F.sort_array(tokens(F.col(text))).alias("tokens"))
    return sets.groupBy("tokens").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def membership(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, class: the first row with the same token set; rows without tokens stand for themselves."""
    sets = rows.select(key, F.to_json(F.sort_array(tokens(F.col(text)))).alias("set")).select(key, F.when(F.col("set") != "[]", F.sha2("set", 256)).alias("digest"))
    firsts = sets.where("digest is not null").groupBy("digest").agg(F.min(key).alias("class"))
    return sets.join(firsts, "digest", "left").select(key, F.coalesce("class", key).alias("class"))


#: Rows of a band's value that meet in one task; more are dealt over blocks, each two of which meet.
BAND_BLOCK = 512

def near_pairs(rows: DataFrame, key: str, text: str, threshold: float = 0.9) -> DataFrame:
    """a, b, jaccard: pairs of first rows of distinct token sets that share one of four 16-bit bands of the fingerprint and are as alike as the threshold; membership() has the other rows of each set.

    Only rows whose numbers of tokens are of one class or of neighbouring ones meet, and only pairs whose sketches allow the
    threshold get their tokens; neither loses a pair. Rows exploded are many more than they are taken for: none is broadcast.
    """
    firsts = reliable(classes(rows, key, text).select(key, "tokens", F.size("tokens").alias("n")))
    prints = fingerprints(firsts, key, "tokens").join(firsts.select(key, "n").hint("merge"), key)
    # of alike sets the larger is at most 1 / threshold times the smaller, so less than one class apart
    size = F.floor(F.ln(F.col("n").cast("double")) / F.lit(math.log(1.01 / threshold))).cast("int")
    bands = prints.select(key, "n", *SKETCH, size.alias("size"), F.posexplode(F.array(*(F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)))).alias("band", "value"))
    # classes g and g + 1 meet at g
    bands = reliable(bands.withColumn("g", F.explode(F.array(F.col("size") - 1, F.col("size")))))
    # values of many rows are dealt over blocks; of two blocks the one meets the other once
    blocks = bands.groupBy("band", "value", "g").agg(F.ceil(F.count("*") / BAND_BLOCK).cast("int").alias("blocks"))
    dealt = bands.join(blocks.hint("merge"), ["band", "value", "g"]).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "value", "g", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", key, "n", "size", *SKETCH)
    at = ["band", "value", "g", "low", "high"]
    left, right = (dealt.select(*at, *(F.col(c).alias(f"{c}_{x}") for c in ("own", "n", "size", *SKETCH)), F.col(key).alias(x)) for x in "ab")
    n = F.col("n_a") + F.col("n_b")
    apart = reduce(add, (F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH))
    # jaccard is (n - d) / (n + d) for d tokens that one of the sets has
    fits = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (apart * (1 + threshold) <= n * (1 - threshold) + 1e-6)
    once = (F.least("size_a", "size_b") == F.col("g")) & ((F.col("own_a") != F.col("own_b")) | (F.col("low") == F.col("high")))
    met = left.join(right.hint("merge"), at).where(F.col("a") < F.col("b")).where(once & fits).select("a", "b").distinct()
    x, y = firsts.select(F.col(key).alias("a"), F.col("tokens").alias("x")), firsts.select(F.col(key).alias("b"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = met.join(x.hint("merge"), "a").join(y.hint("merge"), "b").withColumn("jaccard", common / (F.size("x") + F.size("y") - common))
    return both.where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def reliable(frame: DataFrame) -> DataFrame:
    """A checkpoint in the session's folder; without one in a temporary folder, which only a local master can use."""
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="colloquy-"))
    return frame.checkpoint()


def greedy_filter(rows: DataFrame, key: str, text: str, threshold: float = 0.9) -> DataFrame:
    """key, kept: a row is dropped if it is near a row with a smaller key that is itself kept.

    Rows with the token set of an earlier row go at once. Among the others a round decides all rows whose earlier neighbours are
    decided: kept if all of those are dropped, dropped if one is kept. The smallest undecided row is decided in every round.
    """
    pairs = reliable(near_pairs(rows, key, text, threshold).select("a", "b"))
    state = reliable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept is null").isEmpty():
        before = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("earlier")), "a").groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("earlier", F.lit(False))).alias("near_kept"), F.bool_or(F.col("earlier").isNull()).alias("open"))
        decided = F.when(F.coalesce("near_kept", F.lit(False)), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True)
        state = state.join(before, "id", "left").select("id", F.coalesce("kept", decided).alias("kept"))
        state = reliable(state)
    firsts = classes(rows, key, text).select(F.col(key).alias("first"))
    empty = F.size(tokens(F.col(text))) == 0
    marked = rows.select(key, empty.alias("empty")).join(firsts, F.col(key) == F.col("first"), "left").join(state, F.col(key) == F.col("id"), "left")
    return marked.select(key, (F.col("empty") | (F.col("first").isNotNull() & F.coalesce("kept", F.lit(True)))).alias("kept"))


def split_leakage(rows: DataFrame, split: str, *content: str) -> DataFrame:
    """digest, splits, copies: contents that stand in more than one split."""
    digest = F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in content))), 256)
    seen = rows.groupBy(digest.alias("digest")).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count("*").alias("copies"))
    return seen.where(F.col("splits").contains(","))


def topic_vectors(rows: DataFrame, key: str, text: str, dimensions: int = 2048) -> DataFrame:
    """key, slot, value: distinct tokens hashed into slots, of length one."""
    slot = (F.conv(F.substring(F.sha2("token", 256), 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    counts = rows.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, slot.alias("slot")).agg(F.count("*").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "slot", (F.col("n") / norm).alias("value"))


def topic_similarity(vectors: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """key, similarity: cosine to the reference, a frame of slot and value with a row per slot at most (bounded by the dimensions)."""
    joined = vectors.join(F.broadcast(reference.select("slot", F.col("value").alias("r"))), "slot", "left")
    return joined.groupBy(key).agg(F.sum(F.col("value") * F.coalesce("r", F.lit(0.0))).alias("similarity"))
