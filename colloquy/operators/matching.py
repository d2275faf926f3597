"""How much of two texts matches, by longest common blocks: the longest one first, then those left and right of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.dedup import reliable


def folded(text: Column) -> Column:
    """One space between words, cases folded."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x1c-\x1f\x85]+", " "))
    # the optimiser drops the inner of two case conversions that follow each other; a sigma has two small forms
    return F.lower(F.translate(F.upper(plain), "Σ", "σ"))


#: Lengths that runs of equals have at least, from the longest; a box without runs of a length is left to the next.
LEAST = (8, 4, 2, 1)
BOX = ["id", "i0", "j0"]


def common_runs(boxes: DataFrame, least: int) -> DataFrame:
    """boxes: id, i0, j0, a, b (the texts from places i0 and j0 on). Returns id, i0, j0, i, j, size: the longest runs of at least so many equal characters on each diagonal of a box."""

    def grams(c: str, start: str, at: str) -> DataFrame:
        # from each of the first places, pieces that follow each other: every place once, in time linear in the text
        def placed(first: int) -> Column:
            pieces = F.regexp_extract_all(F.substring(c, 1 + first, 1 << 30), F.lit(rf"(?s).{{{least}}}"), F.lit(0))
            return F.transform(pieces, lambda gram, t: F.struct((F.col(start) + first + least * t).alias(at), gram.alias("gram")))

        return boxes.select(*BOX, F.inline(F.flatten(F.array(*map(placed, range(least))))))

    # exploded rows are many more than they are taken for: never to be broadcast
    equal = grams("a", "i0", "i").join(grams("b", "j0", "j").hint("merge"), [*BOX, "gram"]).select(*BOX, (F.col("i") - F.col("j")).alias("d"), "i")
    along = Window.partitionBy(*BOX, "d").orderBy("i")
    runs = equal.withColumn("run", F.col("i") - F.row_number().over(along)).groupBy(*BOX, "d", "run").agg(F.min("i").alias("i"), (F.count("*") + least - 1).cast("int").alias("size"))
    return runs.select(*BOX, "i", (F.col("i") - F.col("d")).alias("j"), "size")


def longest_first(boxes: DataFrame, least: int) -> DataFrame:
    """id, i0, j0, i, j, size of the blocks of at least so many characters in each box.

    A round takes the best run of every open box of every pair and cuts the others to the boxes before and after it; what
    lies across goes. Rounds end when no run is left: as many as blocks lie within blocks, whatever the number of pairs.
    """
    own = Window.partitionBy(*BOX, "low_i", "low_j")
    best = F.max(F.struct("size", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).over(own)
    runs = common_runs(boxes, least).select(*BOX, F.col("i0").alias("low_i"), F.col("j0").alias("low_j"), "i", "j", "size")
    found = []
    while True:
        runs = reliable(runs.withColumn("best", best))
        if found and runs.isEmpty():
            return reduce(DataFrame.unionByName, found)
        at_i, at_j, length = -F.col("best.i"), -F.col("best.j"), F.col("best.size")
        found.append(runs.where((F.col("i") == at_i) & (F.col("j") == at_j)).select(*BOX, "i", "j", "size"))
        end_i, end_j = at_i + length, at_j + length
        before = F.least("size", at_i - F.col("i"), at_j - F.col("j"))
        gone = F.greatest(F.lit(0), end_i - F.col("i"), end_j - F.col("j"))
        cut = [
            F.struct(F.col("low_i"), F.col("low_j"), F.col("i"), F.col("j"), before.alias("size")),
            F.struct(end_i.alias("low_i"), end_j.alias("low_j"), (F.col("i") + gone).alias("i"), (F.col("j") + gone).alias("j"), (F.col("size") - gone).alias("size")),
        ]
        runs = runs.select(*BOX, F.inline(F.array(*cut))).where(F.col("size") >= least)


def gaps(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The boxes between the blocks of each box, where both texts have something."""
    cuts = blocks.groupBy(*BOX).agg(F.array_sort(F.collect_list(F.struct("i", "j", "size"))).alias("cuts"))
    none = F.array().cast("array<struct<i:int,j:int,size:int>>")
    held = boxes.join(cuts.hint("merge"), BOX, "left").withColumn("cuts", F.coalesce("cuts", none))
    starts = F.concat(F.array(F.struct(F.col("i0").alias("i"), F.col("j0").alias("j"))), F.transform("cuts", lambda x: F.struct((x["i"] + x["size"]).alias("i"), (x["j"] + x["size"]).alias("j"))))
    ends = F.concat(F.transform("cuts", lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"))), F.array(F.struct((F.col("i0") + F.length("a")).alias("i"), (F.col("j0") + F.length("b")).alias("j"))))
    between = held.select("*", F.inline(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("s", "e")).where("s.i < e.i and s.j < e.j")
    part = lambda c, x: F.substring(F.col(c), F.col(f"s.{x}") - F.col(f"{x}0") + 1, F.col(f"e.{x}") - F.col(f"s.{x}"))
    return between.select("id", F.col("s.i").alias("i0"), F.col("s.j").alias("j0"), part("a", "i").alias("a"), part("b", "j").alias("b"))


def matching_blocks(pairs: DataFrame) -> DataFrame:
    """pairs: id, a, b. Returns id, i, j, size of the matching blocks: in each box the longest run, of equals that with the least i, then j.

    Long runs come from long pieces that both texts have, which are few; short ones are looked for only in the boxes that the
    longer blocks leave, so that the places compared don't grow with the product of two texts' lengths.
    """
    boxes, found = reliable(pairs.select("id", F.lit(0).alias("i0"), F.lit(0).alias("j0"), "a", "b")), []
    for least in LEAST:
        found.append(longest_first(boxes, least))
        if least > 1:
            boxes = reliable(gaps(boxes, found[-1]))
    return reduce(DataFrame.unionByName, found).select("id", "i", "j", "size")


def match_ratio(pairs: DataFrame) -> DataFrame:
    """pairs: id (unique), a, b. Returns id, ratio: twice the matching characters by all characters, 1 for two empty texts. Null is empty."""
    pairs = reliable(pairs.select("id", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b")))
    # copies are compared once, and texts with their like not at all
    apart = reliable(pairs.where("a <> b").select("a", "b").distinct().withColumn("id", F.monotonically_increasing_id()))
    matched = apart.join(matching_blocks(apart).groupBy("id").agg(F.sum("size").alias("matched")).hint("merge"), "id").select("a", "b", "matched")
    whole = F.length("a") + F.length("b")
    ratio = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2 * F.coalesce("matched", F.lit(0)) / whole)
    return pairs.join(matched.hint("merge"), ["a", "b"], "left").select("id", ratio.alias("ratio"))


def distinctness(rows: DataFrame, key: list[str], texts: list[str]) -> DataFrame:
    """key (unique), and for each two of the texts' columns x_vs_y, their ratio; max_pairwise_similarity; text_distinctness, 1 less that. Texts are compared folded."""
    two = [(x, y) for k, x in enumerate(texts) for y in texts[k + 1 :]]
    held = reliable(rows.select(*key, *(folded(F.col(t)).alias(t) for t in texts)))
    each = held.select(*key, F.inline(F.array(*(F.struct(F.lit(f"{x}_vs_{y}").alias("which"), F.col(x).alias("a"), F.col(y).alias("b")) for x, y in two))))
    ratios = match_ratio(each.select(F.struct(*key, "which").alias("id"), "a", "b")).select(*(F.col(f"id.{c}").alias(c) for c in [*key, "which"]), "ratio")
    wide = ratios.groupBy(*key).agg(*(F.max(F.when(F.col("which") == f"{x}_vs_{y}", F.col("ratio"))).alias(f"{x}_vs_{y}") for x, y in two), F.max("ratio").alias("max_pairwise_similarity"))
    return wide.withColumn("text_distinctness", 1 - F.col("max_pairwise_similarity"))
