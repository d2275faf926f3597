"""URL filters, with DataFrame functions only: rules by host and path, and boosted trees over lexical traits for the rest.

The traits of a url are its length, its host's length and labels, the depth of its path, the share of digits, the entropy of its
characters, the number of its parameters, and what share of the labelled urls with its host's last label, and with its last
two, is blocked. Each trait falls into one of a few bins. The labelled urls are summed by their bins once; a level of a tree is
one aggregate over these sums, of which a row for each leaf, trait and bin reaches the driver. A tree becomes a conditional
expression, so urls are scored in generated code.
"""

from __future__ import annotations

from functools import reduce
from math import log
from operator import add
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import checkpointed, table

#: Verdict, host, path of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Trees, their levels, the share of each that is added, what is added to the weight of a leaf, the least number of urls in one.
TREES, LEVELS, RATE, RIDGE, LEAF_URLS = 16, 3, 0.3, 1.0, 20
#: A suffix counts from so many labelled urls on; the overall share weighs as much as so many urls.
SUFFIX_URLS, SUFFIX_WEIGHT = 20, 10
#: Gradients are summed as whole numbers of this part, so that sums don't depend on the order.
UNIT = 1 << 20
#: The traits' bins end at these values, the last bin is open.
BINS = {
    "length": (20, 25, 30, 35, 40, 50, 60, 80, 100, 150, 250, 500),
    "host_length": (8, 12, 16, 20, 25, 30, 40, 60),
    "labels": (1, 2, 3, 4, 5),
    "depth": (0, 1, 2, 3, 4, 5, 7, 10),
    "digits": (0, 20, 40, 60, 80, 100, 150, 200, 300, 500),
    "entropy": (250, 300, 325, 350, 375, 400, 425, 450, 475, 500, 550),
    "parameters": (0, 1, 2, 3, 5, 8, 13),
    "last": tuple(range(0, 1000, 100)),
    "last_two": tuple(range(0, 1000, 100)),
}


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (lower-cased A-Z), path and query of a url; all empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    cut = lambda pattern, group: F.regexp_extract(rest, pattern, group)
    return lower_ascii(cut(r"^[^/?#]*", 0)), cut(r"^[^/?#]*([^?#]*)", 1), cut(r"^[^?#]*\?([^#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null if none does. Rules of one length: in the order of their text."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits a character; all characters beyond ASCII count as one."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "\x80")
    n = F.length(plain).cast("double")
    counts = F.transform(F.sequence(F.lit(0), F.lit(128)), lambda c: F.length(plain) - F.length(F.replace(plain, F.char(c), F.lit(""))))
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def traits(pages: DataFrame, rules: tuple) -> DataFrame:
    """pages: url and others. Adds host, path, rule, ruled (its verdict), the traits but the suffixes' shares, suffix1, suffix2."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path, query = parts(url)
    rows = pages.withColumns({"host": host, "path": path, "query": query})
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    filled = lambda text, sign: F.size(F.filter(F.split(text, sign), lambda x: x != ""))
    return rows.withColumns({
        "rule": rule, "ruled": ruled, "length": F.length(url), "host_length": F.length("host"), "labels": filled(F.col("host"), r"\."), "depth": filled(F.col("path"), "/"),
        "digits": F.coalesce(F.floor(1000 * F.length(F.regexp_replace(url, "[^0-9]", "")) / F.nullif(F.length(url), F.lit(0))), F.lit(0)).cast("int"),
        "entropy": F.floor(100 * entropy(url)).cast("int"), "parameters": filled(F.col("query"), "&"),
        "suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2),
    }).drop("query")


def suffix_shares(labelled: DataFrame, suffix: str, share: str, overall: float) -> DataFrame:
    """labelled: blocked (0, 1) and the suffix. Returns suffix, share: thousandths of the suffix's labelled urls that are blocked, drawn to the overall share."""
    n, y = F.count("*"), F.sum("blocked")
    rate = F.floor(1000 * (y + SUFFIX_WEIGHT * overall) / (n + SUFFIX_WEIGHT)).cast("int").alias(share)
    return labelled.groupBy(suffix).agg(rate, n.alias("n")).where(F.col("n") >= SUFFIX_URLS).select(suffix, share)


def binned(name: str) -> Column:
    return reduce(add, ((F.col(name) > end).cast("int") for end in BINS[name])).alias(name)


def expression(tree: tuple | float) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, end, low, high = tree
    return F.when(F.col(name) <= end, expression(low)).otherwise(expression(high))


def best_split(sums: dict[tuple[str, int], tuple[int, int, int]]) -> tuple[tuple[str, int], list, list] | None:
    """sums: for a trait and bin of one leaf the gradient, the weight and the number of urls. The trait and bin at which the leaf is cut, and the sums of both sides."""
    worth = lambda g, h, n: (g / UNIT) ** 2 / (h / UNIT + RIDGE)
    best, found = 1e-6, None
    for name in BINS:
        own = sorted((b, v) for (k, b), v in sums.items() if k == name)
        whole = [sum(v[i] for _, v in own) for i in range(3)]
        left = [0, 0, 0]
        for b, v in own[:-1]:
            left = [x + y for x, y in zip(left, v, strict=True)]
            right = [x - y for x, y in zip(whole, left, strict=True)]
            gain = worth(*left) + worth(*right) - worth(*whole)
            if min(left[2], right[2]) >= LEAF_URLS and gain > best:
                best, found = gain, ((name, b), left, right)
    return found


def boosted(cells: DataFrame, share: float, trees: int = TREES, levels: int = LEVELS) -> list[tuple | float]:
    """cells: a column of bins for each trait, n, blocked. Returns trees over the bins, the first a constant, whose sum is the log-odds of a block."""
    found: list[tuple | float] = [log(share / (1 - share))]
    bins = F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("bin")) for name in BINS))
    value = lambda g, h, n: RATE * g / (h + RIDGE * UNIT)
    for _ in range(trees):
        chance = 1 / (1 + F.exp(-reduce(add, map(expression, found))))
        grown: dict[int, tuple[str, int]] = {}
        values: dict[int, float] = {}
        for level in range(levels):
            rows = cells.select("n", placed(1, grown).alias("leaf"), chance.alias("p"), "blocked", bins.alias("bins"))
            gradient, weight = F.col("blocked") - F.col("n") * F.col("p"), F.col("n") * F.col("p") * (1 - F.col("p"))
            rows = rows.select("leaf", F.round(gradient * UNIT).cast("long").alias("g"), F.round(weight * UNIT).cast("long").alias("h"), "n", F.inline("bins"))
            sums: dict[int, dict] = {}
            for r in rows.groupBy("leaf", "name", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
                sums.setdefault(r.leaf, {})[r["name"], r.bin] = (r.g, r.h, r.n)
            cuts = {k: cut for k, own in sums.items() if k >> level and (cut := best_split(own))}
            for k, (at, left, right) in cuts.items():
                grown[k], values[2 * k], values[2 * k + 1] = at, value(*left), value(*right)
            if not cuts:
                break
        if not grown:  # nothing is left to learn
            break
        found.append(built(1, grown, values))
    return found


def placed(k: int, grown: dict[int, tuple[str, int]]) -> Column:
    """The number of a row's leaf: below leaf k are 2 k and 2 k + 1."""
    if k not in grown:
        return F.lit(k)
    name, end = grown[k]
    return F.when(F.col(name) <= end, placed(2 * k, grown)).otherwise(placed(2 * k + 1, grown))


def built(k: int, grown: dict[int, tuple[str, int]], values: dict[int, float]) -> tuple | float:
    return (*grown[k], built(2 * k, grown, values), built(2 * k + 1, grown, values)) if k in grown else values[k]


def filtered(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of pages (url and any others) with host, path, rule, verdict (allow or block) and score (log-odds of a block by the trees).

    Host: after the first :// up to /, ? or #, lower-cased A-Z; path: from there up to ? or #; null or no ://: both empty. A rule
    (verdict, host, path) fits its host and all hosts below it if the path starts with the rule's; the longest wins and gives the
    verdict. For the others the trees decide: a score above 0 is a block. They learn from labelled (url, blocked 0 or 1, others are
    left out), or if that is not given from the urls of pages that rules decide, all of them. Without labelled urls of both kinds
    the verdict is that of the only kind, or allow if there is none, and the score null. A column of pages named like a new one
    gives way to it. Repeated rows keep their rows; an empty table gives none.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    inner = [f"page column {k}" for k in range(len(kept))]
    rows = traits(pages.select(F.col("url"), *(F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True))), rules)
    known = traits(labelled.select("url", F.col("blocked").cast("int").alias("blocked")), rules).where("blocked is not null") if labelled is not None else rows.where("ruled is not null").withColumn("blocked", (F.col("ruled") == "block").cast("int"))
    known = checkpointed(known.select("blocked", *(c for c in BINS if c in known.columns), "suffix1", "suffix2"))
    n, y = known.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    out = [*(F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)), F.col("host"), F.col("path"), F.col("rule")]
    if y in (0, n):
        return rows.select(*out, F.coalesce("ruled", F.lit("block" if n and y == n else "allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    overall = y / n
    shares = [(s, share, checkpointed(suffix_shares(known, s, share, overall))) for s, share in (("suffix1", "last"), ("suffix2", "last_two"))]

    def with_bins(df: DataFrame, *more: str) -> DataFrame:
        for suffix, share, table in shares:  # adaptive execution broadcasts a table of shares if it is found small
            df = df.join(table, suffix, "left").withColumn(share, F.coalesce(share, F.lit(int(1000 * overall))))
        return df.select(*more, *map(binned, BINS))

    cells = checkpointed(with_bins(known, "blocked").groupBy(*BINS).agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked")))
    score = reduce(add, map(expression, boosted(cells, overall)))
    scored = with_bins(rows, *inner, "host", "path", "rule", "ruled").withColumn("score", score)
    return scored.select(*out, F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filtered(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
