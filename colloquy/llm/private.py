"""Personal data in texts, with DataFrame functions only.

Four kinds of spans come from fixed patterns and checks: email, ip, card, phone. A label model adds spans of a further kind,
secret: tokens that hold a digit and lie outside the former. Four labellers vote on each such token: a pattern (a long
run of hexadecimal or mixed digits and letters), a gazetteer (a word such as password or token stands close in front or in it), the
context (it follows an equals sign, colon or quotation mark, or a key's usual prefix) and a second gazetteer of what is public (a
checksum, an order, a file or the like is announced, or has its form). Expectation-maximisation over the vote
patterns gives each pattern a posterior; a naive Bayes classifier of the token's shape, length and surroundings is trained on
the posteriors of all candidates and decides which become spans.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import checkpointed, table
from colloquy.llm.labels import label_model

KINDS = ("email", "ip", "card", "phone")
#: Possessive repeats where no character can be given back: the regular expression engine then loops and doesn't recurse.
#: A mail address is looked for where a run of its characters begins or the last match ended, so runs aren't scanned again and again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"[A-Za-z0-9_+/-]*[0-9][A-Za-z0-9_+/-]*"
#: Characters before and after a candidate that its labellers see.
BEFORE, AFTER = 24, 2

#: Words that announce a secret.
GAZETTEER = r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[ _-]?key|apikey|auth|bearer|credential)"
#: The same close in front of a candidate and not denied; words and forms that announce something public.
ANNOUNCED = GAZETTEER.replace("(?i)", r"(?i)(?<!\bno )(?<!without )") + r"[^.!?\n]{0,12}$"
PUBLIC = r"(?i)(?:\b(?:commit|sha(?:-?[0-9]{1,3})?|md5|checksum|digest|uuid|guid|file|image|img|id|order|invoice|version|build|isbn|model|part|page|room|no|number|nr)\b|#)[\s.:=#_-]*$"
PUBLIC_FORM = r"(?i)^(?:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|(?:img|image|file|dsc|scan|photo|screenshot|page|fig)[_-].*|[0-9-]+)$"
KEY_PREFIX = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox[abpr]-|AIza)"

SPAN = "array<struct<kind:int,s:int,e:int>>"
#: Matches whose places are worked out in one go.
PART = 128


def matches(text: Column, pattern: str, guard: Column, made: Callable, initial: str) -> Column:
    """Leftmost matches in order; made(match, start, end, before, after) gives the array to append for each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the text between the matches: one piece more than there are matches
    pieces = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("b"), F.slice(pieces, 2, F.size(found)).alias("a"))
    named = F.transform(pairs, lambda x: F.struct(x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), made(acc["out"], x["m"], start, end, x["b"], x["a"]).alias("out"))

    # arrays are copied when they grow, so many matches are taken in parts, each of which starts where those before it end
    def part(xs: Column, before: Column) -> Column:
        return F.aggregate(xs, F.struct(before.alias("at"), F.array().cast(initial).alias("out")), step, lambda acc: acc["out"])

    length = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x["b"]) + F.length(x["m"]))
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / PART).cast("int")), lambda c: F.slice(xs, c * PART + 1, F.lit(PART)))

    def parts(xs: Column) -> Column:
        """The lengths of the parts are summed once each; only their totals are summed again for each part."""
        sizes = lambda ps: F.transform(ps, length)
        places = lambda ps, ns: F.transform(ps, lambda p, i: part(p, F.aggregate(F.slice(ns, F.lit(1), i), F.lit(0), lambda n, x: n + x)))
        # an array of one stands for a name again
        held = F.transform(F.array(cut(xs)), lambda ps: F.struct(ps.alias("ps"), sizes(ps).alias("ns")))
        return F.flatten(F.element_at(F.transform(held, lambda h: places(h["ps"], h["ns"])), 1))

    # an array of one stands for a name: the matches are found once
    whole = F.element_at(F.transform(F.array(named), parts), 1)
    return F.when(guard, whole).otherwise(F.array().cast(initial))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """13 to 19 digits whose weighted sum is a multiple of ten."""
    d = digits(match)
    total = F.aggregate(
        F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1))),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def small_parts(match: Column) -> Column:
    """All four numbers are at most 255."""
    value = lambda part: F.regexp_replace(part, "^0+", "")
    return F.forall(F.split(match, r"\."), lambda part: (F.length(value(part)) <= 3) & (F.coalesce(value(part).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind and start, in code points, ends exclusive."""

    def kept(kind: int, ok: Callable) -> Callable:
        return lambda out, m, s, e, b, a: F.when(ok(m), F.concat(out, F.array(F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"))).cast(SPAN))).otherwise(out)

    return F.concat(
        matches(text, EMAIL, text.contains("@"), kept(0, lambda m: F.lit(True)), SPAN),
        matches(text, IP, text.rlike(r"[0-9]\.[0-9]"), kept(1, small_parts), SPAN),
        matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), kept(2, luhn), SPAN),
        matches(text, PHONE, text.contains("+"), kept(3, lambda m: F.length(digits(m)).between(9, 15)), SPAN),
    )


CANDIDATES = "array<struct<s:int,e:int,m:string,b:string,a:string>>"


def candidates(text: Column) -> Column:
    """Tokens of at least 6 characters that hold a digit, with what stands around them."""
    row = lambda m, s, e, b, a: F.struct(s.alias("s"), e.alias("e"), m.alias("m"), F.substring(b, -BEFORE, BEFORE).alias("b"), F.substring(a, 1, AFTER).alias("a"))
    return matches(text, CANDIDATE, text.rlike("[0-9]"), lambda out, m, s, e, b, a: F.when(F.length(m) >= 6, F.concat(out, F.array(row(m, s, e, b, a)).cast(CANDIDATES))).otherwise(out), CANDIDATES)


def public(m: Column, b: Column) -> Column:
    """A form or announcement of what is no secret; a colon alone between a name with a digit and a checksum, as in sha256:, is one too."""
    return b.rlike(PUBLIC) | m.rlike(PUBLIC_FORM) | ((b == ":") & m.rlike("^[0-9a-f]{32,}$"))


def ballot(c: Column) -> Column:
    """The four votes as a string: 1 for, 0 against, - to abstain."""
    m, b = c["m"], c["b"]
    mixed_text = m.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")
    pattern = F.when((F.length(m) >= 16) & mixed_text, "1").when(F.length(m) < 10, "0").otherwise("-")
    gazetteer = F.when(b.rlike(ANNOUNCED) | m.rlike(GAZETTEER), "1").otherwise("0")
    context = F.when((b.rlike(r"[=:]\s*[\"']?$") & ~public(m, b)) | m.rlike(KEY_PREFIX), "1").when(b.rlike(r"[\s(]$") & ~mixed_text, "0").otherwise("-")
    known = F.when(public(m, b), "0").when(m.rlike(KEY_PREFIX) | b.rlike(ANNOUNCED), "1").otherwise("-")
    return F.concat(pattern, gazetteer, context, known)


def traits(c: Column) -> Column:
    """What the classifier sees: one of a few values of each trait."""
    m, b, a = c["m"], c["b"], c["a"]
    form = F.when(m.rlike("^[0-9]+$"), "digits").when(m.rlike("^[0-9a-f]+$"), "hex").when(m.rlike("^[A-Z0-9]+$"), "upper").when(m.rlike("^[A-Za-z0-9]+$"), "mixed").otherwise("other")
    return F.array(
        F.concat(F.lit("form:"), form),
        F.concat(F.lit("length:"), F.least(F.floor(F.length(m) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("before:"), F.when(public(m, b), "public").when(b.rlike(r"[=:]\s*[\"']?$"), "sign").when(b.rlike(r"\s$"), "space").when(b == "", "start").otherwise("other")),
        F.concat(F.lit("after:"), F.when(a.rlike("^[\"']"), "quote").when(a.rlike(r"^\s"), "space").when(a == "", "end").otherwise("other")),
        F.concat(F.lit("word:"), b.rlike(ANNOUNCED).cast("string")),
        F.concat(F.lit("public:"), public(m, b).cast("string")),
        F.concat(F.lit("prefix:"), m.rlike(KEY_PREFIX).cast("string")),
        F.concat(F.lit("share:"), F.floor(4 * F.length(digits(m)) / F.length(m)).cast("string")),
    )


def find_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base (spans of the four kinds: kind 0 to 3, s, e), secrets (added spans s, e) of every row of docs (doc_id, text).

    A null text is empty. Rows are judged on their own, so repeated and null doc_ids keep their rows; an empty table gives none.
    The label model and the classifier take all candidates of all documents; only their vote patterns (81 at most) and
    the traits' sums (some dozens) reach the driver.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", base_spans(text).alias("base"), candidates(text).alias("c"))
    free = F.filter("c", lambda c: ~F.exists(F.col("base"), lambda x: (c["s"] < x["e"]) & (x["s"] < c["e"])))
    rows = checkpointed(rows.withColumn("c", free))
    single = rows.select(F.explode("c").alias("c")).select(ballot(F.col("c")).alias("votes"), traits(F.col("c")).alias("traits"))
    counted = {x.votes: x["count"] for x in single.groupBy("votes").count().collect()}
    posteriors, _ = label_model({tuple(None if v == "-" else int(v) for v in k): n for k, n in counted.items()}, prior=0.3, start=(0.2, 0.9))
    if not posteriors:
        return rows.select("doc_id", "base", F.array().cast("array<struct<s:int,e:int>>").alias("secrets"))
    name = lambda votes: "".join("-" if v is None else str(v) for v in votes)
    chance = literal_map({name(k): p for k, p in posteriors.items()})
    learnt = single.select(F.explode("traits").alias("trait"), F.element_at(chance, F.col("votes")).alias("p")).groupBy("trait").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    yes, no = (sum(n * (p if own else 1 - p) for votes, p in posteriors.items() for n in [counted[name(votes)]]) for own in (True, False))
    weights = {x.trait: log((x.yes + 1) / (yes + 2)) - log((x.no + 1) / (no + 2)) for x in learnt}
    start = log((yes + 1) / (no + 1)) - log(threshold / (1 - threshold))
    score = lambda c: F.aggregate(traits(c), F.lit(start), lambda a, t: a + F.element_at(literal_map(weights), t))
    return rows.select("doc_id", "base", F.transform(F.filter("c", lambda c: score(c) > 0), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))).alias("secrets"))


def literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for item in sorted(values.items()) for x in item))


def written(spans: Column, kind: Callable) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["s"].cast("string"), x["e"].cast("string")))


def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    base = written(F.col("base"), lambda x: F.element_at(names, x["kind"] + 1))
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", F.concat(base, written(F.col("secrets"), lambda x: F.lit("secret")))).alias("spans"))
