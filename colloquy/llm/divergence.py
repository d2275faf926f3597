"""How the sources of a language differ in their words: exact document frequencies choose the terms, an automaton recounts them.

First pass: the number of documents of each language that hold a term; a language keeps those in enough documents. Second
pass: the kept terms, padded with a delimiter on both sides, make an Aho-Corasick automaton, with which each document's
padded text is read once; what it finds are the occurrences. A vocabulary beyond AUTOMATON_BYTES is read in several passes.
Counts stay sparse: one row holds the terms of one bucket that a source has. A task that compares sources has one bucket of a
language's terms at a time, with all of its sources.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import checkpointed, table

#: Documents of a language that a kept term stands in, at least.
LEAST_DOCUMENTS = 3
#: Chances are counted in parts of this.
SCALE = 1_000_000_000
#: Ranks of the terms' report.
TERM_RANKS = 200
#: UTF-8 bytes of the terms of one automaton; its memory is some 20 times as much.
AUTOMATON_BYTES = 12 << 20
#: Entries of a task's tables before they are given out.
HELD_TERMS, HELD_WORDS = 1 << 18, 1 << 20
#: Terms of a bucket (a task gives a sum for each pair of sources of a language that it has a bucket of), numbers of a bucket's table of sources and terms, sources that a task compares with all others.
BUCKET_TERMS, BUCKET_CELLS, TILE = 2048, 1 << 20, 512

#: A-Z to a-z; other ASCII but letters separates terms; bytes of further characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(texts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """texts: lang, text. Returns lang, term: those in least documents of the language or more. Tasks count first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = held[lang]
                size -= len(own)
                own.update(set(terms_of(text.as_py())))
                size += len(own)
                if size > HELD_TERMS:
                    yield from counted(held)
                    held.clear()
                    size = 0
        yield from counted(held)
        held.clear()
        pa.default_memory_pool().release_unused()

    def counted(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            terms, counts = list(own), np.fromiter(own.values(), np.int64, len(own))
            for k in range(0, len(terms), 1 << 16):
                part = pa.array([t.decode() for t in terms[k : k + (1 << 16)]], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(counts[k : k + (1 << 16)])], ["lang", "term", "n"])

    rows = texts.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


class Vocabulary:
    """An automaton over padded terms, and which of them each language keeps."""

    def __init__(self, kept: pa.Table) -> None:
        """kept: lang, term, bucket. Terms stay an Arrow array, in order; their places are the automaton's values."""
        terms = pc.unique(kept.column("term"))
        self.terms = terms.take(pc.sort_indices(terms))
        at = pc.index_in(kept.column("term"), value_set=self.terms).to_numpy()
        langs, buckets = pa.chunked_array(kept.column("lang").chunks, pa.string()).combine_chunks(), kept.column("bucket").to_numpy()
        self.number: dict[str, np.ndarray] = {}
        self.buckets: dict[str, np.ndarray] = {}
        for lang in pc.unique(langs).to_pylist():
            own = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
            own = own[np.argsort(at[own])]
            self.number[lang], self.buckets[lang] = at[own], buckets[own]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(self.terms):
            self.automaton.add_word(f" {term.as_py()} ", k)
        if len(self.terms):
            self.automaton.make_automaton()

    def found(self, text: str | None) -> np.ndarray:
        """The numbers of the terms that the text holds, one for each occurrence."""
        padded = f" {b' '.join(terms_of(text)).decode()} "
        return np.fromiter((k for _, k in self.automaton.iter(padded)), np.int64) if len(self.terms) else np.empty(0, np.int64)


#: The last vocabulary of each worker process, by its number, so that it is made once.
_built: dict[int, Vocabulary] = {}


def _built_from(shared: Broadcast, number: int) -> Vocabulary:
    if number not in _built:
        _built.clear()
        _built[number] = Vocabulary(shared.value)
    return _built[number]


POSTINGS = "lang string, bucket int, source string, terms string, counts binary"


def recounted(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """POSTINGS of each task: the terms of a bucket (joined by spaces) that stand in a source's texts, and how often (64-bit)."""
    number = uuid.uuid4().int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _built_from(shared, number)
        groups: dict[tuple[str, str], int] = {}
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        parts: list[np.ndarray] = []
        size, width = 0, max(1, len(known.terms))

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(parts) if parts else keys[:0], return_counts=True)
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([counts, n]))
            return both, total

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if lang not in known.number:
                    continue
                group = groups.setdefault((lang, source), len(groups))
                found = known.found(text.as_py())
                parts.append(found + group * width)
                size += len(found)
                if size > HELD_WORDS:
                    keys, counts = merged()
                    parts, size = [], 0
                    if len(keys) > 4 * HELD_TERMS:
                        yield from given(known, groups, keys, counts)
                        groups, keys, counts = {}, keys[:0], counts[:0]
        keys, counts = merged()
        yield from given(known, groups, keys, counts)
        pa.default_memory_pool().release_unused()

    def given(known: Vocabulary, groups: dict, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        width = max(1, len(known.terms))
        edges = np.searchsorted(keys, np.arange(len(groups) + 1) * width)
        for (lang, source), k in groups.items():
            own, n = keys[edges[k] : edges[k + 1]] - k * width, counts[edges[k] : edges[k + 1]]
            numbers = known.number[lang]
            at = np.minimum(np.searchsorted(numbers, own), len(numbers) - 1)
            kept = numbers[at] == own
            own, n, bucket = own[kept], n[kept], known.buckets[lang][at[kept]]
            if not len(own):
                continue
            order = np.argsort(bucket, kind="stable")
            own, n, bucket = own[order], n[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = [(bucket[a], " ".join(known.terms.take(pa.array(own[a:b])).to_pylist()), n[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True)]
            for j in range(0, len(rows), 1024):
                buckets, terms, packed = zip(*rows[j : j + 1024], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(buckets, pa.int32()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(packed, pa.binary())], ["lang", "bucket", "source", "terms", "counts"])

    return texts.mapInArrow(run, POSTINGS)


def by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows that agree in their first width columns, each row as a dict."""
    rows = (dict(zip(batch.schema.names, row, strict=True)) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held: list[dict] = []
    for row in rows:
        if held and list(row.values())[:width] != list(held[0].values())[:width]:
            yield tuple(held[0].values())[:width], held
            held = []
        held.append(row)
    if held:
        yield tuple(held[0].values())[:width], held


def summed(postings: DataFrame) -> DataFrame:
    """POSTINGS with one row for each lang, bucket and source, and total, the sum of its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, Counter()
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            for lang, bucket, source, terms, counts in rows:
                if last != (lang, bucket, source):
                    if last is not None:
                        yield row(last, own)
                    last, own = (lang, bucket, source), Counter()
                for term, n in zip(terms.split(" "), np.frombuffer(counts, np.int64).tolist(), strict=True):
                    own[term] += n
        if last is not None:
            yield row(last, own)

    def row(key: tuple, own: Counter) -> pa.RecordBatch:
        terms = sorted(own)
        counts = np.fromiter((own[t] for t in terms), np.int64, len(terms))
        return pa.RecordBatch.from_pydict({"lang": [key[0]], "bucket": pa.array([key[1]], pa.int32()), "source": [key[2]], "terms": [" ".join(terms)], "counts": [counts.tobytes()], "total": [int(counts.sum())]})

    return postings.repartition("lang", "bucket", "source").sortWithinPartitions("lang", "bucket", "source").mapInArrow(run, POSTINGS + ", total long")


def chances(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 + SCALE * (count + 1) div below, exact at any size."""
    if counts.size and int(counts.max()) > 9 * 10**9 - 2:
        return (1 + SCALE * (counts.astype(object) + 1) // below.astype(object)).astype(np.int64)
    return 1 + SCALE * (counts + 1) // below


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def measured(units: DataFrame, ranks: int = TERM_RANKS) -> DataFrame:
    """units: lang, bucket, tile, source, own (whether the source belongs to the tile), below and whole (what the counts of the
    source and of the language are divided by), terms, counts (null if the source has none), for all sources of a language.

    Returns part, lang, source, item, value: pairs' sums over a task's terms, and each source's best terms of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        best: dict[str, list] = {}
        names, tile_names, last = [], [], None
        for (lang, _, tile), rows in by_key(batches, 3):
            if last != (lang, tile):
                yield from given(last, names, tile_names, sums, best)
                sums, best, last = {}, {}, (lang, tile)
                names = [r["source"] for r in rows]
                tile_names = [r["source"] for r in rows if r["own"]]
            terms = sorted({t for r in rows if r["terms"] for t in r["terms"].split(" ")})
            number = {t: k for k, t in enumerate(terms)}
            counts = np.zeros((len(rows), len(terms)), np.int64)
            for k, r in enumerate(rows):
                if r["terms"]:
                    counts[k, [number[t] for t in r["terms"].split(" ")]] = np.frombuffer(r["counts"], np.int64)
            below = np.array([r["below"] for r in rows], np.int64)
            p = chances(counts, below[:, None])
            q = chances(counts.sum(axis=0), np.array([rows[0]["whole"]], np.int64))
            for k, r in enumerate(rows):
                if not r["own"]:
                    continue
                value = sum(gap(p[k, j : j + 4096], p[:, j : j + 4096]).sum(axis=1) for j in range(0, len(terms), 4096))
                sums[r["source"]] = sums.get(r["source"], 0) + value
                high = np.flatnonzero((counts[k] > 0) & (p[k] > q))
                own = best.setdefault(r["source"], [])
                own += zip((-gap(p[k, high], q[high])).tolist(), [terms[j] for j in high], strict=True)
                if len(own) > 4 * ranks:  # code points and UTF-8 bytes are in the same order
                    best[r["source"]] = heapq.nsmallest(ranks, own)
        yield from given(last, names, tile_names, sums, best)

    def given(last: tuple | None, names: list, tile_names: list, sums: dict, best: dict) -> Iterator[pa.RecordBatch]:
        for source in tile_names:
            rows = [("pair", item, value) for item, value in zip(names, sums[source].tolist(), strict=True) if item != source]
            rows += [("term", item, -value) for value, item in heapq.nsmallest(ranks, best[source])]
            for k in range(0, len(rows), 1 << 14):
                parts, items, values = zip(*rows[k : k + (1 << 14)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array([last[0]] * len(parts)), pa.array([source] * len(parts)), pa.array(items), pa.array(values, pa.int64())], ["part", "lang", "source", "item", "value"])

    keys = ["lang", "tile", "bucket"]
    rows = units.repartition(*keys).sortWithinPartitions(*keys, "source")
    return rows.select("lang", "bucket", "tile", "source", "own", "below", "whole", "terms", "counts").mapInArrow(run, "part string, lang string, source string, item string, value long")


def _counted(texts: DataFrame, kept: DataFrame, slices: int) -> DataFrame:
    """summed postings of all kept terms, one automaton after the other."""
    spark, found = texts.sparkSession, None
    for k in range(slices):
        shared = spark.sparkContext.broadcast(kept.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == k).toArrow())
        part = checkpointed(summed(recounted(texts, shared)))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    # a bucket's terms may come from several automata
    return found if slices == 1 else checkpointed(summed(found.drop("total")))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank of all sources of docs (lang, source, text; further columns are ignored).

    Null lang, source and text are ''. Terms are runs of letters and characters beyond ASCII, lower-cased A-Z. A language
    keeps the terms in least of its documents or more. Part pair: for each other source of the language, the gaps of all kept
    terms summed, ranked from the largest. Part term: the kept terms that the source has more of than its language, by their
    gap, to rank ranks. Equal values rank by the item. A source without terms has a row for each pair all the same, and so has
    each source of a language that keeps none (value 0). Repeated rows count each time; an empty table gives no rows. All
    arithmetic is on whole numbers.
    """
    texts = _texts(docs)
    groups = checkpointed(texts.select("lang", "source").distinct())
    kept = checkpointed(kept_terms(texts, least))
    kinds = checkpointed(kept.groupBy("lang").agg(F.count("*").alias("kinds")))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(1, min(BUCKET_TERMS, BUCKET_CELLS // most))
    kept = checkpointed(kept.join(kinds, "lang").select("lang", "term", F.pmod(F.xxhash64("term"), F.ceil(F.col("kinds") / width)).cast("int").alias("bucket")))
    held = kept.select("term").distinct().agg(F.sum(F.octet_length("term"))).first()[0] or 0
    counts = _counted(texts, kept, max(1, -(-held // AUTOMATON_BYTES)))
    own = counts.groupBy("lang", "source").agg(F.sum("total").alias("n"))
    sides = groups.join(own, ["lang", "source"], "left").join(kinds, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.lit(0)).alias("kinds"))
    whole = sides.groupBy("lang").agg((F.sum("n") + F.first("kinds")).alias("whole"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    sides = checkpointed(sides.join(whole, "lang").withColumn("below", F.col("n") + F.col("kinds")))
    spread = sides.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("own", F.pmod(F.xxhash64("source"), F.col("tiles")) == F.col("tile"))
    units = spread.join(kept.select("lang", "bucket").distinct(), "lang").join(counts.drop("total"), ["lang", "bucket", "source"], "left")
    found = checkpointed(measured(units, ranks))
    other = sides.select("lang", F.col("source").alias("item"))
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sides.select("lang", "source").join(other, "lang").where("source != item").join(sums, ["lang", "source", "item"], "left")
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))
    terms = ranked(found.where("part = 'term'").select("lang", "source", "part", "item", "value")).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms)


def ranked(rows: DataFrame) -> DataFrame:
    order: list[Column] = [F.desc("value"), F.asc("item")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT + coalesce(any_value(v.v), 0) AS below FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v ON v.lang = g.lang GROUP BY 1, 2),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
t AS (SELECT l.lang, sum(l.n)::HUGEINT + any_value(v.v) AS below FROM l JOIN v USING (lang) GROUP BY 1),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // s.below AS p FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n + 1)) // t.below AS q FROM l JOIN t USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
