"""Ranked lexical search by variable-block-max WAND.

Documents become vectors of the queries' terms once; the collection's counts come from these. A task deals its documents out in
shards of bounded size. In a shard each term has a list of postings, cut into blocks of varying length: dynamic programming
chooses the ends so that what the blocks' maxima claim beyond the postings' own values, and a fixed cost for each block, is
least. A query is answered range by range, ranges being what lies between the block ends of its terms: where the maxima of the
blocks add up to less than the score of the k-th best so far, the range is skipped. In the others pivots are chosen: the terms of
the least maxima that together stay below that score can't carry a document alone, so only documents of the other terms are
looked up and scored, exactly. The score to reach starts from what k documents reach by one term alone; the best of a task's
former shards raise it for the next ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import checkpointed, sliced, table
from colloquy.llm.decontaminate import folded

#: Results of a query.
BEST = 10
#: Postings of a shard; a document with more is a shard of its own.
SHARD_POSTINGS = 1 << 21
#: Terms (with repeats) of the queries that are answered in one pass.
PASS_TERMS = 1 << 20
#: What a block costs, in units of a posting's value (up to 1000000); the longest block; postings of a list whose blocks are chosen together.
BLOCK_COST, BLOCK_POSTINGS, SEGMENT = 2_000_000, 128, 4096
#: Ranges that are looked at first and by how much more each time.
FIRST_RANGES, MORE = 64, 4
#: Maxima of blocks that are held at once.
CLAIMS = 1 << 21

VECTOR = "doc_id long, n long, terms array<int>, counts array<int>"


def block_ends(values: np.ndarray, starts: np.ndarray, cost: int = BLOCK_COST, longest: int = BLOCK_POSTINGS, segment: int = SEGMENT) -> np.ndarray:
    """Ends (exclusive, ascending) of the blocks of lists of values, list k going from starts[k] to starts[k + 1].

    The sum over blocks of length times largest value, plus cost for each block, is least among blocks of at most longest
    values. All lists are worked out side by side, place by place; one longer than segment in several pieces.
    """
    edges = np.unique(np.concatenate([starts, *(np.arange(a, b, segment) for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > segment)])).astype(np.int64)
    edges = edges[np.concatenate([np.diff(edges) > 0, [True]])]
    begin, length = edges[:-1], np.diff(edges)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    lists, places = len(begin), int(length[0]) if len(begin) else 0
    active = np.searchsorted(-length, -np.arange(places), side="left")  # lists longer than j
    window = min(longest, max(1, places))
    largest, before = np.zeros((window, lists), np.int64), np.zeros((window, lists), np.int64)
    least = np.zeros(lists, np.int64)
    taken = np.zeros(len(values), np.int32)  # length of the last block of the best cut up to here
    for j in range(places):
        a, slot, rows = active[j], j % window, min(j + 1, window)
        at = begin[:a] + j
        before[slot, :a], largest[slot, :a] = least[:a], 0
        np.maximum(largest[:rows, :a], values[at], out=largest[:rows, :a])
        long = (slot - np.arange(rows)) % window + 1
        total = largest[:rows, :a] * long[:, None]
        total += before[:rows, :a]
        best = total.argmin(axis=0)
        least[:a] = total[best, np.arange(a)] + cost
        taken[at] = long[best]
    ends, at = [], begin + length
    while len(at):  # from the last block of each piece to its first
        ends.append(at)
        at = at - taken[at - 1]
        left = at > begin
        at, begin = at[left], begin[left]
    return np.unique(np.concatenate(ends)) if ends else np.empty(0, np.int64)


class Shard:
    """Postings of some documents by term, in blocks with their largest values."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, values: np.ndarray, k: int) -> None:
        """A posting each: the term, the document (a number, ascending within a term), the value that its weight is multiplied with. k: results of a query."""
        self.terms, first = np.unique(terms, return_index=True)
        self.docs, self.values = docs, values
        starts = np.append(first, len(terms)).astype(np.int64)
        ends = block_ends(values, starts)
        self.most = np.maximum.reduceat(values, np.concatenate([[0], ends[:-1]])) if len(ends) else values[:0]
        self.last = docs[ends - 1] if len(ends) else docs[:0]
        self.starts, self.blocks = starts, np.concatenate([[0], np.searchsorted(ends, starts[1:], side="right")])
        # k documents reach a list's k-th value with this term alone
        self.reached = np.array([np.partition(values[a:b], -k)[-k] if b - a >= k else 0 for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], np.int64)

    def answer(self, terms: np.ndarray, weights: np.ndarray, top: Best) -> tuple[int, int]:
        """Offers documents to top, which knows the score to reach; returns how many were scored, and how many hold a term."""
        at = np.searchsorted(self.terms, terms)
        own = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        at, weights = at[own], weights[own]
        if not len(at):
            return 0, 0
        spans = [slice(self.blocks[k], self.blocks[k + 1]) for k in at]
        edges = np.unique(np.concatenate([self.last[s] for s in spans]))
        claim = lambda k, to: np.append(self.most[spans[k]] * weights[k], 0)[np.searchsorted(self.last[spans[k]], to)]
        bounds = np.zeros(len(edges), np.int64)
        for k in range(len(at)):
            bounds += claim(k, edges)
        start = max(1, int((self.reached[at] * weights).max()))
        waiting, scored, take = np.argsort(-bounds, kind="stable"), 0, FIRST_RANGES
        while len(waiting) and bounds[waiting[0]] >= (bar := max(start, top.bar)):
            now, waiting, take = waiting[:take], waiting[take:], max(FIRST_RANGES, min(take * MORE, CLAIMS // len(at)))
            now = np.sort(now[bounds[now] >= bar])
            scored += self._scored(at, weights, edges, np.stack([claim(k, edges[now]) for k in range(len(at))]), now, bar, top)
        return scored, sum(int(self.starts[k + 1] - self.starts[k]) for k in at)

    def _scored(self, at: np.ndarray, weights: np.ndarray, edges: np.ndarray, claims: np.ndarray, ranges: np.ndarray, bar: int, top: Best) -> int:
        order = np.argsort(claims, axis=0, kind="stable")
        reach = np.cumsum(np.take_along_axis(claims, order, axis=0), axis=0) >= bar
        pivot = np.empty(claims.shape, bool)
        np.put_along_axis(pivot, order, reach, axis=0)
        low = np.where(ranges > 0, edges[ranges - 1] + 1, 0)
        found = []
        for row, k in enumerate(at):
            docs = self.docs[self.starts[k] : self.starts[k + 1]]
            mine = np.flatnonzero(pivot[row])
            a, b = np.searchsorted(docs, low[mine]), np.searchsorted(docs, edges[ranges[mine]], side="right")
            n = b - a
            found.append(docs[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        docs = np.unique(np.concatenate(found))
        if not len(docs):
            return 0
        scores = np.zeros(len(docs), np.int64)
        for k, w in zip(at, weights.tolist(), strict=True):
            own = self.docs[self.starts[k] : self.starts[k + 1]]
            place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            hit = own[place] == docs
            scores[hit] += w * self.values[self.starts[k] : self.starts[k + 1]][place[hit]]
        top.offer(docs, scores)
        return len(docs)


class Best:
    """The k best scores above 0 so far, equal ones by ascending id, those without an id last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.missing, self.bar = k, *(np.empty(0, kind) for kind in (np.int64, np.int64, bool)), 0
        self.known: tuple[np.ndarray, np.ndarray] | None = None

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= max(1, self.bar)
        ids, missing = (x[docs[keep]] for x in self.known)
        scores, ids, missing = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids]), np.concatenate([self.missing, missing])
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]
        self.bar = int(self.scores[-1]) if len(order) == self.k else 0


def vectors(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """VECTOR of each row of docs (doc_id, text): the number of its terms, and those of the vocabulary (a dict of numbers) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            texts = batch.column(1)
            for a, b in sliced(texts):
                sizes, terms, counts, lengths = [], [], [], [0]
                for k in range(a, b):
                    words = folded(texts[k].as_py())
                    own = np.fromiter((x for x in map(number, words) if x is not None), np.int32)
                    own, n = np.unique(own, return_counts=True)
                    sizes.append(len(words)), terms.append(own), counts.append(n.astype(np.int32)), lengths.append(lengths[-1] + len(own))
                at = pa.array(lengths, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), pa.int32())) for x in (terms, counts))], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, VECTOR)


def answered(found: DataFrame, queries: Broadcast, documents: int, terms: int, k: int) -> DataFrame:
    """found: VECTOR rows. queries: for each its key, terms and weights as arrays. Returns query, doc_id, score: the k best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Best(k) for _ in queries.value]
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            start = 0
            for row, n in enumerate(sizes.tolist()):
                if size and size + n > SHARD_POSTINGS:
                    searched([*held, batch.slice(start, row - start)], tops)
                    held, size, start = [], 0, row
                size += n
            held.append(batch.slice(start))
        if held:
            searched(held, tops)
        for (query, _, _), top in zip(queries.value, tops, strict=True):
            if len(top.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.scores), query, np.int64)), pa.array(top.ids, mask=top.missing), pa.array(top.scores)], ["query", "doc_id", "score"])

    def searched(rows: list[pa.RecordBatch], tops: list[Best]) -> None:
        whole = pa.Table.from_batches(rows).combine_chunks()
        if not whole.num_rows:
            return
        ids = whole.column("doc_id").combine_chunks()
        known = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        listed = whole.column("terms").combine_chunks()
        lengths = listed.value_lengths().to_numpy()
        own = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        number, tf = listed.flatten().to_numpy(), whole.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        if not len(number):
            return
        m = norms(whole.column("n").to_numpy(), documents, terms)
        order = np.argsort(number, kind="stable")
        value = 1_000_000_000 * tf // (1000 * tf + 8 * m[own])
        shard = Shard(number[order], own[order], value[order], k)
        for top, (_, own_terms, weights) in zip(tops, queries.value, strict=True):
            top.known = known
            shard.answer(own_terms, weights, top)

    return found.mapInArrow(run, "query long, doc_id long, score long")


def norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """25 + 75 * n * documents div terms, exact at any size."""
    if n.size and 75 * int(n.max()) * documents >= 1 << 63:
        return (25 + 75 * n.astype(object) * documents // terms).astype(np.int64)
    return 25 + 75 * n * documents // terms


def weight(documents: int, holding: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * holding + 1)))


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    """query (a number for each row of queries), item_id, rank, doc_id, score: the k best of docs (doc_id, text) for each query (item_id, text).

    Terms are runs of digits, letters and characters beyond ASCII, lower-cased A-Z. Scores are whole numbers; only those above
    0 rank, equal ones by ascending doc_id. Null and empty texts have no terms. Rows of docs with one doc_id rank each on their
    own; a row without one ranks behind its equals. Each row of queries is answered, whatever its item_id; without a term of
    the documents it has no rows. Empty tables give none. Queries beyond PASS_TERMS terms are answered in several passes.
    """
    items = checkpointed(queries.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")))
    spark = docs.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // (6 * PASS_TERMS)))  # a term and what parts it take some six bytes
    found = None
    for j in range(passes):
        rows = [(r.query, folded(r.text)) for r in items.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == j).toLocalIterator()]
        names = sorted({t for _, own in rows for t in own})
        vocabulary = spark.sparkContext.broadcast({t: n for n, t in enumerate(names)})
        held = checkpointed(vectors(docs, vocabulary))
        vocabulary.destroy()
        documents, terms = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = {r.term: r["count"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator()}
        number, asked = {t: n for n, t in enumerate(names)}, []
        for key, own in rows:
            distinct, repeats = np.unique(np.array([number[t] for t in own if number[t] in holding], np.int32), return_counts=True)
            asked.append((key, distinct, np.array([weight(documents, holding[t]) for t in distinct.tolist()], np.int64) * repeats))
        shared = spark.sparkContext.broadcast(asked)
        part = answered(held, shared, documents, terms, k)
        # what tasks give is cut in two steps, so that one query's rows of many tasks don't meet in one
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = part.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("query", "share").orderBy(*order))).where(F.col("rank") <= k)
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        part = checkpointed(part.select("query", "rank", "doc_id", "score"))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.join(items.select("query", "item_id"), "query").select("query", "item_id", "rank", "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("query")


OP11_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (len(t) > 0) AS nd, sum(len(t))::BIGINT AS nt FROM d),
p AS (SELECT doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) SEMI JOIN b USING (term) GROUP BY doc_id, len(t), term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
c AS (SELECT doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))) AS v FROM p JOIN w USING (term), s),
q AS (SELECT item_id, term, count(*) AS r FROM b GROUP BY 1, 2),
x AS (SELECT item_id, doc_id, sum(r * v)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY 1, 2)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""
