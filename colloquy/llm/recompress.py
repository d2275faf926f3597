"""Repeated passages found by recompression.

A document's words are symbols. One round names maximal runs of a symbol, the following ones name pairs: a hash of the
symbol and the round deals each symbol to the left or the right class, and a left symbol followed by a right one becomes a
new symbol. Names are hashes of what is named, so all tasks give equal strings equal names without a shared dictionary.
Each symbol carries its context: the words that are enough to parse it this way whatever surrounds them. A symbol whose
context lies within a window of words stands in every occurrence of that window, so each window is known by the best symbol
that it determines (longest context first, then least name). A window that occurs in two documents has the same best symbol
in both: symbols that occur in one document only rule out their windows, the windows of the others are compared by hashes
over all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import Hashes, mixed, sliced, table, window_hashes, word_hashes

WIDTH = 13
PAIR_ROUNDS = 4
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Symbols are shuffled by their upper 48 bits: two that agree by chance only add windows to compare.
SHORT = np.uint64(16)


def parse(words: np.ndarray, starts: np.ndarray, width: int, rounds: int = PAIR_ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """words: hashes of the words of some documents, which begin at starts. Yields names, lo, hi of the symbols of each level whose context [lo, hi) is within width words of one document."""
    n = len(words)
    index = np.arange(n, dtype=np.int32)
    yield mixed(words), index, index + 1
    if n < 2:
        return
    edge = np.zeros(n + 1, bool)  # a document begins here, so nothing spans it
    edge[starts] = edge[n] = True
    # runs: their ends are seen by the neighbours' words; at a document's edge they can't be known from its words
    begin = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | edge[1:n]]))
    end = np.append(begin[1:], n)
    name = words[begin] + mixed((end - begin).astype(np.uint64))
    before, after = np.int32(-(width + 1)), np.int32(n + width + 1)
    first, last = edge[begin], edge[end]  # of its document
    lo = np.where(first, before, (begin - 1).astype(np.int32))
    hi = np.where(last, after, (end + 1).astype(np.int32))
    for level in range(1, rounds + 2):
        fit = np.flatnonzero(hi - lo <= width)
        yield mixed(name[fit]), lo[fit], hi[fit]
        if level > rounds or len(name) < 2:
            return
        left = mixed(name + np.uint64(level)) >> np.uint64(63) == 1
        at = np.flatnonzero(left[:-1] & ~left[1:] & ~last[:-1])
        # a symbol that stays must see the neighbour with which it could have merged
        new_lo, new_hi = lo.copy(), hi.copy()
        np.minimum(lo[1:], lo[:-1], out=new_lo[1:], where=~left[1:])
        np.maximum(hi[:-1], hi[1:], out=new_hi[:-1], where=left[:-1])
        new_hi[left & last] = after
        new_lo[~left & first] = before
        new_lo[at], new_hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        name[at] = name[at] * np.uint64(0xD6E8FEB86659FD93) + mixed(name[at + 1] + np.uint64(level))
        last[at] = last[at + 1]
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, lo, hi, first, last = name[keep], new_lo[keep], new_hi[keep], first[keep], last[keep]


#: Symbols with contexts of this many words or more are equally good; beyond it they only become more.
LONG = 8
#: Words that are parsed at a time, so that the arrays stay in a core's cache; a longer document is parsed whole.
PARSED_WORDS = 1 << 16


def best_symbols(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each position the best symbol that the window of width words from there determines; NONE where none begins."""
    out = np.full(len(words), NONE)
    cut = starts[np.flatnonzero(np.diff(starts // PARSED_WORDS, prepend=-1))] if len(starts) else starts
    for a, b in zip(cut, np.append(cut[1:], len(words)), strict=True):
        own = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
        if b - a >= width:
            out[a:b] = _best(words[a:b], own, width)
    return out


def _best(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    ranked = np.full((width + 1, n), NONE)  # by length of the context and where it begins
    flat = ranked.ravel()
    for name, lo, hi in parse(words, starts, width):
        np.minimum.at(flat, (hi - lo).astype(np.int64) * n + lo, name >> np.uint64(4) | (LONG - np.minimum(LONG, hi - lo)).astype(np.uint64) << np.uint64(60))
    best = ranked[1]  # windows of c words, c growing: their symbols are those of both windows of c - 1, and those of c
    for c in range(2, width + 1):
        best = np.minimum(best[:-1], best[1:])
        np.minimum(best, ranked[c, : len(best)], out=best)
    best = np.append(best, np.full(width - 1, NONE))
    best[across(n, starts, width)] = NONE
    return best


def across(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Whether a window that begins here leaves its document."""
    ends = np.append(starts[1:], n)
    return np.arange(n) + width > np.repeat(ends, ends - starts)


class Batch:
    """Words of some texts, one after the other."""

    def __init__(self, texts: list, cache: Hashes) -> None:
        self.words: list[bytes] = []
        begins = []
        for text in texts:
            begins.append(len(self.words))
            self.words += (text or "").encode().split()
        self.begins = np.array(begins + [len(self.words)])
        self.hashes = word_hashes(self.words, cache)
        self.starts = np.unique(self.begins[:-1][np.diff(self.begins) > 0])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begins) - 1), np.diff(self.begins))


def _documents_by(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the documents of each in ascending order, and where each value's begin."""
    order = np.argsort(values)
    values, docs = values[order], docs[order]
    again = values[1:] == values[:-1]
    some = np.flatnonzero(np.append(again, False) | np.concatenate([[False], again]))  # of values that occur again
    docs[some] = docs[some[np.lexsort((docs[some], values[some]))]]
    new = np.ones(len(values), bool)
    new[1:] = ~again | (docs[1:] != docs[:-1])
    values, docs = values[new], docs[new]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[begin], docs, np.append(begin, len(values))


ROWS = "value long, doc long, more array<long>"


def _rows(values: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """One row for each value, with its first document and any others, so that what many documents of a batch share is one row."""
    values, docs, begin = _documents_by(values, docs)
    first = np.zeros(len(docs), bool)
    first[begin[:-1]] = True
    others = np.diff(begin) - 1
    offsets = pa.array(np.concatenate([[0], np.cumsum(others)]), pa.int32())
    more = pa.ListArray.from_arrays(offsets, pa.array(docs[~first], pa.int64()), mask=pa.array(others == 0))
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(docs[first], pa.int64()), more], ["value", "doc", "more"])


def _shared(rows: DataFrame) -> DataFrame:
    """value, first, doc_id: those values that occur in two documents or more, with the smallest of them."""
    by_value = Window.partitionBy("value")
    last = F.coalesce(F.element_at("more", -1), "doc")
    seen = rows.withColumn("first", F.min("doc").over(by_value)).withColumn("last", F.max(last).over(by_value)).where("first < last")
    return seen.select("value", "first", F.explode(F.concat(F.array("doc"), F.coalesce("more", F.array().cast("array<long>")))).alias("doc_id"))


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text, is_first, windows: every row of docs; is_first is false for a text that a smaller doc_id has too, windows are the hashes of those of another's windows that also start in a smaller doc_id (null: none).

    Two shuffles carry symbols and window hashes (a row per value and batch, so a passage that a third of the documents hold
    is no hot row), and one deals the texts by doc_id; all passes over the texts use the latter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in batches:
            batch = batch.filter(batch.column(2))
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for a, b in sliced(texts):
                part = Batch(texts[a:b], cache)
                best = best_symbols(part.hashes, part.starts, width)
                at = np.flatnonzero(best != NONE)
                own = part.owner()[at]
                new = np.ones(len(at), bool)  # a run of one symbol needs one row in each document that it reaches into
                new[1:] = (best[at[1:]] != best[at[:-1]]) | (own[1:] != own[:-1])
                yield _rows(best[at[new]] >> SHORT, ids[a:b][own[new]])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column(2), batch.column(3).is_valid()))
            texts, ids, shared = batch.column(1).to_pylist(), batch.column(0).to_numpy(), batch.column(3)
            for a, b in sliced(texts):
                part = Batch(texts[a:b], cache)
                best = best_symbols(part.hashes, part.starts, width)
                wanted = np.zeros(len(best), bool)
                for k in range(a, b):
                    own = slice(part.begins[k - a], part.begins[k - a + 1])
                    wanted[own] = np.isin(best[own] >> SHORT, shared[k].values.to_numpy().view(np.uint64))
                at = np.flatnonzero(wanted & (best != NONE))
                yield _rows(window_hashes(part.hashes, width)[at], ids[a:b][part.owner()[at]])

    def by_document(values: DataFrame, name: str) -> DataFrame:
        """Dealt out first: a partial aggregate has nothing to combine here."""
        return values.select("doc_id", "value").repartition("doc_id").groupBy("doc_id").agg(F.collect_list("value").alias(name))

    # a text that a smaller document has too needs no search: all its windows stand there
    firsts = docs.where("doc_id is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct().withColumn("is_first", F.lit(True))
    # all joins keep all rows and rows are left out in the tasks, so that their exchange of the texts is one
    marked = docs.join(firsts, "doc_id", "left").select("doc_id", "text", F.coalesce("is_first", F.lit(False)).alias("is_first"))
    known = by_document(_shared(marked.mapInArrow(symbols, ROWS)), "symbols")
    found = _shared(marked.join(known, "doc_id", "left").select("doc_id", "text", "is_first", "symbols").mapInArrow(windows, ROWS))
    later = by_document(found.where("doc_id > first"), "windows")
    return marked.join(later, "doc_id", "left").select("doc_id", "text", (F.col("is_first") | F.col("doc_id").isNull()).alias("is_first"), "windows")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every row of docs with the words that stand in no window which also starts in a document with a smaller doc_id, joined by one space.

    Words are split at ASCII white space and compared unchanged. Null and empty texts have no words. A null doc_id is neither
    smaller nor larger than another, so its row keeps all words. Rows with one doc_id are parts of one document for this
    purpose: each loses what a smaller doc_id has, not what the other has.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in batches:
            texts, first, found = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for a, b in sliced(texts):
                counts, removed, out = [], [], []
                for k in range(a, b):
                    words = (texts[k] or "").encode().split()
                    counts.append(len(words))
                    if not first[k] and len(words) >= width:
                        words = []
                    elif found[k].is_valid:
                        own = window_hashes(word_hashes(words, cache), width)
                        hit = np.flatnonzero(np.isin(own, found[k].values.to_numpy().view(np.uint64)))
                        edges = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edges, hit, 1)
                        np.add.at(edges, hit + width, -1)
                        words = list(compress(words, np.cumsum(edges[:-1]) == 0))
                    removed.append(counts[-1] - len(words))
                    out.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return repeated_spans(docs, width).mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept string")


def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
n AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS win FROM k),
f AS (SELECT win, min(doc_id) AS first FROM n GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
h AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS pos FROM n JOIN f USING (win) WHERE n.doc_id > f.first),
r AS (SELECT doc_id, count(*) AS n_removed, list(pos) AS gone FROM h GROUP BY 1),
x AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n_removed, 0)::BIGINT AS n_removed, CASE WHEN r.gone IS NULL THEN d.w ELSE list_transform(list_filter(range(1, len(d.w) + 1), lambda i: NOT list_contains(r.gone, i)), lambda i: d.w[i]) END AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM x
"""
