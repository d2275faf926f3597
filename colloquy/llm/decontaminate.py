"""Benchmark passages in training documents: a broadcast hash set of the items' word windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from colloquy.llm.common import Hashes, checkpointed, sliced, table, window_hashes, word_hashes

WIDTH = 13
#: Bytes of windows that are broadcast at once; a larger benchmark is searched in several passes over the documents.
BROADCAST_BYTES = 96 << 20
#: What a window takes beside its words and its items' ids.
WINDOW_BYTES = 24

#: A-Z to a-z; other ASCII but digits and letters separates words; bytes of further letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


#: A word in folded bytes.
RUN_OF_WORD = re.compile(rb"[^ ]+")


def folded(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def text_digest(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode(), digest_size=16).digest()


class Windows:
    """Windows of the items in flat arrays, sorted by width and hash, with their words, so that a hit can be verified."""

    def __init__(self, rows: pa.Table) -> None:
        """rows: width, hash, words, items (ids, none of them null)."""
        width, hashes = rows.column("width").to_numpy(), rows.column("hash").to_numpy().view(np.uint64)
        order = np.lexsort((hashes, width))
        rows = rows.take(pa.array(order)).combine_chunks()
        # the columns of an empty table have no chunk
        words, items = (pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("words", "items"))
        self.words, self.word_ends = b"".join(map(bytes, (x.as_buffer() for x in words))), np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.items, self.item_ends = items.flatten().to_numpy(), np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        self.hashes = hashes[order]
        #: Width, first and last (exclusive) window of it.
        self.widths = [(int(n), *np.searchsorted(width[order], [n, n + 1]).tolist()) for n in np.unique(width)]

    def equal(self, k: int, words: bytes) -> bool:
        return self.words[self.word_ends[k - 1] if k else 0 : self.word_ends[k]] == words

    def own(self, k: int) -> list[int]:
        return self.items[self.item_ends[k - 1] if k else 0 : self.item_ends[k]].tolist()


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """width, hash, words, items (ids) of each different window of width words; an item of fewer, but not none, is one window. Null: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = folded(text)
                if words:
                    n = min(width, len(words))
                    first = {b" ".join(words[k : k + n]): k for k in range(len(words) - n, -1, -1)}
                    found = window_hashes(word_hashes(words, cache), n)[list(first.values())].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(first), pa.int64()), pa.array([n] * len(first), pa.int32()), pa.array(found), pa.array(list(first), pa.binary())], ["item_id", "width", "hash", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, width int, hash long, words binary")
    return rows.groupBy("width", "hash", "words").agg(F.collect_set("item_id").alias("items"))


def hit_words(words: list[bytes], hashes: np.ndarray, windows: Windows) -> tuple[np.ndarray, set]:
    """Which words stand in a window of an item, and the items."""
    hit, items = np.zeros(len(words), bool), set()
    for n, first, last in windows.widths:
        wanted, found = windows.hashes[first:last], window_hashes(hashes, n)
        at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
        for k in np.flatnonzero(wanted[at] == found):
            own, e = b" ".join(words[k : k + n]), int(at[k])
            while e < len(wanted) and wanted[e] == found[k]:  # windows of one hash stand side by side
                if windows.equal(first + e, own):
                    hit[k : k + n] = True
                    items.update(windows.own(first + e))
                e += 1
    return hit, items


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item_id, ascending), of every row.

    Words are runs of digits, letters and characters beyond ASCII, lower-cased A-Z. A word is hit if it stands in a window of
    an item. Hits of the hash set are compared word by word. Null and empty texts have no words; items without words have
    no windows. An item whose id is null has windows like any other, but no place in the list of items. Rows with one doc_id,
    null included, are each judged on their own text. An empty table gives no rows, an empty benchmark no hits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, slices = _windows(benchmark, width)
    if slices == 1:
        return _marked(docs, _shared(found)).select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "items")
    # the same rows in each pass, known by what they hold; repeats have the same marks
    key = ["doc_id", "digest", "n_words"]
    merged, first = None, None
    for part in _in_passes(docs, found, slices):
        first = part if first is None else first
        merged = part if merged is None else merged.unionByName(part)
    counted = first.groupBy(*key).count()
    merged = merged.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_set("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    same = [merged[c].eqNullSafe(counted[c]) for c in key]
    rows = merged.join(counted, same).select(merged["doc_id"], merged["n_words"], F.size("hit").cast("long").alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    return rows.drop("copy")


def _windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The windows of all items, and in how many slices they are searched."""
    found = checkpointed(item_windows(benchmark, width))
    size = found.agg(F.coalesce(F.sum(F.octet_length("words") + 8 * F.size("items") + WINDOW_BYTES), F.lit(0))).first()[0]
    return found, max(1, -(-size // BROADCAST_BYTES))


def _shared(windows: DataFrame) -> Broadcast:
    """windows: of no more than about BROADCAST_BYTES."""
    return windows.sparkSession.sparkContext.broadcast(Windows(windows.toArrow()))


def _in_passes(docs: DataFrame, found: DataFrame, slices: int) -> Iterator[DataFrame]:
    """_marked for each slice of the windows, one after the other: a slice's broadcast goes before the next one is made."""
    for k in range(slices):
        shared = _shared(found.where(F.pmod(F.xxhash64("words"), F.lit(slices)) == k))
        marked = checkpointed(_marked(docs, shared))
        shared.destroy()
        yield marked


def _marked(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, digest, n_words, hit (positions), items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, cache = shared.value, Hashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in sliced(texts):
                digests, counts, hits, items = [], [], [], []
                for text in texts[a:b]:
                    words = folded(text)
                    hit, own = hit_words(words, word_hashes(words, cache), wanted)
                    digests.append(text_digest(text))
                    counts.append(len(words)), hits.append(np.flatnonzero(hit).astype(np.int32)), items.append(sorted(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "digest", "n_words", "hit", "items"])

    return docs.mapInArrow(run, "doc_id long, digest binary, n_words long, hit array<int>, items array<long>")


def is_contaminated():
    """More than none, and at least a twentieth, of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_words(text: str, hit: np.ndarray) -> str:
    """The text without the words that are hit (by position), each with what stands between it and the next word."""
    data = text.encode()
    spans = [m.span() for m in RUN_OF_WORD.finditer(data.translate(FOLD))]
    kept, at = [], 0
    for k in np.flatnonzero(hit):
        kept.append(data[at : max(at, spans[k][0])])
        at = spans[k + 1][0] if k + 1 < len(spans) else spans[k][1]
    return b"".join([*kept, data[at:]]).decode()


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; words of theirs that are hit go from the text.

    A row's verdict and spans depend on its text alone, however many passes the benchmark takes: null, repeated and clashing
    doc_ids make no difference. Null and empty texts stay as they are. A text that loses words has its length in n_chars, if
    docs has such a column. An empty table gives no rows; an empty benchmark changes nothing.
    """
    found, slices = _windows(benchmark, width)
    column, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cleaned(batch: pa.RecordBatch, hits: Iterator[np.ndarray | None], width: int) -> pa.RecordBatch:
        """hits: for each row which words are hit, None if none; width: columns that are given back."""
        keep, texts, sizes = [], [], []
        for k, hit in enumerate(hits):
            text = batch.column(column)[k].as_py()
            keep.append(hit is None or 20 * int(hit.sum()) < len(hit))
            changed = hit is not None and keep[-1]
            texts.append(without_words(text, hit) if changed else text)
            if size is not None:
                sizes.append(len(texts[-1]) if changed else batch.column(size)[k].as_py())
        columns = list(batch.columns[:width])
        columns[column] = pa.array(texts, columns[column].type)
        if size is not None:
            columns[size] = pa.array(sizes, columns[size].type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names[:width]).filter(pa.array(keep, pa.bool_()))

    if slices == 1:
        shared = _shared(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, cache = shared.value, Hashes()

            def hits(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
                for value in batch.column(column):
                    words = folded(value.as_py())
                    hit = hit_words(words, word_hashes(words, cache), wanted)[0]
                    yield hit if hit.any() else None

            for batch in batches:
                yield cleaned(batch, hits(batch), batch.num_columns)

        return docs.mapInArrow(run, docs.schema)

    # rows are known by the digest of their text
    name, places = "digest of the text", "hit words of the text"
    merged = None
    for part in _in_passes(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), found, slices):
        part = part.where(F.size("hit") > 0).select("digest", "hit")
        merged = part if merged is None else merged.unionByName(part)
    marks = merged.groupBy(F.col("digest").alias(name)).agg(F.array_distinct(F.flatten(F.collect_set("hit"))).alias(places))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([text_digest(x.as_py()) for x in batch.column(column)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, name])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hits(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
            for value, at in zip(batch.column(column), batch.column(batch.num_columns - 1), strict=True):
                if at.is_valid:
                    hit = np.zeros(len(folded(value.as_py())), bool)
                    hit[at.values.to_numpy()] = True
                yield hit if at.is_valid else None

        for batch in batches:
            yield cleaned(batch, hits(batch), batch.num_columns - 1)

    known = docs.mapInArrow(digests, StructType([*docs.schema.fields, StructField(name, BinaryType())])).join(marks, name, "left")
    return known.select(*docs.columns, places).mapInArrow(marked, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


OP10_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM k),
s AS (SELECT DISTINCT n FROM i),
o AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, s WHERE len(w) >= n),
h AS (SELECT o.doc_id, o.p, i.n, i.item_id FROM (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win FROM o) o JOIN i ON o.n = i.n AND o.win = i.win),
t AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(t.n_hit, 0)::BIGINT AS n_hit, coalesce(x.n_items, 0)::BIGINT AS n_items, sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(t.n_hit, 0) > 0 AND 20 * coalesce(t.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)
"""
