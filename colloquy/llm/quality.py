"""Quality classifier: heuristic labellers, a label model over their votes, and a hashed linear scorer trained on its posteriors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import CACHE_ENTRIES, sliced, table
from colloquy.llm.labels import label_model

#: Documents on which the scorer is trained at most; everything else covers all documents.
TRAIN_DOCS = 6000
BITS = 16
#: Words of a block within which distinct words are counted.
BLOCK = 100
FUNCTION_WORDS = frozenset(b"the of and to in a is that it for on was be with as by at this an are or de la que el en los y se las un una del le et les des du est der die und das den von zu mit ist ein eine".split())
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"-()+@:;?")
CAPITALS = bytes(range(65, 91))
LOWER = bytes(range(97, 123))

LABELLERS = ("repetition", "variety", "symbols", "capitals", "word_length", "function_words", "sentence_ends", "length")


def measures(data: bytes, words: list[bytes]) -> dict[str, float]:
    n, size = len(words), max(1, len(data))
    capitals, lower = size - len(data.translate(None, CAPITALS)), size - len(data.translate(None, LOWER))
    blocks = [words[k : k + BLOCK] for k in range(0, n, BLOCK)]
    return {
        "repetition": sum(map(eq, words, words[1:])) / max(1, n),
        "variety": sum(len(set(x)) for x in blocks) / max(1, n),
        "symbols": (size - len(data.translate(None, SYMBOLS))) / size,
        "capitals": capitals / max(1, capitals + lower),
        "word_length": (size - n) / max(1, n),
        "function_words": sum(map(FUNCTION_WORDS.__contains__, words)) / max(1, n),
        "sentence_ends": len(ENDS.findall(data)) / max(1, n),
        "length": float(n),
    }


def votes(m: dict[str, float]) -> tuple:
    """1 good, 0 poor, None for no opinion; short texts say little, so most labellers abstain on them."""
    n = m["length"]
    if n < 8:
        return (*[None] * 7, 0 if n == 0 else None)
    between = lambda x, low, high: 1 if low <= x <= high else None
    return (
        0 if m["repetition"] > 0.15 else 1 if m["repetition"] < 0.04 else None,
        0 if m["variety"] < 0.4 else 1 if m["variety"] > 0.55 else None,
        0 if m["symbols"] > 0.05 else 1 if m["symbols"] < 0.01 else None,
        0 if m["capitals"] > 0.3 else 1 if m["capitals"] < 0.1 else None,
        0 if not 2 <= m["word_length"] <= 9 else between(m["word_length"], 3.5, 6.5),
        0 if m["function_words"] < 0.01 and n >= 30 else 1 if m["function_words"] > 0.08 else None,
        0 if m["sentence_ends"] > 0.6 or (n >= 200 and m["sentence_ends"] < 0.005) else between(m["sentence_ends"], 0.02, 0.35),
        1 if n >= 40 else None,
    )


#: Letters and digits by class; other characters stand as they are.
CLASSES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
RUNS = re.compile(rb"(.)\1\1+", re.DOTALL)
ENDS = re.compile(rb"[.!?](?=[\x09-\x0D\x20]|\Z)")


def shape(word: bytes) -> bytes:
    """The classes of a whole word's characters, runs shortened to two."""
    return RUNS.sub(rb"\1\1", word.translate(CLASSES))


class Slots(dict):
    """Word to the slots of its own feature and of its shape's."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= CACHE_ENTRIES // 8:
            self.clear()
        mask = (1 << BITS) - 1
        value = self[word] = (xxhash.xxh64_intdigest(word.lower(), 1) & mask, xxhash.xxh64_intdigest(shape(word), 2) & mask)
        return value


class WordWeights(dict):
    """Word to the sum of the weights of its features."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.slots = weights, Slots()

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_ENTRIES // 8:
            self.clear()
        own, form = self.slots.__missing__(word)
        value = float(self.weights[own] + self.weights[form])
        if len(word) <= 64:  # longer ones hardly come again
            self[word] = value
        return value


def step(name: str, x: float) -> int:
    """The measure's step of ten: tenths of shares, two letters of word length, powers of two of a number of words."""
    return min(9, int(np.log2(1 + x) if name == "length" else x / 2 if name == "word_length" else 10 * x))


@cache
def step_slot(name: str, k: int) -> int:
    return xxhash.xxh64_intdigest(f"{name}:{k}".encode(), 3) & ((1 << BITS) - 1)


def features(data: bytes, words: list[bytes], m: dict[str, float], slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values: shares of words and of shapes, and a flag for the decile of each measure."""
    found = np.array(list(map(slots.__getitem__, words)), np.int64).reshape(-1)
    at, counts = np.unique(found, return_counts=True)
    own = [step_slot(k, step(k, x)) for k, x in m.items()]
    return np.concatenate([at, own]), np.concatenate([counts / max(1, len(words)), np.full(len(own), 0.5)])


def logistic(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 8, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Weights and, last, the bias, by AdaGrad over soft labels in a fixed order."""
    weights, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    for k in range(rounds):
        for i in np.random.default_rng(k).permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            p = 1 / (1 + np.exp(-np.clip(weights[at] @ x, -40, 40)))
            gradient = (p - y) * x + decay * weights[at]
            seen[at] += gradient**2
            weights[at] -= rate * gradient / np.sqrt(seen[at])
    return weights


class Model:
    """posteriors: of vote patterns; weights: of the scorer."""

    def __init__(self, posteriors: dict[tuple, float], accuracies: list[dict], weights: np.ndarray) -> None:
        self.posteriors, self.accuracies, self.weights = posteriors, accuracies, weights

    def judge(self, text: str | None, known: WordWeights) -> tuple[float, float]:
        data = (text or "").encode()
        words = data.split()
        m = measures(data, words)
        score = sum(map(known.__getitem__, words)) / max(1, len(words)) + 0.5 * sum(self.weights[step_slot(k, step(k, x))] for k, x in m.items()) + self.weights[-1]
        return self.posteriors.get(votes(m), 0.5), float(1 / (1 + np.exp(-np.clip(score, -40, 40))))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, seed: int = 11) -> Model:
    """The label model counts the vote patterns of all documents; the scorer learns from the features of at most about train_docs of them, taken by a hash of their text."""
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0):
                data = (value.as_py() or "").encode()
                out.append("".join("-" if v is None else str(v) for v in votes(measures(data, data.split()))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["votes"])

    # three to the power of the labellers rows at most
    counted = {x.votes: x["count"] for x in texts.mapInArrow(patterns, "votes string").groupBy("votes").count().collect()}
    read = lambda s: tuple(None if c == "-" else int(c) for c in s)
    posteriors, accuracies = label_model({read(s): n for s, n in counted.items()}, prior=0.8)
    total = sum(counted.values())
    keep = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(max(1, -(-total // train_docs)))) == 0

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            out = []
            for value in batch.column(0):
                data = (value.as_py() or "").encode()
                words = data.split()
                m = measures(data, words)
                at, x = features(data, words, m, slots)
                out.append((at.astype(np.int32), x.astype(np.float32), posteriors.get(votes(m), 0.5)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.float32())), pa.array([o[2] for o in out], pa.float64())], ["at", "x", "y"])

    # copies of one text are sampled together, so they are made one row first
    rows = texts.where(keep).distinct().limit(2 * train_docs).mapInArrow(sampled, "at array<int>, x array<float>, y double")
    learnt = [(np.array(r.at), np.array(r.x, np.float64), r.y) for r in rows.toLocalIterator()]
    learnt.sort(key=lambda r: (r[2], len(r[0]), r[0].tolist()))  # whatever order they came in
    return Model(posteriors, accuracies, logistic(learnt))


def quality(docs: DataFrame, threshold: float = 0.5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, label_posterior, score, keep of every row of docs (doc_id, text).

    keep: the scorer's chance of good quality reaches the threshold. Null and empty texts are one labeller's poor vote; an empty table
    gives no rows. Other columns are not looked at, and repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = WordWeights(model.weights)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in sliced(texts):
                judged = [model.judge(x, known) for x in texts[a:b]]
                posterior, score = (np.array(x) for x in zip(*judged, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(posterior), pa.array(score), pa.array(score >= threshold)], ["doc_id", "label_posterior", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, label_posterior double, score double, keep boolean")


def good_documents(docs: DataFrame, threshold: float = 0.5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs (text; any other columns) that the classifier keeps, with all their columns.

    Each row is judged on its own text: null and empty texts are judged alike, as texts without words, on which one labeller
    votes against; repeated rows stay or go alike, null ids play no part, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, train_docs))
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = WordWeights(model.weights)
        for batch in batches:
            yield batch.filter(pa.array([model.judge(x.as_py(), known)[1] >= threshold for x in batch.column(column)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
