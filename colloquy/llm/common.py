"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Texts are cut into runs of about this many bytes, so that a worker's memory doesn't follow the Arrow batch size.
SLICE_BYTES = 6 << 20
#: Entries of a worker's cache before it is emptied.
CACHE_ENTRIES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and the master is local (tests) a temporary one; elsewhere a ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    made = spark.conf.get("colloquy.local.shared", None)
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("colloquy.local.shared", made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def sliced(texts: list | pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit characters (of an Arrow array: bytes); a longer text stands alone."""
    start = held = 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(x or "") for x in texts]
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size + 64
    if start < len(texts):
        yield start, len(texts)


class Hashes(dict):
    """Word (bytes) to XXH64, kept for words seen before; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(words: list, cache: Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


#: Odd multipliers of a multilinear hash over the words of a window.
FACTORS = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result may deal rows out."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of width consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * FACTORS[k % 64]
    return mixed(out + np.uint64(width))
