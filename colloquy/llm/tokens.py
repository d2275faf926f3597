"""Token ids as flat files, and token counts, with vocabularies of public tokenizers.

A byte-level BPE never merges across its pre-tokens, and a pre-token never holds a space behind another character. So a text
whose white space holds no two spaces in a row (and no space between other white space) can be cut at each space, and the
words encoded with the space before them, each distinct word once per worker. Line feeds between words are cuts too. Texts that hold the string of an added token,
white space beyond ASCII or such runs of white space are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import shared_dir, sliced, table

#: Entries of the table of frequent words, which bounds what is broadcast.
FREQUENT_WORDS = 1 << 16
#: Words that one task proposes for that table.
PROPOSED_WORDS = 1 << 13
#: Entries of a generation of a worker's cache.
CACHE_WORDS = 120_000
#: Characters that are encoded at a time.
WORD_SLICE = 2 << 20
#: Bytes of text for one part of the files; small tables have more parts, FEW_PARTS for each core at most.
PART_BYTES, FEW_PARTS, LEAST_PART_BYTES = 128 << 20, 6, 2 << 20
#: Documents that are read from the files at a time.
READ_DOCS = 4096
#: A word beyond this length isn't cached.
LONG_WORD = 64

WHITE = " \t\n\r\x0b\x0c"
PIECES = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Letters of Latin scripts, then marks: two pre-tokens.
SIMPLE = re.compile(r"(\x01?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")
OTHER_WHITE = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: A line feed between two words is written as a space and this, so that it is a cut too.
LINE = "\x01"
APART = OTHER_WHITE + r"|\x01|  |[\t\n\r\x0b\x0c] [\t\n\r\x0b\x0c]"
KEPT_LINES = r"\n[ \t\n\r\x0b\x0c]|[ \t\n\r\x0b\x0c]\n"


def bytes_as_letters() -> dict[int, str]:
    """A byte-level vocabulary writes each byte as a character: printable ones as they are, the others from 256 on. Text decoded as Latin-1 is translated by this."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


class Encoder:
    """Ids of texts by a tokenizers .json file, a sentencepiece .model or a .tiktoken file. whole() is the library's own encoding."""

    def __init__(self, path: str) -> None:
        self.by_word = False
        if path.endswith(".json"):
            from tokenizers import Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.whole = lambda text: self.library.encode(text, add_special_tokens=False).ids
            kind = self.library.pre_tokenizer
            self.by_word = isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space and self.library.normalizer is None
            added = [x.content for x in self.library.get_added_tokens_decoder().values()]
            self.apart = "|".join([APART, *(re.sub(r"(\W)", r"\\\1", x) for x in added)])
            if self.by_word:  # the same model for texts that are pre-tokens already, one to a line, with bytes written as letters
                self.letters = bytes_as_letters()
                self.line = self.letters[10]
                self.split = Tokenizer(self.library.model)
                self.split.pre_tokenizer = pre_tokenizers.Split(self.line, "isolated")
                self.line_id = self.split.token_to_id(self.line)
                self.by_word = self.line_id is not None
        elif path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: self.library.encode(text)
        elif path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.whole = self.library.encode_ordinary
        else:
            raise ValueError(f"no library for {path}")

    def pre_tokens(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids (packed, 32 bits) of pieces of which each is one pre-token; many are encoded as the lines of one text."""
        for k in range(0, len(pieces), 2000):
            some = pieces[k : k + 2000]
            text = "\n".join(some).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.split.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.line_id)
            if len(at) != len(some) - 1:
                raise ValueError("a pre-token holds a line feed")
            data = ids.tobytes()
            yield from map(data.__getitem__, map(slice, (4 * np.append(0, at + 1)).tolist(), (4 * np.append(at, len(ids))).tolist()))


def pack(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes()


class Known:
    """Words to their packed ids. Two generations, so that common ones stay; packed ids, as the collector of garbage would visit lists again and again."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.young: dict[str, bytes] = {}  # of words with a space before them, then pieces without one
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each with a space before it, or a line feed where it begins with LINE."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, line = self.young, self.piece("\n")
        out = list(map(young.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        if self.old and new:
            again = list(map(self.old.get, [words[i] for i in new]))
            for i, x in zip(new, again, strict=True):
                if x is not None:
                    out[i] = young[words[i]] = x
            new = [i for i, x in zip(new, again, strict=True) if x is None]
        # letters are asked for as one pre-token, under the key of the word of these letters alone
        ask, marked, full, long = set(), [], SIMPLE.fullmatch, []
        for i in new:
            word = words[i]
            simple = full(word)
            if simple is None:
                out[i] = line + b"".join(map(self.piece, PIECES.findall(word[1:]))) if word[:1] == LINE else b"".join(map(self.piece, PIECES.findall(" " + word)))
                if len(word) <= LONG_WORD:
                    young[word] = out[i]
                continue
            if simple.end(1) < len(word):
                marked.append(i)
                letters = simple[1]
                if letters in young:
                    continue
                if letters in self.old:
                    young[letters] = self.old[letters]
                    continue
                word = letters
            ask.add(word)
            if len(word) > LONG_WORD:
                long.append(word)
        asked = list(ask)
        found = self.encoder.pre_tokens([" " + x if x[0] != LINE else x[1:] for x in asked])
        young.update((x, y if x[0] != LINE else line + y) for x, y in zip(asked, found, strict=True))
        for i in marked:
            word = words[i]
            letters = full(word)[1]
            out[i] = young[letters] + self.piece(word[len(letters) :])
            if len(word) <= LONG_WORD:
                young[word] = out[i]
        for i in new:
            if out[i] is None:
                out[i] = young[words[i]]
        for word in long:
            young.pop(word, None)
        return out

    def first(self, word: str) -> bytes:
        """Ids of a text's first word."""
        return b"".join(map(self.piece, PIECES.findall(word.replace(LINE, "\n"))))

    def piece(self, text: str) -> bytes:
        """Ids of a text by the library, kept if it is short."""
        found = self.pieces.get(text)
        if found is None:
            found = pack(self.encoder.whole(text))
            if len(text) <= LONG_WORD:
                if len(self.pieces) > CACHE_WORDS // 8:
                    self.pieces.clear()
                self.pieces[text] = found
        return found


class Worker:
    """What outlives a task: encoder, cache, and a table of frequent words of the first texts seen, where none is broadcast."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path)
        self.known = Known(self.encoder)
        self.frequent: Frequent | None = None

    def table(self, texts: pa.Array) -> Frequent:
        if self.frequent is None:
            counts = words_of(texts)[0].value_counts()
            words = counts.field(0).take(pc.array_sort_indices(counts.field(1), order="descending")[: FREQUENT_WORDS // 2]).to_pylist()
            words = [x for x in words if len(x) <= LONG_WORD]
            made = Frequent(words, self.known.ids(words))
            if pc.sum(pc.binary_length(texts)).as_py() < WORD_SLICE // 4:
                return made
            self.frequent = made
        return self.frequent


_workers: dict[str, Worker] = {}


def worker(path: str) -> Worker:
    if path not in _workers:
        _workers[path] = Worker(path)
    return _workers[path]


def lists(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each has, and all of them in a row."""
    return np.fromiter(map(len, rows), np.int64, len(rows)) // 4, np.frombuffer(b"".join(rows), np.uint32)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words at single spaces and line feeds, and where each text's begin."""
    kept = pc.match_substring_regex(texts, KEPT_LINES)
    cut = pc.split_pattern(pc.if_else(kept, texts, pc.replace_substring(texts, "\n", " " + LINE)), " ")
    sizes = np.diff(cut.offsets.to_numpy())
    return cut.flatten(), np.cumsum(sizes) - sizes


class Frequent:
    """The broadcast tier: frequent words and the ids of each (with a space before it)."""

    def __init__(self, words: list[str], ids: list[bytes]) -> None:
        self.words = words
        self.sizes, self.ids = lists(ids)
        self.set: pa.Array | None = None

    def __getstate__(self) -> tuple:
        return self.words, self.sizes, self.ids

    def __setstate__(self, state: tuple) -> None:
        self.words, self.sizes, self.ids = state
        self.set = None

    def find(self, words: pa.Array) -> np.ndarray:
        """Each word's place in the table, -1 where it has none."""
        if self.set is None:
            self.set = pa.array(self.words, pa.string())
        return pc.fill_null(pc.index_in(words, value_set=self.set), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def encoded(texts: pa.Array, frequent: Frequent, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts without null that can be cut at spaces: place of each word in the table, ids' sizes and ids of that table, and how many ids each text has."""
    words, begin = words_of(texts)
    place = frequent.find(words)
    n = len(frequent.sizes)
    place[begin] = n  # a text's first word has no space before it: these come next in the table, in order
    missing = np.flatnonzero(place < 0)
    coded = words.take(pa.array(missing)).dictionary_encode()
    firsts = words.take(pa.array(begin)).to_pylist()
    sizes, ids = lists([known.first(x) for x in firsts] + known.ids(coded.dictionary.to_pylist()))
    place[begin] += np.arange(len(begin))
    place[missing] = n + len(begin) + coded.indices.to_numpy()
    sizes, ids = np.concatenate([frequent.sizes, sizes]), np.concatenate([frequent.ids, ids])
    return place, sizes, ids, np.add.reduceat(sizes[place], begin) if len(begin) else np.empty(0, np.int64)


def frequent_words(docs: DataFrame, path: str) -> Frequent:
    """The commonest words of all documents. A task proposes its PROPOSED_WORDS commonest words, so no word list is shuffled whole; which ones are chosen affects speed alone."""
    encoder = Encoder(path)
    if not encoder.by_word:
        return Frequent([], [])

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.StructArray] = []

        def best(most: int) -> list[pa.Array]:
            both = pa.table([pa.concat_arrays([x.field(0) for x in held]), pa.concat_arrays([x.field(1) for x in held])], ["word", "n"]).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            top = pc.select_k_unstable(both, most, [("n_sum", "descending")])
            rows = both.take(top)
            return [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in rows.columns]

        for batch in batches:
            texts = batch.column(0)
            for a, b in sliced(texts, WORD_SLICE):
                words, _ = words_of(texts.slice(a, b - a))
                held.append(words.value_counts())
                if len(held) > 8:  # many more than are proposed are kept in between
                    held = [pa.StructArray.from_arrays(best(8 * PROPOSED_WORDS), ["values", "counts"])]
        if held:
            yield pa.RecordBatch.from_arrays(best(PROPOSED_WORDS), ["word", "n"])

    found = docs.select("text").mapInArrow(proposed, "word string, n long").where(F.length("word") <= LONG_WORD).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS)
    words = [x.word for x in found.collect()]
    return Frequent(words, Known(encoder).ids(words))


# Counts


def cuttable(texts: pa.Array, encoder: Encoder) -> np.ndarray:
    """Which texts can be cut at spaces."""
    return ~pc.match_substring_regex(texts, encoder.apart).to_numpy(zero_copy_only=False) if encoder.by_word else np.zeros(len(texts), bool)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a null text is empty.

    Two tiers on the map side: a broadcast table of the commonest words of all documents (FREQUENT_WORDS at most), then a
    bounded cache in each worker that asks the library. No words are shuffled but those proposed for the table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = worker(path).encoder, worker(path).known
        for batch in batches:
            texts = batch.column(1)
            for a, b in sliced(texts, WORD_SLICE):
                own = texts.slice(a, b - a)
                counts, apart = np.zeros(b - a, np.int64), ~cuttable(own, encoder)
                at = np.flatnonzero(~apart)
                counts[at] = encoded(own.take(pa.array(at)), common.value, known)[3]
                for k in np.flatnonzero(apart):
                    counts[k] = len(encoder.whole(own[k].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pc.binary_length(own.cast(pa.large_binary())).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


# Files


def _with_ends(texts: pa.Array, own: Worker, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts, each followed by end_id, and how many each has, its end included."""
    encoder = own.encoder
    apart = ~cuttable(texts, encoder)
    whole = [encoder.whole(texts[int(k)].as_py()) for k in np.flatnonzero(apart)]
    cut = texts.take(pa.array(np.flatnonzero(~apart)))
    place, sizes, ids, some = encoded(cut, own.table(cut), own.known)
    counts = np.zeros(len(texts), np.int64)
    counts[~apart], counts[apart] = some + 1, [len(x) + 1 for x in whole]
    # ids of each word in turn: the table's entries, one after the other
    each, begin = sizes[place], np.cumsum(sizes) - sizes
    flat = ids[np.repeat(begin[place] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    out = np.full(counts.sum(), end_id, np.uint32)
    ends = np.cumsum(counts)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    if len(whole):
        for k, x in zip(np.flatnonzero(apart), whole, strict=True):
            out[ends[k] - len(x) - 1 : ends[k] - 1] = x
            inner[ends[k] - len(x) - 1 : ends[k] - 1] = False
    out[inner] = flat
    return out, counts


def _local(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> list[dict]:
    """Writes the ids of all texts, each followed by end_id, in ascending doc_id order; returns one entry per file.

    Part k is three flat little-endian files: part-k.ids (unsigned 16-bit integers if the vocabulary fits, else 32-bit),
    part-k.offsets (unsigned 64-bit: where each document starts within the part, and its end) and part-k.docs (signed 64-bit
    doc_ids, and a byte per document that is 0 for a null one in part-k.valid). Parts ascend with doc_id, null first, and
    rows with one doc_id stand in text order; an entry's base, a prefix sum, is the number of ids in the parts before. A task
    writes under a name of its own and renames at its end, so a repeated task leaves the same files. manifest.json lists the
    entries. A null text is empty: end_id alone. An empty table has no parts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    n_bytes = docs.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    few = min(FEW_PARTS * context.defaultParallelism, -(-n_bytes // LEAST_PART_BYTES))
    count = max(1, few, -(-n_bytes // PART_BYTES))
    encoder = Encoder(path)
    size = encoder.library.get_vocab_size() if path.endswith(".json") else encoder.library.vocab_size() if path.endswith(".model") else encoder.library.n_vocab
    dtype = "<u2" if max(size - 1, end_id) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker = worker(path)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, top = _local(folder)
        store.create_dir(top)
        names = [f"{top}/part-{part:07d}.{kind}" for kind in ("ids", "offsets", "docs", "valid")]
        out, at, rows = None, 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                out = [store.open_output_stream(f"{x}.{own}") for x in names]
                out[1].write(np.zeros(1, "<u8").tobytes())
            for a, b in sliced(batch.column(1), WORD_SLICE):
                ids, counts = _with_ends(batch.column(1).slice(a, b - a), own_worker, end_id)
                out[0].write(ids.astype(dtype).tobytes())
                out[1].write((at + np.cumsum(counts)).astype("<u8").tobytes())
                at, rows = at + len(ids), rows + len(counts)
            if batch.num_rows:
                out[2].write(batch.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
                out[3].write(batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
        if out is not None:
            for stream, name in zip(out, names, strict=True):
                stream.close()
                store.move(f"{name}.{own}", name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows]), pa.array([at])], ["part", "rows", "ids"])
        pa.default_memory_pool().release_unused()

    ordered = docs.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(ordered.mapInArrow(run, "part int, rows long, ids long").collect())  # a row for each file
    bases = np.concatenate([[0], np.cumsum([x.ids for x in parts])]).astype(int)
    entries = [{"part": x.part, "rows": x.rows, "ids": x.ids, "base": int(base), "dtype": dtype} for x, base in zip(parts, bases[:-1], strict=True)]
    store, top = _local(folder)
    store.create_dir(top)
    with store.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps(entries).encode())
    return entries


class Flat:
    """A flat file of numbers: memory-mapped, or in a store without local files read by ranges."""

    def __init__(self, store: fs.FileSystem, name: str, dtype: str) -> None:
        self.dtype, self.local = np.dtype(dtype), isinstance(store, fs.LocalFileSystem)
        if self.local:
            self.data = np.memmap(name, dtype, "r") if os.path.getsize(name) else np.empty(0, dtype)
        else:
            self.data = store.open_input_file(name)

    def __call__(self, a: int, b: int) -> np.ndarray:
        width = self.dtype.itemsize
        return self.data[a:b] if self.local else np.frombuffer(self.data.read_at((b - a) * width, a * width), self.dtype)


def read_token_files(spark: SparkSession, folder: str, entries: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit integers), read from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not entries:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _local(folder)
        for entry in (x for batch in batches for x in batch.to_pylist()):
            name = f"{top}/part-{entry['part']:07d}"
            ids, offsets = Flat(store, f"{name}.ids", entry["dtype"]), Flat(store, f"{name}.offsets", "<u8")
            docs, valid = Flat(store, f"{name}.docs", "<i8"), Flat(store, f"{name}.valid", "u1")
            for k in range(0, entry["rows"], READ_DOCS):
                end = min(k + READ_DOCS, entry["rows"])
                at = offsets(k, end + 1).astype(np.int64)
                crc = [zlib.crc32(ids(a, b).astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                own = pa.array(docs(k, end), pa.int64(), mask=valid(k, end) == 0)
                yield pa.RecordBatch.from_arrays([own, pa.array(at[:-1] + entry["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(x["part"], x["rows"], x["base"], x["dtype"]) for x in entries], "part int, rows long, base long, dtype string")
    return rows.repartition(min(len(entries), 4096), "part").mapInArrow(run, schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(spark, folder, write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
