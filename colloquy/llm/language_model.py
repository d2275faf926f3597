"""Texts scored by a weighted back-off automaton over smoothed n-grams.

A state is a history: the empty one, or an n-gram of training that is shorter than the order (one of two tokens or more if it
is seen STATE_COUNT times). A state has an arc for each token that follows it in training, once seen or more, which leads to
the state of the longest history that ends there, and a failure arc to the state of its history less the oldest token. A
document is read once from left to right: the state is carried, and the log-probabilities of the arcs and failure arcs that
are taken add up.

Counts are exact and cover all training documents. n-grams are known by 64-bit hashes, each order by its own. A group of
documents asks for the counts of those that it holds: a row for each part of the hashes lists them, and the answer lists the
counts in the same order. So neither the vocabulary nor the n-grams must fit in one place, and no hash is sent back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import mixed, sliced, table

#: Longest n-gram.
ORDER = 3
#: A history of two tokens or more is a state if training has it so often; one of a single token always is.
STATE_COUNT = 8
#: Weight of the next lower order in a state whose arcs are n-grams of this order, in tokens (a Dirichlet prior).
PRIOR_TOKENS = {2: 200.0, 3: 60.0, 4: 60.0}
#: Bytes of text of a group of documents, and for which there is a part of the hashes.
GROUP_BYTES, PART_BYTES = 8 << 20, 16 << 20
#: Tokens that the automaton reads of each document before all go on to the next ones; long documents are cut into runs of as many.
RUN = 256
#: The end of a document, which is a token, and what stands before its first; no word's hash is this but by chance.
END = 0x5851F42D4C957F2D


class Tokens:
    """Tokens of some texts, each with its end. words: hashes of distinct ones, ascending; at: the place there of each token."""

    def __init__(self, texts: pa.Array) -> None:
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = cut.flatten()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(full)])
        bounds = before[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        words = coded.dictionary.to_pylist()
        hashes = np.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.uint64(END))
        self.words, place = np.unique(hashes, return_inverse=True)
        self.sizes = np.diff(bounds) + 1
        self.ends = np.cumsum(self.sizes) - 1
        codes = np.full(bounds[-1] + len(self.sizes), len(words), np.int64)
        inner = np.ones(len(codes), bool)
        inner[self.ends] = False
        codes[inner] = coded.indices.to_numpy()
        self.at = place[codes]


class Grams:
    """n-grams of a group of texts by order. keys[k]: distinct hashes, ascending; at[k]: the place there of the k-gram that ends at each token, -1 where none is kept; last[k]: a token at which each ends."""

    def __init__(self, texts: pa.Array) -> None:
        tokens = Tokens(texts)
        self.sizes, self.ends = tokens.sizes, tokens.ends
        self.starts = self.ends - self.sizes + 1
        self.keys, self.at, self.last = {1: tokens.words}, {1: tokens.at}, {}
        self.own = self.hashes = tokens.words[tokens.at]
        self.open = np.ones(len(self.own), bool)
        self._ends(1)

    def _ends(self, k: int) -> None:
        self.last[k] = np.zeros(len(self.keys[k]), np.int64)
        some = np.flatnonzero(self.at[k] >= 0)
        self.last[k][self.at[k][some]] = some

    def add(self, k: int, states: np.ndarray | None = None) -> None:
        """The k-grams, after those of lower orders. states: which (k - 1)-grams are states, so that their arcs are wanted; else all."""
        # the end of the document before stands before the first token, and nothing before that
        self.hashes = mixed(np.roll(self.hashes, 1) * np.uint64(0xD6E8FEB86659FD93) + self.own * np.uint64(2 * k + 1))
        if k > 2:
            first = self.starts + k - 3
            self.open[first[first <= self.ends]] = False
        if states is not None:
            before = np.roll(self.at[k - 1], 1)
            self.open &= (before >= 0) & states[before]
        whole = np.flatnonzero(self.open)
        self.keys[k], place = np.unique(self.hashes[whole], return_inverse=True)
        self.at[k] = np.full(len(self.own), -1)
        self.at[k][whole] = place
        self._ends(k)

    def counts(self, train: np.ndarray) -> dict[int, np.ndarray]:
        """How often each stands in the documents that train."""
        weight = np.repeat(train, self.sizes)
        return {k: np.bincount(at[weight & (at >= 0)], minlength=len(self.keys[k])) for k, at in self.at.items()}


def are_states(k: int, counts: np.ndarray) -> np.ndarray:
    """Which n-grams of order k are states."""
    return counts >= (STATE_COUNT if k > 1 else 1)


class Automaton:
    """The states, arcs and failure arcs that a group of documents can reach. counts: training counts of its n-grams."""

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], total: int, vocabulary: int, priors: dict[int, float]) -> None:
        self.order, self.at, self.ends, self.sizes = max(counts), grams.at, grams.ends, grams.sizes
        self.known = {k: n > 0 for k, n in counts.items()}
        self.states = {k: are_states(k, counts[k]) for k in range(1, self.order)}
        # arcs of the empty history: all tokens, unknown ones too
        chance = (counts[1] + 1.0) / (total + vocabulary + 1.0)
        self.arc, self.failure = {1: np.log10(chance)}, {}
        for k in range(2, self.order + 1):
            last = grams.last[k]
            passed = counts[k - 1][self.at[k - 1][last - 1]] if len(last) else np.empty(0)
            lower = chance[self.at[k - 1][last]] if len(last) else np.empty(0)
            chance = (counts[k] + priors[k] * lower) / (passed + priors[k])
            self.arc[k] = np.log10(chance)
            # of states that are histories of k - 1 tokens
            self.failure[k - 1] = np.log10(priors[k] / (counts[k - 1] + priors[k]))

        self.depth = self._depth()

    def _depth(self) -> np.ndarray:
        """How many tokens the longest history stands for that ends at each token and is a state."""
        out = np.zeros(len(self.at[1]), np.int64)
        for k, states in self.states.items():
            out[(self.at[k] >= 0) & states[self.at[k]] & (out == k - 1)] = k
        return out

    def traverse(self) -> np.ndarray:
        """log10 probability of each document. All runs are read side by side, each carrying its state from token to token."""
        starts = self.ends - self.sizes + 1
        runs = -(-self.sizes // RUN)
        owner = np.repeat(np.arange(len(runs)), runs)
        begin = starts[owner] + RUN * (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs))
        length = np.minimum(RUN, self.ends[owner] + 1 - begin)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        # a run starts in the state to which the tokens before it lead: at a document's first one, that of an end
        state, first = self.depth[begin - 1], begin == starts[owner]
        state[first] = np.minimum(state[first], 1)
        score = np.zeros(len(owner))
        for step in range(int(length[0]) if len(length) else 0):
            n = np.searchsorted(-length, -step)  # runs that go on
            position, depth = begin[:n] + step, state[:n]
            taken = np.zeros(n, bool)
            for k in range(self.order, 0, -1):
                here = np.flatnonzero((depth == k - 1) & ~taken)
                if not len(here):
                    continue
                own = self.at[k][position[here]]
                arc = (own >= 0) & self.known[k][own] if k > 1 else np.ones(len(here), bool)
                go, fail = here[arc], here[~arc]
                score[go] += self.arc[k][own[arc]]
                taken[go] = True
                depth[go] = np.minimum(self.depth[position[go]], k)
                if len(fail):
                    score[fail] += self.failure[k - 1][self.at[k - 1][position[fail] - 1]]
                    depth[fail] = k - 2
        return np.bincount(owner, weights=score, minlength=len(runs))


def _is_training() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


# What is sent


def packed(keys: np.ndarray) -> bytes:
    """Ascending hashes: the first one, how many steps need more than six bytes, which and their upper bytes, then six bytes of each step."""
    steps = np.diff(keys)
    wide = np.flatnonzero(steps >> np.uint64(48))
    upper = (steps[wide] >> np.uint64(48)).astype(np.uint16)
    return keys[:1].tobytes() + np.uint32(len(wide)).tobytes() + wide.astype(np.uint32).tobytes() + upper.tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    count = int(np.frombuffer(data, np.uint32, 1, 8)[0])
    wide, upper = np.frombuffer(data, np.uint32, count, 12), np.frombuffer(data, np.uint16, count, 12 + 4 * count)
    steps = np.zeros((n - 1, 8), np.uint8)
    steps[:, :6] = np.frombuffer(data, np.uint8, 6 * (n - 1), 12 + 6 * count).reshape(-1, 6)
    steps = steps.view(np.uint64).ravel()
    steps[wide] |= upper.astype(np.uint64) << np.uint64(48)
    return np.cumsum(np.append(np.frombuffer(data, np.uint64, 1), steps))


def narrow(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0)).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def asks(keys: dict[int, np.ndarray], counts: dict[int, np.ndarray], group: int, bits: int) -> pa.Table:
    """A row for each order and part of the hashes (their upper bits) that holds some of them."""
    rows: list[tuple] = []
    for k, own in keys.items():
        part = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        rows += [(int(part[a]), k, group, b - a, packed(own[a:b]), narrow(counts[k][a:b])) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True)]
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["part", "order", "group", "size", "keys", "counts"])


def totals(rows: pa.Table) -> pa.Table:
    """Of one part of the words: how often they stand in training, and how many there are."""
    sizes = rows.column("size").to_pylist()
    keys = [unpacked(x, n) for x, n in zip(rows.column("keys").to_pylist(), sizes, strict=True)]
    total = sum(int(widened(x, n).sum()) for x, n in zip(rows.column("counts").to_pylist(), sizes, strict=True))
    return pa.table({"total": [total], "vocabulary": [len(np.unique(np.concatenate(keys)))]})


DEALT = "group int, doc_id array<long>, train array<boolean>, sizes array<int>, texts binary"


def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """group, doc_id, train, text: a row for each group that a batch has documents of, with their texts compressed as one."""
    for batch in batches:
        order = np.argsort(batch.column(0).to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        group, texts = batch.column(0).to_numpy(), batch.column(3)
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        bounds, lengths = np.append(begin, len(group)), pc.binary_length(texts)
        at = np.concatenate([[0], np.cumsum(lengths.to_numpy())])
        data = texts.cast(pa.binary()).buffers()[2] if at[-1] else pa.py_buffer(b"")
        first = int(np.frombuffer(texts.buffers()[1], np.int32, 1, 4 * texts.offset)[0]) if len(texts) else 0
        blobs = [pa.compress(data.slice(first + int(at[a]), int(at[b] - at[a])), "zstd", asbytes=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        offsets = pa.array(bounds, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(group[begin]), *(pa.ListArray.from_arrays(offsets, x) for x in (batch.column(1), batch.column(2), lengths)), pa.array(blobs, pa.binary())], ["group", "doc_id", "train", "sizes", "texts"])


class Documents:
    """The documents of a group, from its rows."""

    def __init__(self, group: pa.Table) -> None:
        self.doc_id = pa.concat_arrays([x.flatten() for x in group.column("doc_id").chunks])
        self.train = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in group.column("train").chunks])
        texts = []
        for sizes, data in zip(group.column("sizes"), group.column("texts"), strict=True):
            ends = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())]).astype(np.int32)
            blob = pa.decompress(data.as_py(), int(ends[-1]), "zstd") if ends[-1] else pa.py_buffer(b"")
            texts.append(pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), blob))
        self.texts = pa.concat_arrays(texts)


ASKS = "part long, order int, group int, size int, keys binary, counts binary"


def answers(rows: pa.Table) -> pa.Table:
    """The asks for one order and part, each with the sums of all in place of its own counts."""
    sizes = rows.column("size").to_pylist()
    keys = np.concatenate([unpacked(x, n) for x, n in zip(rows.column("keys").to_pylist(), sizes, strict=True)])
    counts = np.concatenate([widened(x, n) for x, n in zip(rows.column("counts").to_pylist(), sizes, strict=True)])
    _, at = np.unique(keys, return_inverse=True)
    sums = np.bincount(at, weights=counts).astype(np.int64)[at]
    ends = np.cumsum(sizes)
    out = [narrow(sums[e - n : e]) for n, e in zip(sizes, ends.tolist(), strict=True)]
    return pa.table([rows.column("part"), rows.column("order"), rows.column("group"), rows.column("size"), pa.array(out, pa.binary())], ["part", "order", "group", "size", "counts"])


def score_documents(docs: DataFrame, order: int = ORDER, priors: dict[int, float] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Documents whose crc32 of the doc_id as text leaves 2 modulo 7 are held out; the others, null ids (as empty text) included,
    train. Texts are lower-cased A-Z and split at ASCII white space; a null text is empty, so it has its end alone. base_score
    is the add-one unigram score. score is that of the automaton, whose chances of the next token sum to 1 in every state: in
    that of a history h seen n times, token w has (count of h w + prior * its chance after h less the oldest token) / (n +
    prior). A document's first token follows an end. Repeated rows count as often as they stand there. An empty table gives no
    rows.
    """
    priors = PRIOR_TOKENS | (priors or {})
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _is_training().alias("train"))

    n_bytes = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    groups, bits = max(1, -(-n_bytes // GROUP_BYTES)), max(0, (n_bytes // PART_BYTES).bit_length())

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in sliced(batch.column(0)):
                tokens = Tokens(batch.column(0).slice(a, b - a))
                yield from asks({1: tokens.words}, {1: np.bincount(tokens.at, minlength=len(tokens.words))}, 0, bits).to_batches()

    words = docs.where("train").select("text").mapInArrow(words_of, ASKS).groupBy("part").applyInArrow(totals, "total long, vocabulary long")
    found = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("vocabulary")).first()
    total, vocabulary = found.total, found.vocabulary
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("group")
    dealt = docs.select(group, "doc_id", "train", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(dealt_out, DEALT)

    def counted(documents: Documents, found: pa.Table, most: int) -> tuple[Grams, dict[int, np.ndarray]]:
        """The n-grams of a group up to an order, and their counts as far as they are found."""
        grams, counts = Grams(documents.texts), {}
        found = found.sort_by([("order", "ascending"), ("part", "ascending")])
        columns = [found.column(c).to_pylist() for c in ("order", "size", "counts")]
        for k in range(1, most + 1):
            if k > 1:
                grams.add(k, are_states(k - 1, counts[k - 1]) if k > 2 else None)
            own = [widened(data, n) for order, n, data in zip(*columns, strict=True) if order == k]
            counts[k] = np.concatenate(own) if own else np.empty(0, np.int64)
        return grams, counts

    def asked(key: tuple, group: pa.Table) -> pa.Table:
        documents = Documents(group)
        grams = Grams(documents.texts)
        if order > 1:
            grams.add(2)
        return asks(grams.keys, grams.counts(documents.train), key[0].as_py(), bits)

    def asked_more(k: int) -> Callable:
        def run(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
            documents = Documents(group)
            grams, _ = counted(documents, found, k)
            return asks({k: grams.keys[k]}, grams.counts(documents.train), key[0].as_py(), bits)

        return run

    def scored(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        documents = Documents(group)
        grams, counts = counted(documents, found, order)
        automaton = Automaton(grams, counts, total, vocabulary, priors)
        begin = grams.starts
        known, base = np.add.reduceat((counts[1][grams.at[1]] > 0).astype(np.int64), begin), np.add.reduceat(automaton.arc[1][grams.at[1]], begin)
        return pa.table([documents.doc_id, pa.array(~documents.train), pa.array(grams.sizes), pa.array(known), pa.array(np.full(len(begin), total)), pa.array(base), pa.array(automaton.traverse())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    summed = lambda rows: rows.groupBy("part", "order").applyInArrow(answers, "part long, order int, group int, size int, counts binary")
    sums = summed(dealt.groupBy("group").applyInArrow(asked, ASKS))
    for k in range(3, order + 1):  # arcs of histories that are states by what is known now
        sums = sums.unionByName(summed(dealt.groupBy("group").cogroup(sums.groupBy("group")).applyInArrow(asked_more(k), ASKS)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("group").cogroup(sums.groupBy("group")).applyInArrow(scored, schema)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
