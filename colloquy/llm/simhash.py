"""SimHash near-duplicates found through anchor points of a covering code.

A 64-bit fingerprint is cut into m segments of w = 64/m bits, m being the least for which two fingerprints within the
threshold must agree to one bit on some segment. The anchors of a segment are the codewords of a Hamming code of length
w - 1 times one free bit: its covering radius is 1, so each fingerprint has a home anchor within distance 1, and one that
differs from it by one bit is within 1 + 1 of that anchor. Each fingerprint is therefore replicated to every anchor within
radius plus threshold, 2, and at an anchor those at home are compared with all that were replicated there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import FACTORS, Hashes, checkpointed, mixed, table, window_hashes, word_hashes
from colloquy.llm.components import connected_components

SEED = 42
#: Home fingerprints of an anchor that one task compares; more are dealt out, the others going to each share.
HOME_BLOCK = 2048
#: Cells with at most so many comparisons are handled together.
SMALL_CELL = 512


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Unsigned XXH64, seed 42, of each shingle; fewer words make one shingle."""
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def majority(words: list[bytes], width: int) -> int:
    """The fingerprint of the shingles, repeats included; 0 without words."""
    return majority_of(shingle_hashes(words, width)) if words else 0


def majority_of(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it."""
    hashes = hashes.astype(">u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp of every row of docs (doc_id, text): fingerprints as signed longs. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority((text.as_py() or "").encode().lower().split(), width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Anchors:
    """Home and reachable anchors of fingerprints, by segment."""

    def __init__(self, max_bits: int) -> None:
        if not 0 <= max_bits <= 7:
            raise ValueError("thresholds from 0 to 7 bits are supported")
        self.segments = 2 if max_bits <= 3 else 4
        self.width = 64 // self.segments
        length = self.width - 1
        pairs: dict[int, list[int]] = {s: [] for s in range(1, self.width)}
        for i in range(length):
            for j in range(i):
                pairs[(i + 1) ^ (j + 1)].append(1 << i | 1 << j)
        #: For each syndrome, the flips of two bits that lead to a codeword.
        self.flips = np.array([[0] * (length // 2)] + [pairs[s] for s in range(1, self.width)], np.uint64)
        # the parity checks: position i has the syndrome i + 1
        self.checks = [np.uint64(sum(1 << i for i in range(length) if (i + 1) >> b & 1)) for b in range(length.bit_length())]

    def split(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for k in range(self.segments):
            value = fps >> np.uint64(k * self.width) & np.uint64((1 << self.width) - 1)
            syndrome = np.zeros(len(fps), np.int64)
            for b, mask in enumerate(self.checks):
                syndrome |= (np.bitwise_count(value & mask) & 1).astype(np.int64) << b
            flip = np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))
            yield k, value, syndrome, value ^ flip

    def key(self, segment: int, anchor: np.ndarray) -> np.ndarray:
        return (anchor | np.uint64(segment << self.width)).astype(np.int64)

    def homes(self, fps: np.ndarray) -> list[np.ndarray]:
        return [self.key(k, home) for k, _, _, home in self.split(fps)]

    def reachable(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, the index of the fingerprint, whether the anchor is its home."""
        keys, rows, home_flags = [], [], []
        index = np.arange(len(fps))
        for k, value, syndrome, home in self.split(fps):
            for anchors, at, is_home in ((home, index, True), (home ^ np.uint64(1 << (self.width - 1)), index, False)):
                keys.append(self.key(k, anchors)), rows.append(at), home_flags.append(np.full(len(at), is_home))
            off = np.flatnonzero(syndrome)
            two = (value[off, None] ^ self.flips[syndrome[off]]).ravel()
            keys.append(self.key(k, two)), rows.append(np.repeat(off, self.flips.shape[1])), home_flags.append(np.zeros(len(two), bool))
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(home_flags)


def near(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether row i of a and row j of b (nodes, fingerprints of one or more 64-bit columns) are different nodes within max_bits."""
    return (sum(np.bitwise_count(x[i] ^ y[j]) for x, y in zip(a[1:], b[1:], strict=True)) <= max_bits) & (a[0][i] != b[0][j])


class Cell:
    """A large cell: homes are held, the others stream by; links that add no connection are left out."""

    def __init__(self, max_bits: int, rows: list[np.ndarray]) -> None:
        self.rows, self.nodes, self.max_bits = rows, rows[0], max_bits
        self.root = np.arange(len(self.nodes))

    def links(self, rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(self.nodes)
        step = max(1, (1 << 18) // max(1, n))
        for k in range(0, len(rows[0]), step):
            part = [x[k : k + step] for x in rows]
            some = part[0]
            i, j = np.repeat(np.arange(n), len(some)), np.tile(np.arange(len(some)), n)
            hit = near(self.rows, part, i, j, self.max_bits).reshape(n, len(some))
            matched = np.flatnonzero(hit.any(axis=0))
            if self.root.min() == self.root.max():  # the homes are connected, so one link for each of the others suffices
                yield some[matched], np.full(len(matched), self.nodes[self.root[0]])
                continue
            hit |= self.nodes[:, None] == some[None, :]
            src, dst = [], []
            for m in matched:
                roots = np.unique(self.root[hit[:, m]])
                src += [some[m]] * len(roots)
                dst += list(self.nodes[roots])
                if len(roots) > 1:
                    self.root[np.isin(self.root, roots)] = roots[0]
            yield np.array(src, np.int64), np.array(dst, np.int64)


def connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links u - v with the least node that they lead to: the same links for the same group, wherever it is met."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[off], nodes[label[off]]


def compare(max_bits: int) -> Callable:
    """Rows of one partition, sorted by cell with homes first: links that connect what those of each cell do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        open_cell: Cell | None = None
        open_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            cols[4:] = [x.view(np.uint64) for x in cols[4:]]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
                held = None
            key, block, home, *rows = cols
            out: list = []
            edge = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            first, last = 0, len(starts) - 1
            if open_cell is not None and (key[0], block[0]) == open_key:
                out += open_cell.links([x[: ends[0]] for x in rows])
                first = 1
            if open_cell is not None and (not first or last):
                open_cell = None
            if last >= first:  # the last cell may go on in the next batch
                a = starts[last]
                if ends[last] - a > 4 * HOME_BLOCK:
                    open_cell, open_key = Cell(max_bits, [x[a:][home[a:]] for x in rows]), (key[a], block[a])
                    if len(open_cell.nodes):
                        out += open_cell.links([x[a:] for x in rows])
                else:
                    held = [x[a:] for x in cols]
                last -= 1
            yield from given(out + cells(starts[first : last + 1], ends[first : last + 1], home, rows))
        if held is not None:
            yield from given(cells(np.array([0]), np.array([len(held[0])]), held[2], held[3:]))

    def cells(starts: np.ndarray, ends: np.ndarray, home: np.ndarray, rows: list[np.ndarray]) -> list:
        out: list = []
        nodes = rows[0]
        before = np.concatenate([[0], np.cumsum(home)])
        homes, sizes = before[ends] - before[starts], ends - starts
        useful = (homes > 0) & (sizes > 1)
        small = useful & (homes * sizes <= SMALL_CELL)
        s, n, h = starts[small], sizes[small], homes[small]
        if len(s):  # homes come first in a cell, so its pair p is home p // n with member p % n
            pairs = h * n
            for part in np.array_split(np.arange(len(s)), int(pairs.sum() >> 18) + 1):
                counts = pairs[part]
                cell = np.repeat(part, counts)
                p = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                i, j = s[cell] + p // n[cell], s[cell] + p % n[cell]
                hit = near(rows, rows, i, j, max_bits)
                out.append((nodes[i[hit]], nodes[j[hit]]))
        large = useful & ~small
        for a, b in zip(starts[large], ends[large], strict=True):
            own = home[a:b]
            out += Cell(max_bits, [x[a:b][own] for x in rows]).links([x[a:b] for x in rows])
        return out

    def given(found: list) -> Iterator[pa.RecordBatch]:
        if sum(len(x) for x, _ in found):
            u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            member, least = connected(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(member), pa.array(least)], ["src", "dst"])

    return run


def links(points: DataFrame, max_bits: int) -> DataFrame:
    """points: node (long), fp. Returns src, dst: enough links between nodes to connect all that are near each other, some of them repeated."""

    def home_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(max_bits)
        for batch in batches:
            for keys in anchors.homes(batch.column(0).to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(max_bits)
        for batch in batches:
            keys, rows, home = anchors.reachable(batch.column(1).to_numpy().view(np.uint64))
            for k in range(0, len(keys), 1 << 16):
                at = pa.array(rows[k : k + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), *(batch.column(i).take(at) for i in range(2)), pa.array(home[k : k + (1 << 16)])], ["key", "node", "fp", "home"])

    points = points.select("node", "fp")
    own = points.select("fp").mapInArrow(home_rows, "key long")
    return met(points.mapInArrow(replicas, "key long, node long, fp long, home boolean"), own, max_bits)


def met(rows: DataFrame, homes: DataFrame, max_bits: int) -> DataFrame:
    """rows: key, node, columns of fingerprints, home; homes: the key of each row that is at home. Returns src, dst: in each cell (the rows of a key) those at home are compared with all."""
    fps = [c for c in rows.columns if c not in ("key", "node", "home")]
    hot = homes.groupBy("key").count().where(f"count > {HOME_BLOCK}").select("key", F.ceil(F.col("count") / HOME_BLOCK).cast("int").alias("blocks"))
    hot = checkpointed(hot)
    if hot.isEmpty():
        rows = rows.select("key", F.lit(0).alias("block"), "home", "node", *fps)
    else:  # a hot anchor's homes are dealt out; what is compared with them goes to each share
        rows = rows.join(hot, "key", "left")
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        rows = rows.withColumn("block", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        rows = rows.select("key", "block", (F.col("home") & (F.col("blocks").isNull() | (own == F.col("block")))).alias("home"), "node", *fps)
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("home")).mapInArrow(compare(max_bits), "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row of docs (doc_id, text; further columns are ignored).

    Texts are lower-cased (A-Z) and split at ASCII white space. Fingerprints over width words link at max_bits or fewer
    differing bits. A component is what links reach, equal fingerprints included; its id is the smallest doc_id in it. A null
    or empty text has fingerprint 0 and is linked like any other. A row without doc_id keeps its row and component but names
    none; if no row of a component has a doc_id, component_id is null. Repeated rows each keep their row; an empty table
    gives none.
    """
    fps = checkpointed(fingerprints(docs, width))
    points = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("fp")))
    found = connected_components(links(points, max_bits))
    placed = points.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = checkpointed(placed.select("fp", "component").join(named, "component").select("fp", "component_id"))
    return fps.join(placed, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's table: fingerprints of 3-word shingles as 16 hex digits, linked at 3 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies share this many hundredths of their five-word shingles or more.
COPY_WIDTH, COPY_SHARE = 5, 80
#: Two texts meet if the first 64 bits of their fingerprints differ in ANCHOR_BITS or fewer, or if they share one of their PARTS shingles of
#: least hash. What meets is a candidate if the whole fingerprints, 128 bits, differ in CANDIDATE_BITS or fewer: at a similarity of 0.8
#: they differ in 19 with a deviation of 4, between texts that have nothing in common in 64 with a deviation of 6.
ANCHOR_BITS, PARTS, CANDIDATE_BITS = 3, 6, 34
#: Texts, and words of them, that stand in one block of a group of candidates.
BLOCK_TEXTS, BLOCK_WORDS = 512, 1 << 19
#: Bits of the broadcast filter of candidates (8 MB); where they are many it lets more texts through, which a join then leaves out.
FILTER_BITS = 1 << 26


def text_node(text: F.Column) -> F.Column:
    """What stands for a text: its XXH64; all texts without words are 0."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def copy_print(text: str | None) -> tuple[int, int, int, np.ndarray]:
    """Words, two halves of the fingerprint over the distinct shingles of COPY_WIDTH words (fewer words make one), the PARTS least hashes of these."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0, 0, 0, np.empty(0, np.uint64)
    hashes = np.unique(window_hashes(word_hashes(words, _hashes), min(COPY_WIDTH, len(words))))
    return len(words), majority_of(hashes), majority_of(mixed(hashes * FACTORS[0] + FACTORS[1])), hashes[:PARTS]


#: Hashes of the words that this worker has met.
_hashes = Hashes()


def candidate_prints(rows: DataFrame) -> DataFrame:
    """rows: doc_id, node, text. Returns doc_id, node, words, fp0, fp1, parts: what copy_print gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [copy_print(text.as_py()) for text in batch.column(2)]
            numbers = [pa.array(np.array([f[k] for f in found], np.uint64).view(np.int64)) for k in range(3)]
            parts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[3]) for f in found)]), pa.int32()), pa.array(np.concatenate([f[3] for f in found]).view(np.int64) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, parts], ["doc_id", "node", "words", "fp0", "fp1", "parts"])
        _hashes.clear()

    return rows.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node long, words long, fp0 long, fp1 long, parts array<long>")


def candidates(points: DataFrame) -> DataFrame:
    """points: node, fp0, fp1, parts of distinct texts. Returns src, dst: enough links to connect all candidates that meet at an anchor or by a part."""
    near = links(points.select("node", F.col("fp0").alias("fp")), ANCHOR_BITS)
    parted = points.select(F.explode("parts").alias("key"), "node", "fp0", "fp1", F.lit(True).alias("home"))
    return near.unionByName(met(parted, parted.select("key"), CANDIDATE_BITS))


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A bit for each residue of the nodes modulo FILTER_BITS; its size is fixed."""
    bit = F.pmod("node", F.lit(FILTER_BITS)) + 1
    rows = nodes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows.toLocalIterator():
        at = (row.bucket - 1) * 4096
        out[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows: node, text. Returns node, shingles for the wanted nodes and perhaps some more: the distinct hashes of a text's shingles of COPY_WIDTH words, ascending."""
    bits = rows.sparkSession.sparkContext.broadcast(node_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            at = nodes % FILTER_BITS
            keep = np.flatnonzero((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            keep = keep[np.unique(nodes[keep], return_index=True)[1]]  # copies in a batch once
            for k in keep:
                found = np.unique(shingle_hashes((batch.column(1)[int(k)].as_py() or "").encode().lower().split(), COPY_WIDTH)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 1]), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], ["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def exact_links(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what exact similarity connects among texts of two blocks (side False or True; one block: all False).

    Compared are candidates of different sides, or all of one; pairs that links connect already are left out. fps: a row for each text.
    """
    n, one = len(nodes), not side.any()
    root, found = np.arange(n), []
    lengths = np.fromiter(map(len, sets), np.int64, n)
    coded = offsets = present = None
    for i in np.flatnonzero(~side):
        others = np.arange(i + 1, n) if one else np.flatnonzero(side)
        others = others[(np.bitwise_count(fps[others] ^ fps[i]).sum(axis=1, dtype=np.int64) <= CANDIDATE_BITS) & (root[others] != root[i])]
        least, most = np.minimum(lengths[others], lengths[i]), np.maximum(lengths[others], lengths[i])
        others = others[100 * least >= COPY_SHARE * most]
        if not len(others):
            continue
        if n == 2:
            common = np.array([len(np.intersect1d(sets[0], sets[1], assume_unique=True))])
        else:
            if coded is None:  # shingles as small numbers
                distinct, coded = np.unique(np.concatenate(sets), return_inverse=True)
                offsets, present = np.cumsum(lengths) - lengths, np.zeros(len(distinct), bool)
            own = coded[offsets[i] : offsets[i] + lengths[i]]
            present[own] = True
            sizes = lengths[others]
            begin = np.cumsum(sizes) - sizes
            met = present[coded[np.repeat(offsets[others] - begin, sizes) + np.arange(sizes.sum())]]
            common = np.add.reduceat(met.astype(np.int64), begin)
            present[own] = False
        alike = others[100 * common >= COPY_SHARE * (lengths[others] + lengths[i] - common)]
        for j in alike:
            if root[j] != root[i]:
                found.append((int(nodes[i]), int(nodes[j])))
                root[root == root[j]] = root[i]
    return found


def verified(groups: DataFrame) -> DataFrame:
    """groups: component, low, high (two blocks of it), block, node, fp0, fp1, shingles. Returns src, dst: links by exact similarity."""

    def links_of(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        whole = pa.Table.from_batches(rows)
        nodes, first = np.unique(whole.column("node").to_numpy(), return_index=True)
        if len(nodes) < 2:
            return []
        whole = whole.take(pa.array(first)).combine_chunks()
        fps = np.column_stack([whole.column(c).to_numpy().view(np.uint64) for c in ("fp0", "fp1")])
        shingles = whole.column("shingles").combine_chunks()
        flat, at = shingles.flatten().to_numpy(), np.concatenate([[0], np.cumsum(shingles.value_lengths().to_numpy())])
        side = (whole.column("block").to_numpy() == whole.column("high")[0].as_py()) & (whole.column("low")[0] != whole.column("high")[0])
        return exact_links(nodes, fps, [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            found: list = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and key != tuple(keys[a]):
                    found += links_of(held)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["src", "dst"])
        if held and (found := links_of(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["src", "dst"])

    columns = ["component", "low", "high", "block", "node", "fp0", "fp1", "shingles"]
    return groups.select(*columns).repartition("component", "low", "high").sortWithinPartitions("component", "low", "high").mapInArrow(run, "src long, dst long")


def near_copies(docs: DataFrame) -> DataFrame:
    """node, first (its smallest doc_id), component of each distinct text of docs (doc_id, text): what pairs of a Jaccard similarity of COPY_SHARE hundredths or more connect.

    Fingerprints and parts only find groups of candidates; within a group candidates are compared by their whole sets of shingles. A
    group is cut into blocks of bounded size and each two blocks meet in one task, so that neither pairs nor sets pile up.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_node(text).alias("node"), text.alias("text"))
    prints = candidate_prints(rows)
    points = checkpointed(prints.groupBy("node", "words", "fp0", "fp1").agg(F.min("doc_id").alias("first"), F.first("parts").alias("parts")))
    parts = connected_components(candidates(points))
    groups = checkpointed(points.where("words > 0").join(parts, "node").select("node", "words", "fp0", "fp1", "component"))
    blocks = F.greatest(F.ceil(F.sum("words") / BLOCK_WORDS), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int")
    sizes = groups.groupBy("component").agg(blocks.alias("blocks"))
    groups = groups.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = shingle_sets(rows, groups.select("node")).groupBy("node").agg(F.first("shingles").alias("shingles"))
    held = groups.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = verified(held.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))
    placed = points.join(connected_components(checkpointed(found)), "node", "left")
    return placed.select("node", "first", F.coalesce("component", "node").alias("component"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which each group of near copies keeps one: that with the smallest doc_id.

    Near copies share 0.8 of their five-word shingles or more, counted exactly; groups are what such pairs connect. At that
    similarity the fingerprints over five words differ in about 10 of 64 bits, which no covering code of use reaches, so
    texts also meet where they share one of a few shingles of least hash; of six, one is shared but for one pair in ten
    thousand. Null, empty and white texts are copies of each other. A row without a doc_id stands behind those with one; where no row of a
    group has one, one row stays. Rows with one doc_id and different texts are judged each on its own text; of equal ones the
    first by their other columns stays. An empty table gives no rows.
    """
    found = near_copies(docs)
    best = F.min_by(F.struct("first", "node"), F.struct(F.col("first").isNull(), "first", "node")).alias("best")
    kept = found.groupBy("component").agg(best).select(F.col("best.node").alias("near_node"), F.col("best.first").alias("near_first"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumn("near_node", text_node(text)).withColumn("near_first", F.col("doc_id").cast("long"))
    same = (marked.near_node == kept.near_node) & marked.near_first.eqNullSafe(kept.near_first)
    order = Window.partitionBy("near_node", "near_first").orderBy(F.to_json(F.struct(*(F.col(c).cast("string") for c in docs.columns if c != "text"))), "text")
    one = marked.join(kept, same, "left_semi").withColumn("near_rank", F.row_number().over(order)).where("near_rank = 1")
    return one.select(*docs.columns)
