"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator; and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, language_model, mixing, private, quality, recompress, simhash, tokens

LONG = " ".join(f"word{k % 5000}" for k in range(60_000))
SAME = " ".join(f"s{k}" for k in range(30))
TEXTS = [None, "", "   \t\n", "one", "Ünï côdé  日本語 <|endoftext|> x", LONG, SAME, SAME, SAME + " tail", "a b", "le " * 300, "\x1ca\xa0b  c\n\n d"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "s" if k % 3 else None, "en", None, f"x{k}", k) for k, t in enumerate(TEXTS)]
    rows += [(None, SAME, "s", None, 1, "y", 1), (None, None, None, None, 1, "y", 1), (6, SAME, "s", "en", 2, "again", 2), (6, SAME, "s", "en", 2, "again", 2), (6, "other words", "s", "en", 2, "more", 3)]
    # columns named as the operators name theirs
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int, fingerprint string, size int").cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, SAME), (2, "a b"), (3, None), (4, ""), (None, "one"), (2, "a b")], "item_id long, text string")


def test_rows_are_kept(odd, bench):
    import public_tokenizers

    n, path = odd.count(), public_tokenizers.path("byte_bpe_50k.json")
    for found in (simhash.near_duplicates(odd), recompress.remove_repeats(odd), tokens.token_counts(odd, path), private.find_spans(odd), language_model.score_documents(odd), quality.quality(odd), mixing.mix(odd), decontaminate.contamination(odd, bench)):
        assert found.count() == n


def test_empty_tables(odd, bench):
    import public_tokenizers

    none = odd.limit(0)
    path = public_tokenizers.path("byte_bpe_50k.json")
    for found in (simhash.near_duplicates(none), simhash.without_copies(none), recompress.remove_repeats(none), tokens.token_counts(none, path), private.find_spans(none), language_model.score_documents(none), quality.quality(none), mixing.mix(none), mixing.mixed_documents(none), decontaminate.contamination(none, bench), tokens.token_files(none.sparkSession, none)):
        assert found.count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_simhash(odd):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert {c for i, fp, c in got if fp == 0} == {0}
    assert {c for i, _, c in got if i in (6, 7)} >= {6}
    assert all(c is not None for _, _, c in got)


def test_simhash_hot_cells(spark, monkeypatch):
    """Many fingerprints near one, dealt over blocks and read in several batches, give the links of a comparison of all."""
    monkeypatch.setattr(simhash, "HOME_BLOCK", 64)
    rng = np.random.default_rng(5)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 1500:
        x = 0x0123456789ABCDEF
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    fps = np.array(sorted(fps), np.uint64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    points = spark.createDataFrame([(int(np.int64(x.astype(np.int64))), int(np.int64(x.astype(np.int64)))) for x in fps], "node long, fp long")
    for bits in (3, 7):
        edges = simhash.links(points, bits).collect()
        near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits) & ~np.eye(len(fps), dtype=bool)
        label = np.arange(len(fps))
        while True:
            new = np.minimum(label, np.where(near, label[None, :], len(fps)).min(axis=1))
            if (new == label).all():
                break
            label = new
        at = {int(x.astype(np.int64)): k for k, x in enumerate(fps)}
        own = np.arange(len(fps))
        for e in edges:
            a, b = own[at[e.src]], own[at[e.dst]]
            own[own == max(a, b)] = min(a, b)
        assert (own == label).all()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_a_chain(spark):
    from colloquy.llm.components import connected_components

    chain = spark.range(0, 500).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(900, 901), (950, 950)], "src long, dst long"))
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {k: 0 for k in range(501)} | {900: 900, 901: 900}
    assert connected_components(chain.limit(0)).count() == 0


def test_without_copies(spark, odd):
    found = simhash.without_copies(odd)
    kept = [(r.doc_id, r.text) for r in found.collect()]
    assert found.columns == odd.columns
    kept = [x for x in kept if x[0] != 8]  # near SAME, but fingerprints of so few words may miss it
    # the first of the empty ones and of the copies of SAME; rows without a doc_id are behind; another text of doc_id 6 is judged on its own
    assert sorted(kept, key=repr) == sorted([(0, None), (3, "one"), (4, TEXTS[4]), (5, LONG), (6, SAME), (6, "other words"), (9, "a b"), (10, TEXTS[10]), (11, TEXTS[11])], key=repr)
    nameless = spark.createDataFrame([(None, SAME, "x"), (None, SAME, "y"), (None, "", "x"), (None, None, "y")], "doc_id long, text string, near_node string").drop("near_node")
    assert sorted(r.text or "" for r in simhash.without_copies(nameless).collect()) == ["", SAME]


def test_without_copies_is_exact(spark):
    """None goes that isn't linked to a smaller one by pairs with a Jaccard similarity of 0.8 or more; some pairs lie just on either side. Fingerprints miss some candidates, so a few copies may stay."""
    rng = np.random.default_rng(11)
    texts = []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(120)]
        for member in range(14):
            words = list(base)
            for k in rng.choice(60, 2 + member % 2, replace=False):  # one or two apart link, more do not
                words[2 * int(k)] = f"x{family}y{member}z{k}"
            texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    share = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    near, label = share >= 0.8, np.arange(len(texts))
    while True:
        new = np.where(near, label[None, :], len(texts)).min(axis=1)
        if (new == label).all():
            break
        label = new
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.without_copies(docs).collect()}
    assert set(label.tolist()) <= kept and len(kept) < len(texts)


def test_exact_links():
    """A pair just below 0.8 is no link; one at 0.8 is."""
    sets = [np.arange(90), np.arange(10, 100), np.arange(11, 101)]
    zero = np.zeros((3, 2), np.uint64)
    assert simhash.exact_links(np.array([1, 2, 3]), zero, sets, np.zeros(3, bool)) == [(1, 2), (2, 3)]
    assert simhash.exact_links(np.array([1, 3]), zero[:2], [sets[0], sets[2]], np.zeros(2, bool)) == []
    assert simhash.exact_links(np.array([1, 2, 3]), zero, sets, np.array([False, False, True])) == [(2, 3)]
    far = np.array([[0, 0], [(1 << 20) - 1] * 2, [1023, (1 << 20) - 1]], np.uint64)  # 40, 30 and 10 bits apart
    assert simhash.exact_links(np.array([1, 2, 3]), far, [sets[0]] * 3, np.zeros(3, bool)) == [(1, 3), (2, 3)]


def near_families(families: int, members: int, seed: int) -> list[str]:
    """Copies of some texts with one to seven words exchanged: pairs on both sides of 0.8."""
    rng, texts = np.random.default_rng(seed), []
    for family in range(families):
        base = [f"f{family}w{int(k)}" for k in rng.integers(0, 400, 150)]
        for member in range(members):
            words = list(base)
            for k in rng.choice(150, 1 + member % 7, replace=False):
                words[int(k)] = f"x{family}y{member}z{k}"
            texts.append(" ".join(words))
    return texts


def test_components_of_a_star_and_random_links(spark):
    from colloquy.llm.components import connected_components

    rng = np.random.default_rng(5)
    links = [(7, k) for k in range(8, 400)] + [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 300, (90, 2))]
    label = {x: x for link in links for x in link}
    for _ in links:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: label[x] for a, b in links if a != b for x in (a, b)}


def exact_components(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are near copies by comparing all, and each text's component."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (t.encode().lower().split() for t in texts)]
    near, held = np.eye(len(texts), dtype=bool), {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common: dict = {}
        for x in s:
            for j in held[x]:
                common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            near[i, j] = 5 * n >= 4 * (len(s) + len(sets[j]) - n)
    label = np.arange(len(texts))
    while True:
        new = np.where(near, label[None, :], len(texts)).min(axis=1)
        if (new == label).all():
            return near, label
        label = new


def test_near_copies_in_blocks(spark, monkeypatch):
    """A large group that is cut into many blocks gives the components of comparing all pairs, but for candidates that no fingerprint shows."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 8)
    texts = near_families(3, 60, 5)
    _, label = exact_components(texts)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.without_copies(docs).collect()}
    wanted = set(label.tolist())
    assert wanted <= kept and len(kept - wanted) <= 0.02 * len(texts)


def test_recall_of_near_copies(spark):
    """Of all pairs of sf0.01 at 0.8 or more, and of made ones, 0.95 or more end in one component; nothing below does but by a chain."""
    found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts = list(dict.fromkeys([r.text or "" for r in found] + near_families(80, 10, 9)))
    near, label = exact_components(texts)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = simhash.near_copies(docs).collect()
    own = {r["first"]: r.component for r in rows}
    i, j = np.nonzero(np.triu(near, 1))
    assert len(i) > 300
    recall = np.mean([own[int(a)] == own[int(b)] for a, b in zip(i, j, strict=True)])
    print("recall of pairs:", recall, len(i))
    assert recall >= 0.95
    for component in {r.component for r in rows}:
        assert len({int(label[k]) for k, c in own.items() if c == component}) == 1


def edited(words: list[str], other: list[str], kind: str, share: float) -> list[str]:
    """words with an edit that leaves about share of the five-word shingles in common."""
    n = len(words)
    k = max(1, round(n * (1 - share)))
    if kind == "cut":
        return words[: n - k]
    if kind == "appended":
        return words + other[: max(1, round(n * (1 / share - 1)))]
    k = max(1, round(n * (1 - share) / (1 + share)))
    if kind == "end replaced":
        return words[: n - k] + other[:k]
    if kind == "middle replaced":
        return words[: n // 3] + other[:k] + words[n // 3 + k :]
    out = list(words)
    for j in np.random.default_rng(n).choice(n, max(1, round(k / 5)), replace=False):
        out[int(j)] = other[int(j) % len(other)]
    return out


def test_recall_of_block_edits(spark):
    """Pairs of texts of which one is edited in a block or in single words: in each band of similarity, kind of edit and length 0.9 or more are joined."""
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").collect()]
    stock = [w for t in texts for w in t]
    rng, pairs = np.random.default_rng(8), []
    for length in (30, 60, 150, 500, 1000):
        for kind in ("cut", "appended", "end replaced", "middle replaced", "spread"):
            for low in (0.8, 0.85, 0.9, 0.95):
                for k in range(24):
                    a, b = (int(x) for x in rng.integers(0, len(stock) - 2000, 2))
                    words = stock[a : a + length]
                    other = edited(words, stock[b : b + length], kind, low + 0.05 * k / 24)
                    x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in ([w.lower() for w in words], [w.lower() for w in other]))
                    alike = len(x & y) / len(x | y)
                    if 0.8 <= alike < 1:
                        pairs.append((length, kind, min(int(alike * 20), 19), " ".join(words), " ".join(other)))
    docs = spark.createDataFrame([(2 * k + side, p[3 + side]) for k, p in enumerate(pairs) for side in (0, 1)], "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.without_copies(docs).select("doc_id").collect()}
    assert all(2 * k in kept or 2 * k + 1 not in kept for k in range(len(pairs)))
    met = {}
    for k, (length, kind, band, *_) in enumerate(pairs):
        for cell in ((length, kind), (kind, band), (length, band)):
            met.setdefault(cell, []).append(2 * k + 1 not in kept)
    print({c: (round(float(np.mean(v)), 3), len(v)) for c, v in met.items()})
    assert len(pairs) > 1500 and min(np.mean(v) for v in met.values() if len(v) >= 20) >= 0.9


def test_recompression(odd):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in recompress.remove_repeats(odd).collect()]
    assert (7, 30, 30, "") in got and (8, 31, 30, "tail") in got and (None, 30, 0, SAME) in got
    assert got.count((6, 30, 0, SAME)) == 3 and (5, 60_000, 0, LONG) in got
    assert (10, 300, 0, ("le " * 300).strip()) in got


def test_recompression_adjacent_repeats(spark):
    """Neighbours in one partition whose windows all have one best symbol: each must be known as its owner."""
    rows = [(1, "spam " * 40), (2, "spam " * 60), (3, "a line again " * 20), (4, "a line again " * 30 + "x")]
    docs, partitions = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = {r.doc_id: (r.n_removed, r.kept) for r in recompress.remove_repeats(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert got == {1: (0, " ".join(["spam"] * 40)), 2: (60, ""), 3: (0, " ".join(["a line again"] * 20)), 4: (90, "x")}


def test_token_files_round_trip(spark, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    entries = tokens.write_token_files(odd, path, f"file://{tmp_path}/t")
    assert tokens.write_token_files(odd, path, f"file://{tmp_path}/t") == entries  # a rerun leaves the same files
    got = tokens.read_token_files(spark, f"file://{tmp_path}/t", entries).collect()
    library = Tokenizer.from_file(path)
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]
    assert [r.doc_id for r in ordered if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"])
def test_counts_as_the_library(odd, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    whole = tokens.Encoder(path).whole
    assert sorted(r.n_tokens for r in tokens.token_counts(odd, path).collect()) == sorted(len(whole(r.text or "")) for r in odd.collect())


def test_words_as_the_library(monkeypatch):
    import random

    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CACHE_WORDS", 200)  # generations change often
    own = tokens.Worker(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, common = own.encoder, ["a", "Bc", "", "a!", "\x01a"]
    rng = random.Random(1)
    parts = [" ", " ", " ", " ", "  ", "\n", "\n", "\t", "a", "Bc", "'s", "!", "12", "é", "日", "\xa0", "\x01", "<|endoftext|>", "\r\n", "ǅ", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    for k in range(0, len(texts), 250):
        some = texts[k : k + 250]
        own.frequent = tokens.Frequent(common, tokens.Known(encoder).ids(common)) if k % 500 else None
        ids, counts = tokens._with_ends(pa.array(some), own, 0)
        ends = counts.cumsum()
        for text, n, end in zip(some, counts, ends, strict=True):
            assert ids[end - n : end].tolist() == [*encoder.whole(text), 0], text
    assert tokens.cuttable(pa.array(texts), encoder).sum() > 500


def test_contamination(odd, bench, monkeypatch):
    marks = lambda: sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(odd, bench).collect())
    once = marks()
    # the item "one" has no id, so its window counts and names no item
    assert (True, 7, 30, 30, [1]) in once and (True, 9, 2, 2, [2]) in once and (True, 3, 1, 1, []) in once
    kept = decontaminate.clean_documents(odd, bench)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 4, 5, 6, 10, 11, None}
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 200)
    assert marks() == once  # in several passes


def test_windows_of_one_hash(monkeypatch):
    """Windows with one hash are told apart by their words."""
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "window_hashes", lambda hashes, n: np.full(max(0, len(hashes) - n + 1), 7, np.uint64))
    known = decontaminate.Windows(pa.table({"width": pa.array([2, 2, 1], pa.int32()), "hash": pa.array([7, 7, 7], pa.int64()), "words": pa.array([b"a b", b"b c", b"d"], pa.binary()), "items": pa.array([[1], [2, 3], []], pa.list_(pa.int64()))}))
    hit, items = decontaminate.hit_words([b"a", b"x", b"b", b"c", b"d"], np.zeros(5, np.uint64), known)
    assert hit.tolist() == [False, False, True, True, True] and items == {2, 3}


MEASURE = """
import os, pickle, resource, sys
import numpy as np, pyarrow as pa
from colloquy.llm import decontaminate
n = 1 << 20
rng = np.random.default_rng(1)
words = [b" ".join(b"%06d" % k for k in row) for row in rng.integers(0, 10**6, (n, 13)).tolist()]
size = sum(map(len, words)) + (8 + decontaminate.WINDOW_BYTES) * n
rows = pa.table({"width": pa.array(np.full(n, 13, np.int32)), "hash": pa.array(rng.integers(0, 1 << 62, n)), "words": pa.array(words, pa.binary()), "items": pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(np.arange(n)))})
with open(sys.argv[1], "wb") as f:
    pickle.dump(decontaminate.Windows(rows), f, 5)
print(size)
"""
HOLD = """
import pickle, resource, sys
from colloquy.llm import decontaminate
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with open(sys.argv[1], "rb") as f:
    held = pickle.load(f)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_memory_of_windows(tmp_path):
    """A worker holds 2^20 windows in less than 300 MB, which is about what the bound of a broadcast counts for them."""
    import subprocess
    import sys

    run = lambda code: int(subprocess.run([sys.executable, "-c", code, str(tmp_path / "windows")], capture_output=True, text=True, check=True).stdout)
    counted = run(MEASURE)
    held = run(HOLD) * 1024
    assert held < 300e6 and held < 2 * counted


def test_clean_documents_lose_spans(spark, bench, monkeypatch):
    """Below a twentieth of its words a document stays and loses the passage, in one pass as in several."""
    before, after = " ".join(f"b{k}" for k in range(400)), " ".join(f"c{k}." for k in range(400))
    docs = spark.createDataFrame([(1, f"{before}; A, B! {after}", 9), (2, f"{before} é {after}", 9), (None, None, None), (4, "", 0)], "doc_id long, text string, n_chars int")
    want = sorted([(1, f"{before}; {after}", len(before) + 2 + len(after)), (2, f"{before} é {after}", 9), (None, None, None), (4, "", 0)], key=repr)
    assert sorted((tuple(r) for r in decontaminate.clean_documents(docs, bench).collect()), key=repr) == want
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == 4 and decontaminate.clean_documents(docs.limit(0), bench).count() == 0
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 200)
    assert sorted((tuple(r) for r in decontaminate.clean_documents(docs, bench).collect()), key=repr) == want


def test_secrets_are_judged_whole(spark):
    """What comes after many digits counts too."""
    docs = spark.createDataFrame([(1, "x " + "1" * 70 + "abcdef y"), (2, "x " + "1" * 20 + "abcdef y")], "doc_id long, text string")
    got = docs.select(private.candidates(F.col("text")).alias("c")).select(private.ballot(F.col("c")[0]).alias("votes"), private.traits(F.col("c")[0])[0].alias("form")).collect()
    assert {tuple(r) for r in got} == {("10--", "form:hex")}


def test_clean_documents_in_passes(spark, odd, bench, monkeypatch):
    """A large benchmark changes no verdict: rows without a doc_id go, clean rows stay beside a contaminated one of their doc_id."""
    kept = lambda: sorted(map(repr, decontaminate.clean_documents(odd, bench).collect()))
    once = kept()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 200)
    assert kept() == once
    rows = [(r.doc_id, r.text) for r in decontaminate.clean_documents(odd, bench).collect()]
    assert (None, SAME) not in rows and (6, "other words") in rows and (6, SAME) not in rows


def test_mixing(odd):
    got = mixing.mix(odd).collect()
    for source in (None, "s"):
        own = [r for r in got if r.source == source]
        assert len({r.mix_target for r in own}) == 1
        assert abs(sum(r.mix_copies * r.mix_size for r in own) - own[0].mix_target) <= max(r.mix_size for r in own)
    assert all(0 <= r.mix_copies <= 2 for r in got)
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mixing_tree(spark, monkeypatch):
    """Many buckets and levels: each source still ends within one document of its target, and chances hold on average."""
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    docs = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), (F.col("id") % 4).cast("string"))).alias("source"), (F.col("id") % 37 + 1).alias("size"))
    got = mixing.decide(docs).collect()
    assert len(got) == 3000
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 38


def test_quality_edges(odd):
    judged = {r.doc_id: r for r in quality.quality(odd).collect()}
    assert all(0 <= r.score <= 1 and 0 <= r.label_posterior <= 1 for r in judged.values())
    assert quality.good_documents(odd).columns == odd.columns


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        counts.append(docs.count())
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4]
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))
