"""The numbered queries against plain Python on whole small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
import xxhash

from colloquy.llm import queries as Q
from compare import connect, rows


@pytest.fixture(scope="module")
def docs(sf):
    t = ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()
    return {r["doc_id"]: r for r in t}


def collected(spark, sf, name):
    got = Q.QUERIES[name](spark, sf).collect()
    keyed = {r.doc_id: r for r in got}
    assert len(keyed) == len(got)
    return keyed


def test_op1(spark, sf, docs):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = {i: fingerprint(r["text"]) for i, r in docs.items()}
    least = {i: i for i in docs}
    while True:
        new = {i: min(least[j] for j in docs if (prints[i] ^ prints[j]).bit_count() <= 3) for i in docs}
        if new == least:
            break
        least = new
    got = collected(spark, sf, "op1_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", least[i]) for i in docs}


def test_op2(spark, sf, docs):
    words = {i: (r["text"] or "").encode().split() for i, r in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    want = {}
    for i, w in words.items():
        drop = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                drop[k : k + 13] = [True] * 13
        want[i] = len(w), sum(drop), hashlib.sha256(b" ".join(x for x, d in zip(w, drop, strict=True) if not d)).hexdigest()
    got = collected(spark, sf, "op2_recompression")
    assert {i: tuple(r)[1:] for i, r in got.items()} == want


@pytest.fixture(scope="module")
def encoded(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: t.encode(r["text"] or "", add_special_tokens=False).ids for i, r in docs.items()}


def test_op3(spark, sf, encoded):
    want, start = {}, 0
    for i in sorted(encoded):
        ids = encoded[i] + [0]
        want[i] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    got = collected(spark, sf, "op3_token_files")
    assert {i: (r.start, r.n_tokens, r.ids_crc32) for i, r in got.items()} == want


def test_op4(spark, sf, docs, encoded):
    got = collected(spark, sf, "op4_token_counts")
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: (len((r["text"] or "").encode()), len(encoded[i]), len(encoded[i]) > 1024) for i, r in docs.items()}


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(match):
    d = [int(c) for c in match if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def private(text):
    kinds = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", CARD, luhn), ("phone", PHONE, lambda m: 9 <= sum(c.isdigit() for c in m) <= 15))
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in p.finditer(text or "") if ok(m[0])]


def test_op5(spark, sf, docs):
    for i, r in collected(spark, sf, "op5_private").items():
        spans = private(docs[i]["text"])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = collections.Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)


def test_op5_edges(spark):
    from colloquy.llm.private import KINDS, find_spans

    odd = ["a@b.c_d@e.f x@y..z q@w.e.r. a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4 99999999999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 20000, "+1 (652) 555-5229 +12 +1234567890123456", "", None, "é@x.y 日本a@b.co 😀+1--2 12345678 ", "a" * 200_000 + "@b.c"]
    df = spark.createDataFrame([(i, x, "no") for i, x in enumerate(odd)], "doc_id long, text string, base string")
    got = {r.doc_id: [(KINDS[s.kind], s.s, s.e) for s in r.base] for r in find_spans(df).collect()}
    assert got == {i: private(x) for i, x in enumerate(odd)}
    secret = spark.createDataFrame([(k, f"the password={'0123456789abcdef' * 2}{k} and 42 of 1234567 words") for k in range(20)], "doc_id long, text string")
    assert all(len(r.secrets) == 1 for r in find_spans(secret).collect())
    assert find_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    con = connect(sf)
    got, want = Q.QUERIES[name](spark, sf).toPandas(), con.sql(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_op6_edges(spark):
    from colloquy.llm.topk import top_k, vectors

    rng = np.random.default_rng(3)
    v = [(k, [float(x) for x in rng.normal(size=8) * (1 + k % 5)]) for k in range(300)] + [(300 + k, [1.0] * 8) for k in range(40)]
    v += [(None, [0.5] * 8), (400, None), (401, [float("nan")] + [0.0] * 7), (402, [None] + [0.0] * 7), (403, [float("inf")] + [0.0] * 7)]
    found = vectors(spark.createDataFrame(v, "vec_id long, embedding array<double>"))
    got = {}
    for r in top_k(found, found.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = {k: np.floor(64 * np.array(e)) for k, e in v if k is not None and k < 400}
    want = {q: [(i + 1, c, int(s)) for i, (s, c) in enumerate(sorted(((-(x[q] @ x[c]), c) for c in x if c != q))[:5])] for q in x if q % 20 == 0}
    assert {q: sorted(g) for q, g in got.items()} == {q: [(i, c, -s) for i, c, s in w] for q, w in want.items()}
    assert top_k(found.limit(0), found.limit(0)).count() == 0
    few = found.where("vec_id < 3")
    assert top_k(few, few.where("vec_id = 0"), 5).count() == 2


@pytest.mark.parametrize("skew", [0, 1])
def test_op6_many_blocks(spark, monkeypatch, skew):
    """Many small blocks, lengths that differ widely or are all alike, repeated rows, bounds below nothing: the answer of all products."""
    from colloquy.llm import topk as T

    monkeypatch.setattr(T, "BLOCK", 16)
    monkeypatch.setattr(T, "PILOT", 8)
    monkeypatch.setattr(T, "SLICE_BLOCKS", 2)
    rng = np.random.default_rng(9)
    v = np.floor(rng.normal(size=(300, 12)) * 8 * (np.exp(rng.normal(size=(300, 1))) if skew else 1))
    v[200:240] = v[7]
    v[250] = 0
    points = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    rows_ = T.vectors(points, 1)
    got = sorted(tuple(r) for r in T.top_k(rows_, rows_.where("vec_id % 5 = 0"), 6).collect())
    want = []
    for q in range(0, 300, 5):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-int(v[i] @ v[q]), i))[:6]
        want += [(q, k + 1, i, int(v[i] @ v[q])) for k, i in enumerate(order)]
    assert got == want
    assert T.top_k(rows_, rows_.where("vec_id < 0"), 6).count() == 0



def test_op7(spark, sf, docs):
    words = {i: (r["text"] or "").encode().lower().split() + ["end"] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = collected(spark, sf, "op7_language_model")
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words[i]), sum(c[w] > 0 for w in words[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i]), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    want = backed_off({i: ws[:-1] for i, ws in words.items()}, held, 3)
    assert all(r.score == pytest.approx(want[i], rel=1e-9) for i, r in got.items())


def backed_off(words, held, order):
    """log10 probabilities of the texts by plain recursion over counted n-grams; None stands for an end."""
    from colloquy.llm.language_model import PRIOR_TOKENS, STATE_COUNT

    grams = [collections.Counter() for _ in range(order + 1)]
    texts = {i: [None, *ws, None] for i, ws in words.items()}
    for i, ws in texts.items():
        if not held[i]:
            for k in range(1, order + 1):
                grams[k].update(tuple(ws[p - k + 1 : p + 1]) for p in range(1, len(ws)) if p - k + 1 >= 0)
    total, vocabulary = sum(grams[1].values()), len(grams[1])

    def chance(history, word):
        lower = chance(history[1:], word) if history else None
        if lower is None:
            return (grams[1][(word,)] + 1) / (total + vocabulary + 1)
        passed, prior = grams[len(history)][history], PRIOR_TOKENS[len(history) + 1]
        return (grams[len(history) + 1][(*history, word)] + prior * lower) / (passed + prior) if passed >= (STATE_COUNT if len(history) > 1 else 1) else lower

    return {i: sum(math.log10(chance(tuple(ws[max(0, p - order + 1) : p]), ws[p])) for p in range(1, len(ws))) for i, ws in texts.items()}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_op7_orders(spark, monkeypatch, order):
    """Scores of the automaton are those of the recursion, with many groups, parts of the hashes and runs."""
    from colloquy.llm import language_model as L

    monkeypatch.setattr(L, "GROUP_BYTES", 3000)
    monkeypatch.setattr(L, "PART_BYTES", 1500)
    monkeypatch.setattr(L, "RUN", 7)
    rng = np.random.default_rng(4)
    words = {k: [f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 97] for k in range(150)}
    words[150] = words[3] * 20
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in words.items()], "doc_id long, text string")
    got = {r.doc_id: r.score for r in L.score_documents(docs, order).collect()}
    want = backed_off(words, held, order)
    assert got == {i: pytest.approx(x, rel=1e-9) for i, x in want.items()}


def test_op7_states_sum_to_one():
    """From any history the chances of all known tokens, of the end and of an unknown one sum to 1."""
    import pyarrow as pa

    from colloquy.llm.language_model import PRIOR_TOKENS, Automaton, Grams, are_states

    train = ("a b a c a b b c d a b a " * 9).split()
    for history in ("", "a", "b a", "c a", "zz", "a zz"):
        total = 0.0
        texts = [" ".join(train)] + [f"{history} {w}".strip() for w in ("a", "b", "c", "d", "unknown")] + [history]
        grams, first = Grams(pa.array(texts)), np.arange(len(texts)) == 0
        grams.add(2)
        grams.add(3, are_states(2, grams.counts(first)[2]))
        counts = grams.counts(first)
        scores = Automaton(grams, counts, len(train) + 1, 5, PRIOR_TOKENS).traverse()
        whole = Automaton(grams, counts, len(train) + 1, 5, PRIOR_TOKENS)
        for k in range(1, len(texts)):
            last = grams.ends[k] if k == len(texts) - 1 else grams.ends[k] - 1
            # the last token's own weight: the text up to it less the text up to the one before
            full = score_to(whole, grams, k, last) - score_to(whole, grams, k, last - 1)
            total += 10**full
        assert total == pytest.approx(1.0) and len(scores) == len(texts)


def score_to(automaton, grams, k, last):
    """Score of text k up to a token."""
    import copy

    cut = copy.copy(automaton)
    start = grams.ends[k] - grams.sizes[k] + 1
    if last < start:
        return 0.0
    cut.ends, cut.sizes = np.array([last]), np.array([last - start + 1])
    return cut.traverse()[0]


def test_op8(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in ds.dataset(f"{sf}/labels.parquet").to_table().to_pylist()}
    got = collected(spark, sf, "op8_quality")
    right = [got[i].keep == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.93


def plain_quality(texts):
    """Posterior and score of each text, in plain Python: counted words, Bayes' rule over votes, one weight at a time."""
    common = set("the of and to in a is that it for on was be with as by at this an are or de la que el en los y se las un una del le et les des du est der die und das den von zu mit ist ein eine".encode().split())
    symbols = {b for b in range(33, 127) if not (chr(b).isalnum() or chr(b) in ".,'\"-()+@:;?")}

    def measured(data):
        ws = data.split()
        n, size = len(ws), max(1, len(data))
        upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
        return ws, {
            "repetition": sum(ws[i] == ws[i - 1] for i in range(1, n)) / max(1, n), "variety": sum(len(set(ws[i : i + 100])) for i in range(0, n, 100)) / max(1, n),
            "symbols": sum(b in symbols for b in data) / size, "capitals": upper / max(1, upper + lower), "word_length": (size - n) / max(1, n),
            "function_words": sum(w in common for w in ws) / max(1, n), "sentence_ends": sum(w[-1:] in (b".", b"!", b"?") for w in ws) / max(1, n), "length": n,
        }

    def opinion(m):
        n = m["length"]
        if n < 8:
            return (None,) * 7 + ((0,) if n == 0 else (None,))
        outside = lambda x, poor, good: 0 if x > poor else 1 if x < good else None
        length, ends, known = m["word_length"], m["sentence_ends"], m["function_words"]
        return (
            outside(m["repetition"], 0.15, 0.04), 0 if m["variety"] < 0.4 else 1 if m["variety"] > 0.55 else None, outside(m["symbols"], 0.05, 0.01), outside(m["capitals"], 0.3, 0.1),
            0 if length < 2 or length > 9 else 1 if 3.5 <= length <= 6.5 else None, 0 if n >= 30 and known < 0.01 else 1 if known > 0.08 else None,
            0 if ends > 0.6 or n >= 200 and ends < 0.005 else 1 if 0.02 <= ends <= 0.35 else None, 1 if n >= 40 else None,
        )

    docs = {t: measured((t or "").encode()) for t in texts}
    said = {t: opinion(m) for t, (_, m) in docs.items()}
    prior, right = 0.8, [{1: 0.02, 0: 0.3} for _ in range(8)]  # right[j][c]: chance of a vote 0 given class c
    for _ in range(50):
        post = {}
        for t, v in said.items():
            likely = {c: (prior if c else 1 - prior) * math.prod(right[j][c] if x == 0 else 1 - right[j][c] for j, x in enumerate(v) if x is not None) for c in (0, 1)}
            post[t] = likely[1] / (likely[0] + likely[1])
        prior = min(0.999, max(0.001, (sum(post[t] for t in texts) + 1) / (len(texts) + 2)))
        for j in range(8):
            for c in (0, 1):
                weigh = lambda x: 1 + sum(post[t] if c else 1 - post[t] for t in texts if said[t][j] == x)  # noqa: E731, B023
                right[j][c] = weigh(0) / (weigh(0) + weigh(1))

    def form(w):
        kinds = ["A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b > 127 else "0" if 48 <= b <= 57 else chr(b) for b in w]
        return "".join(k for i, k in enumerate(kinds) if kinds[max(0, i - 2) : i] != [k, k]).encode()

    slot = lambda x, seed: xxhash.xxh64_intdigest(x, seed) % 65536

    def described(t):
        ws, m = docs[t]
        c = collections.Counter(x for w in ws for x in (slot(w.lower(), 1), slot(form(w), 2)))
        at = [(k, np.float32(c[k] / len(ws))) for k in sorted(c)]
        for name, x in m.items():
            k = math.floor(math.log2(1 + x)) if name == "length" else int(x / 2) if name == "word_length" else int(10 * x)
            at.append((slot(f"{name}:{min(9, k)}".encode(), 3), 0.5))
        return at

    found = {t: described(t) for t in docs}
    order = sorted(found, key=lambda t: (post[t], len(found[t]), [k for k, _ in found[t]]))
    weights, seen = collections.defaultdict(float), collections.defaultdict(lambda: 1e-6)
    total = lambda at: sum(weights[k] * float(x) for k, x in at)
    chance = lambda z: 1 / (1 + math.exp(-max(-40, min(40, z))))
    for k in range(8):
        for i in np.random.default_rng(k).permutation(len(order)):
            at = [*found[order[i]], (-1, 1.0)]
            off = chance(total(at)) - post[order[i]]
            now = {}
            for f, x in at:  # where a slot stands twice, the last counts
                g = off * float(x) + 1e-6 * weights[f]
                now[f] = (seen[f] + g * g, weights[f], g)
            for f, (s, w, g) in now.items():
                seen[f], weights[f] = s, w - 0.5 * g / math.sqrt(s)
    exact = {t: [(k, x if i >= len(found[t]) - 8 else float(x)) for i, (k, x) in enumerate(found[t])] for t in docs}
    return {t: (post[t], chance(total(exact[t]) + weights[-1])) for t in docs}


def test_op8_values(spark, sf, docs):
    want = plain_quality([r["text"] for r in docs.values()])
    got = collected(spark, sf, "op8_quality")
    assert set(got) == set(docs)
    for i, r in docs.items():
        posterior, score = want[r["text"]]
        assert got[i].label_posterior == pytest.approx(posterior, abs=1e-9)
        assert got[i].score == pytest.approx(score, abs=1e-5) and got[i].keep == (got[i].score >= 0.5)


def test_op8_long_words():
    from colloquy.llm.quality import ENDS, shape

    assert shape(b"Aaa111--" * 40) == b"Aaa00--" * 40 and shape("Éa!!!".encode()) == b"aa!!" and shape(b"") == b""
    assert len(ENDS.findall(b"a. b.c d! e? .f g.")) == 4


def test_op9(spark, sf, docs):
    got = collected(spark, sf, "op9_mix")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in docs.items()}
    total = collections.Counter()
    for i, r in docs.items():
        total[r["source"]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, full = {}, 1.5 * sum(total.values()), set()
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = [s for s in share if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            full.add(s)
    taken = collections.Counter()
    for i, r in got.items():
        s = docs[i]["source"]
        assert (r.size, r.source_size) == (size[i], total[s]) and r.target == pytest.approx(target[s])
        assert r.taken in (0, size[i], 2 * size[i])
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in docs if docs[i]["source"] == s)
    again = collected(spark, sf, "op9_mix")
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in again.items()}


def test_op10(spark, sf, docs):
    items = ds.dataset(f"{sf}/benchmark.parquet").to_table().to_pylist()
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for r in items:
        w = words(r["text"])
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].add(r["item_id"])
    got = collected(spark, sf, "op10_decontaminate")
    for i, r in docs.items():
        w = words(r["text"])
        hit, own = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit[k : k + n] = [True] * n
                    own |= found
        digest = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        assert tuple(got[i])[1:] == (len(w), sum(hit), len(own), digest, sum(hit) > 0 and 20 * sum(hit) >= len(w))
