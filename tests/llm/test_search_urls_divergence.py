"""Ranked search, url filters and the divergence audit: odd rows, brute force, small bounds."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import divergence, lexical, urls


def least_cost(values, cost, longest):
    best = [0]
    for j in range(1, len(values) + 1):
        best.append(min(best[i] + (j - i) * max(values[i:j]) + cost for i in range(max(0, j - longest), j)))
    return best[-1]


@pytest.mark.parametrize("segment", [4096, 7])
def test_blocks_cost_least(segment):
    rng = np.random.default_rng(1)
    for _ in range(100):
        lengths = rng.integers(1, 30, rng.integers(1, 6))
        values, starts = rng.integers(1, 100, lengths.sum()), np.concatenate([[0], np.cumsum(lengths)])
        longest, cost = int(rng.integers(1, 12)), int(rng.integers(0, 300))
        ends = lexical.block_ends(values, starts, cost, longest, segment)
        begins = np.concatenate([[0], ends[:-1]])
        assert set(starts[1:].tolist()) <= set(ends.tolist()) and (ends - begins).max() <= longest
        got = sum((b - a) * values[a:b].max() + cost for a, b in zip(begins, ends, strict=True))
        pieces = [(a, min(a + segment, end)) for start, end in zip(starts[:-1], starts[1:], strict=True) for a in range(start, end, segment)]
        assert got == sum(least_cost(values[a:b].tolist(), cost, longest) for a, b in pieces)


def searched(docs, items, k=10):
    """Each item's best by scoring all."""
    docs = [(i, Counter(own), len(own)) for i, text in docs for own in [[w.decode() for w in lexical.folded(text)]]]
    n, total = sum(size > 0 for *_, size in docs), sum(size for *_, size in docs)
    holding = Counter(t for _, own, _ in docs for t in own)
    out = []
    for item, text in items:
        scores = []
        for i, own, size in docs:
            score = 0
            for word in lexical.folded(text):
                tf = own[word.decode()]
                if tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * holding[word.decode()] + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * (25 + 75 * size * n // total)))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if missing else i, -s) for rank, (s, missing, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ODD = [(1, None), (2, ""), (3, "The cat, the mat"), (3, "the cat the mat"), (None, "cat"), (5, "dog " * 5000 + "cat"), (6, "ÉTÉ été 12 x"), (7, "-- !!"), (8, "cat"), (4, "cat"), (4, "cat")]
ASKED = [(1, "cat mat"), (2, None), (3, ""), (None, "été cat"), (1, "dog dog cat"), (9, "nowhere"), (10, "the the the x 12")]


def test_search_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, query string, score int")
    asked = spark.createDataFrame([(i, t, 0) for i, t in ASKED], "item_id long, text string, rank int")
    got = lexical.ranked_search(docs, asked)
    assert got.columns == ["query", "item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r)[1:] for r in got.collect()), key=repr) == searched(ODD, ASKED)
    assert lexical.ranked_search(docs.limit(0), asked).count() == 0 and lexical.ranked_search(docs, asked.limit(0)).count() == 0


def test_search_in_small_shards_and_passes(spark, monkeypatch):
    """Many shards and ranges skipped: the best by scoring all, and fewer documents scored than hold a term."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    chance = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words, rng.integers(1, 80), p=chance / chance.sum())) for _ in range(1500)]
    docs = [(int(k) // 2, t) for k, t in zip(rng.permutation(1500), texts, strict=True)] + [(9000 + k, texts[0]) for k in range(40)]
    asked = [(k, " ".join(rng.choice(words, 6))) for k in range(25)] + [(77, texts[0])]
    for name, value in (("SHARD_POSTINGS", 3000), ("PASS_TERMS", 40), ("FIRST_RANGES", 4), ("CLAIMS", 16), ("SEGMENT", 50)):
        monkeypatch.setattr(lexical, name, value)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lexical.ranked_search(frame, spark.createDataFrame(asked, "item_id long, text string"))
    assert sorted((tuple(r)[1:] for r in got.collect()), key=repr) == searched(docs, asked)


def test_ranges_are_skipped():
    rng = np.random.default_rng(2)
    docs = [np.flatnonzero(rng.random(20_000) < share).astype(np.int32) for share in (0.5, 0.02, 0.001)]
    values = [np.sort(rng.integers(100_000, 900_000, len(d)))[rng.permutation(len(d))] for d in docs]
    shard = lexical.Shard(np.repeat([4, 7, 9], list(map(len, docs))), np.concatenate(docs), np.concatenate(values), 10)
    top = lexical.Best(10)
    top.known = np.arange(20_000), np.zeros(20_000, bool)
    weights = np.array([20, 3000, 6000])
    scored, holding = shard.answer(np.array([4, 7, 9]), weights, top)
    total = np.zeros(20_000, np.int64)
    for w, d, v in zip(weights, docs, values, strict=True):
        total[d] += w * v
    best = np.lexsort((np.arange(20_000), -total))[:10]
    assert top.ids.tolist() == best.tolist() and top.scores.tolist() == total[best].tolist()
    assert scored < holding / 10


def test_norms_beyond_64_bits():
    n = np.array([10**12, 5])
    assert lexical.norms(n, 10**9, 10**14).tolist() == [25 + 75 * 10**21 // 10**14, 25]


URLS = [None, "", "no host", "http://A.Example.NET/en/x?y#z", "https://net/", "http://x.net", "ftp://u.example.com/de/", "http://example.com/DE/", "http://notexample.net/en/", "http://a.org/fr/1", "http://b.org?q=/fr/", "://", "x://y://z/w", "http://ÜÄ.net/p#?", "http://h.com/" + "a" * 100_000, "http://example.net/en/x\n#y"]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p) for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_urls_of_odd_rows(spark):
    rows = [(k, u, "old", 1.0) for k, u in enumerate(URLS)] + [(3, URLS[3], "old", 1.0), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, suffix1 double")
    got = urls.filtered(pages).collect()
    assert len(got) == len(rows) and {r.suffix1 for r in got} == {1.0, None}
    verdicts = {h + p: what for what, h, p in urls.RULES}
    for r in got:
        assert (r.host, r.path, r.rule) == plain_url(r.url)
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdicts[r.rule])
    assert urls.filtered(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.filtered(pages, rules=()).collect()} == {"allow"}
    one = spark.createDataFrame([("http://q.com/", 1)], "url string, blocked int")
    assert {r.verdict for r in urls.filtered(pages, (), one).collect()} == {"block"}


def test_op12(spark, sf):
    got = urls.op12_url_filters(spark, sf).collect()
    known = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert sorted(r.page_id for r in got) == sorted(known)
    for r in got:
        assert (r.host, r.path, r.rule) == plain_url(known[r.page_id])


def made_urls(n, seed):
    """Labelled by what a url looks like, one in fifty the wrong way; suffixes say nothing."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        bad = rng.random() < 0.4
        word = lambda k, digits: "".join(rng.choice(list("abcdefghij0123456789" if digits else "etaoinshrdlu"), k))
        host = f"{word(rng.integers(10, 24) if bad else rng.integers(4, 12), bad)}.{rng.choice(['com', 'org', 'net'])}"
        path = "/".join(word(rng.integers(3, 10), bad and rng.random() < 0.7) for _ in range(rng.integers(2, 7) if bad else rng.integers(1, 4)))
        query = "?" + "&".join(f"{word(2, False)}={word(5, True)}" for _ in range(rng.integers(2, 6))) if bad and rng.random() < 0.5 else ""
        out.append((f"http://{host}/{path}{query}", int(bad) if rng.random() > 0.02 else int(not bad), int(bad)))
    return out


def test_trees_on_urls_not_seen(spark):
    learnt = spark.createDataFrame([r[:2] for r in made_urls(2000, 1)], "url string, blocked int").repartition(5)
    asked = spark.createDataFrame([(r[0], r[2]) for r in made_urls(600, 2)], "url string, truth int")
    got = urls.filtered(asked, (), learnt).collect()
    assert np.mean([(r.verdict == "block") == bool(r.truth) for r in got]) >= 0.95
    again = urls.filtered(asked, (), learnt.repartition(2)).collect()
    assert sorted((r.url, r.score) for r in again) == sorted((r.url, r.score) for r in got)


def test_entropy(spark):
    texts = ["", "aaaa", "abab", "aé日b", "http://x.y/z?1=2"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(urls.entropy(F.col("t"))).collect()]
    for text, value in zip(texts, got, strict=True):
        own = Counter(c if c < "\x80" else "\x80" for c in text)
        assert value == pytest.approx(sum(n / len(text) * math.log2(len(text) / n) for n in own.values()))


def audited(rows, least=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(lang, source, [t.decode() for t in divergence.terms_of(text)]) for lang, source, text in rows]
    holding = Counter((lang, t) for lang, _, own in words for t in set(own))
    kept = {lang: sorted(t for (l, t), n in holding.items() if l == lang and n >= least) for lang in {r[0] for r in rows}}
    counts: dict = {}
    for lang, source, own in words:
        group = counts.setdefault((lang, source), Counter())
        group.update(t for t in own if holding[lang, t] >= least)
    whole = {lang: sum((c for (l, _), c in counts.items() if l == lang), Counter()) for lang in kept}
    p = lambda c, t, v: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)
    gap = lambda a, b: (a - b) ** 2 // b
    out = []
    for (lang, source), c in counts.items():
        v = len(kept[lang])
        pairs = [(-sum(gap(p(c, t, v), p(d, t, v)) for t in kept[lang]), other) for (l, other), d in counts.items() if l == lang and other != source]
        terms = [(-gap(a, b), t) for t in kept[lang] if c[t] for a, b in [(p(c, t, v), p(whole[lang], t, v))] if a > b]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


ROWS = [(None, None, None), ("en", "a", "The the cat. cat9dog"), ("en", "b", "the CAT été"), ("en", "b", "the cat dog ÉTÉ"), ("en", "c", None), ("en", None, "the dog " * 3000), ("en", "d e", "dog"), ("fr", "a", "un"), ("fr", "b", "deux"), ("", "a", "x"), ("en", "a", "The the cat. cat9dog"), ("xx", "only", "z z z"), ("xx", "only", "z"), ("xx", "only", "z y")]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_of_odd_rows(spark, monkeypatch, small):
    rows = list(ROWS)
    if small:  # several automata, buckets, tiles and flushes
        for name, value in (("AUTOMATON_BYTES", 100), ("BUCKET_TERMS", 4), ("TILE", 2), ("HELD_TERMS", 20), ("HELD_WORDS", 30)):
            monkeypatch.setattr(divergence, name, value)
        rng = np.random.default_rng(4)
        rows += [("de", f"s{int(rng.integers(7))}", " ".join(f"w{'abcdefghij'[k % 10]}{'klmno'[k % 5]}" for k in rng.integers(0, 50, 20))) for _ in range(120)]
    docs = spark.createDataFrame([(*r, k, 1) for k, r in enumerate(rows)], "lang string, source string, text string, value int, item int").repartition(3)
    got = divergence.divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(rows)
    assert divergence.divergence(docs.limit(0)).count() == 0
    assert max(r["rank"] for r in divergence.divergence(docs, 1, 2).where("part = 'term'").collect()) == 2


def test_chances_beyond_64_bits():
    counts, below = np.array([[10**12, 0]]), np.array([[3 * 10**12]])
    assert divergence.chances(counts, below).tolist() == [[1 + 10**9 * (10**12 + 1) // (3 * 10**12), 1]]
