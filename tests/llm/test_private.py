"""Spans that op5 adds, against invented texts whose secrets are known."""

import random

import pytest

from colloquy.llm.private import find_spans


def written_down(n, seed):
    """Texts with secrets in the ways they are written down, and tokens that look somewhat like them; where the secrets stand."""
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed = lambda k: "".join(rng.choice(letters + digits) for _ in range(k - 1)) + rng.choice(digits)
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k - 1)) + rng.choice(digits)
    secrets = [
        ("password: ", lambda: mixed(rng.randint(8, 14))), ("password=", lambda: mixed(12)), ("api_key = \"", lambda: mixed(32)), ("token=", lambda: hexa(40)), ("secret: ", lambda: mixed(24)),
        ("my key is ", lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + digits) for _ in range(15)) + rng.choice(digits)), ("use ", lambda: "ghp_" + mixed(36)), ("Authorization: Bearer ", lambda: mixed(40)), ("passwd=", lambda: mixed(10)),
        ("the password is ", lambda: mixed(rng.randint(8, 12))), ("log in with token ", lambda: hexa(32)), ("credentials admin / ", lambda: mixed(11)),
    ]
    plain = [
        ("order ", lambda: str(rng.randint(100000, 99999999))), ("on ", lambda: f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"), ("model ", lambda: f"XR{rng.randint(1000, 9999)}"), ("room ", lambda: f"B{rng.randint(10000, 99999)}"),
        ("page ", lambda: f"{rng.randint(1, 9)}-{rng.randint(10000, 99999)}"), ("about ", lambda: f"{rng.randint(100000, 999999)}km"), ("version ", lambda: f"v{rng.randint(10000, 99999)}"), ("years ", lambda: f"1990-{rng.randint(1991, 2024)}"), ("id=", lambda: str(rng.randint(100000, 9999999))),
        ("commit ", lambda: hexa(40)), ("file ", lambda: f"img_{hexa(16)}"), ("uuid ", lambda: "-".join(hexa(k) for k in (8, 4, 4, 4, 12))), ("sha256:", lambda: hexa(64)), ("part no. ", lambda: mixed(9)), ("no password needed for ", lambda: f"gate{rng.randint(10, 99)}"),
    ]
    words = "the of and to in it is that for on with as was at by this".split()
    rows, truth = [], {}
    for i in range(n):
        text, spans = "", set()
        for _ in range(rng.randint(2, 6)):
            text += " ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + " "
            own = rng.random() < 0.3
            before, make = rng.choice(secrets if own else plain)
            text += before
            value = make()
            if own:
                spans.add((len(text), len(text) + len(value)))
            text += value + ('"' if before.endswith('"') else "") + rng.choice([" ", ". ", ", ", "\n"])
        rows.append((i, text))
        truth[i] = spans
    return rows, truth


@pytest.mark.parametrize("n", [40, 600])
def test_added_spans(spark, n):
    """Precision and recall of 0.9 or more, among numbers, dates, checksums, file names and identifiers that look like secrets."""
    rows, truth = written_down(n, 3)
    got = {r.doc_id: {(x.s, x.e) for x in r.secrets} for r in find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit, given, wanted = (sum(map(len, x)) for x in ([got[k] & truth[k] for k in truth], got.values(), truth.values()))
    print("precision", hit / given, "recall", hit / wanted, wanted)
    assert hit >= 0.9 * given and hit >= 0.9 * wanted and wanted > n
