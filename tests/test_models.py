"""Checks of models given as rows."""

from colloquy.operators import models as M

WORDS = {"ask": ("ask", "inquire"), "close": ("goodbye",)}


def model(name, states="abcd", observations="uvwxyz", drop=()):
    rows = [(name, "initial", None, s, 1 / len(states)) for s in states]
    rows += [(name, "transition", s, t, 1 / len(states)) for s in states for t in states]
    rows += [(name, "emission", s, o, 1 / len(observations)) for s in states for o in observations]
    return [r for r in rows if r[1:4] not in drop]


def frames(spark, tables, roles):
    return spark.createDataFrame(tables, "model string, kind string, state string, target string, p double"), spark.createDataFrame(roles, "model string, state string, role string")


ROLES = [("a", "positive"), ("b", "positive"), ("c", "negative"), ("d", "negative")]


def test_problems(spark):
    roles = [(m, s, r) for m in ("good", "short", "odd") for s, r in ROLES]
    tables = model("good") + model("short", drop=[("emission", "a", "u"), *(("transition", "b", t) for t in "abcd")]) + model("odd")
    tables += [("odd", "transition", "a", "q", 0.0), ("odd", "emission", "a", "n", -0.5), ("odd", "emission", "b", "n", None), ("roleless", "initial", None, "a", 1.0)]
    roles += [("odd", "a", "negative"), ("odd", "ghost", "negative")]
    got = {(r.model, r.problem) for r in M.model_problems(*frames(spark, tables, roles)).collect()}
    assert got == {
        ("short", "emission of a: chances don't sum to 1"), ("short", "transition: no row for b"),
        ("odd", "transition to an unknown state q"), ("odd", "emission of a: a chance outside 0 to 1"), ("odd", "emission of b: a chance outside 0 to 1"), ("odd", "emission of a: chances don't sum to 1"),
        ("odd", "both roles for a"), ("odd", "a role for an unknown state ghost"),
        ("roleless", "transition: no row for a"), ("roleless", "emission: no row for a"), ("roleless", "no positive state"), ("roleless", "no negative state"),
    }
    assert M.model_problems(*(f.limit(0) for f in frames(spark, tables, roles))).count() == 0


def test_coverage(spark):
    tables, roles = frames(spark, model("good") + model("few", "abc", "uvwxy") + model("bare"), [(m, s, r) for m in ("good", "few") for s, r in ROLES] + [("bare", "a", "positive")])
    said = spark.createDataFrame([("good", "u", "Inquires"), ("good", "goodbye", None), ("few", "u", "asks"), ("bare", "ask", ""), ("bare", "v", "GOODBYE")], "model string, observation string, text string")
    got = {r.model: tuple(r)[1:] for r in M.coverage_gate(tables, roles, said, WORDS).collect()}
    assert got == {"good": (4, 6, True, [], True), "few": (3, 5, True, ["close"], False), "bare": (4, 6, False, [], False)}
    assert {r.missing[0] for r in M.coverage_gate(tables, roles, said.limit(0), WORDS).collect()} == {"ask"}
