"""What a rendering of a medical text loses."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import fidelity as H

CASES = [
    # source, target, what is lost
    ("I take 5 mg of insulin", "インスリンを5ミリグラム使います", {}),
    ("I take 5 mg of insulin", "薬を使います", {"numbers": ["5"], "units": ["mg"], "medications": ["insulin"]}),
    ("No fever since 3 days ago", "3日前から熱はありません", {}),
    ("No fever since 3 days ago", "3 fever", {"negation": ["negation"], "temporal_expression": ["time"]}),
    ("it was 38 point, uh, 5 c", "38.5度でした", {}),
    ("37 point um 2", "37", {"numbers": ["37.2"]}),
    ("37 point 2", "37", {"numbers": ["2"]}),  # spoken decimals are those with a filler
    ("half: 1/2 tablet", "半錠", {}),
    ("1/2 tablet and 2/3", "2 3", {"numbers": ["1/2", "2/3"]}),
    ("15 of 100", "15/100", {}),
    ("1,200 ml, +5, -0, 007, 2.50%", "1200 ミリリットル 5 0 7 2.5％", {}),
    ("2.5%", "2.5", {}),
    ("12 %", "3分の1 と 12", {}),
    ("at 8.30", "8時30分", {}),
    ("see [12, 14-16] and 9", "9", {}),
    ("x9 a_8 v1.2", "", {"numbers": ["2"]}),
    ("ramipril and Atenolol", "ラミプリル", {"medications": ["Atenolol"]}),
    ("Headache, swollen legs, BLOOD", "頭痛、むくみ、出血", {}),
    ("a rash and vomiting", "熱", {"symptoms": ["rash", "vomiting"]}),
    (None, None, {}),
    ("", "x", {}),
]


def test_errors(spark):
    frame = spark.createDataFrame([(k, s, t) for k, (s, t, _) in enumerate(CASES)], "k int, s string, t string")
    got = {r.k: {name: own for name, own in r.e.asDict().items() if own} for r in frame.select("k", H.fidelity_errors(F.col("s"), F.col("t")).alias("e")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES)}


CLINICAL = [
    ("I read 3 books in 2 weeks", []),
    ("the cough started 2 weeks ago, 3 books", ["2"]),
    ("aged 45, room 7", ["45"]),
    ("a 30-year-old", ["30"]),
    ("80歳です", ["80"]),
    ("blood pressure is 120/80 and 7", ["120/80"]),
    ("500 mg then 500 MG, 20 mmHg", ["500", "20"]),
    ("saturation fell to 92%, 50% of books", ["92%", "50%"]),
    ("half of 50% books", []),
    ("fever for 3日", ["3"]),
    ("pain [3] and 4 kg " + "x" * 200 + " 5 days", ["4"]),
    ("", []),
]


@pytest.mark.parametrize("part", [0, 1])
def test_clinical_numbers(spark, part):
    cases = CLINICAL[part::2]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.n for r in frame.select("k", H.clinical_numbers(F.col("t")).alias("n")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_missing_clinical_numbers(spark):
    frame = spark.createDataFrame([("3 books, 40 mg, 12 kg", "40")], "s string, t string")
    assert frame.select(H.missing_numbers(F.col("s"), F.col("t"), strict=False).alias("m")).first().m == ["12"]
