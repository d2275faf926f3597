"""Text predicates, tokens and digests as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Substring match on lower-cased text."""
    low = F.lower(text)
    found = F.lit(False)
    for term in terms:
        found = found | low.contains(term.lower())
    return found


def word_any(text: Column, words: Iterable[str]) -> Column:
    """Whole-word match, any case."""
    return text.rlike(r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(words) + r")(?:[^\p{L}\p{N}_]|$)")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def numerals(text: Column) -> Column:
    """Numbers as written, in order: decimals with one point, no digit or point on either side."""
    return F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9.])([0-9]+(?:\.[0-9]+)?)"), F.lit(1))


def canonical(numeral: Column) -> Column:
    """Without leading zeros, and trailing ones after a point."""
    plain = F.regexp_replace(numeral, r"^0+(?=[0-9])", "")
    return F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)


def missing_numerals(source: Column, target: Column) -> Column:
    """Numbers of the source that the target lacks."""
    return F.array_except(F.transform(numerals(source), canonical), F.transform(numerals(target), canonical))


def sanitised(text: Column, words: Iterable[str]) -> Column:
    """Sensitive words and longer numbers masked."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\b(?:" + "|".join(words) + r")\b", "[word]"), r"[0-9]{4,}", "[number]")


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys and no spaces."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, spaces left out."""
    bare = F.regexp_replace(text, r"\s+", "")
    # pieces of two from the first and from the second character on: all pairs, in time linear in the text
    pieces = lambda c: F.regexp_extract_all(c, F.lit("(?s).."), F.lit(0))
    return F.coalesce(F.array_distinct(F.concat(pieces(bare), pieces(F.substring(bare, 2, 1 << 30)))), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


@F.pandas_udf(StringType())
def name_key(names: pd.Series) -> pd.Series:
    """NFKC, one space between words, case folded: no built-in function normalises."""
    return names.str.normalize("NFKC").str.split().str.join(" ").str.casefold()


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility forms composed: no built-in function normalises."""
    return texts.str.normalize("NFKC")
