"""All queries of the library but those of the training-data operators."""

from __future__ import annotations

from colloquy.plans import audits, conversations, dedup, judging, medical, models, pairs, payloads, scoring, selection, streams  # noqa: F401  they register themselves
from colloquy.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
