"""Label model for overlapping heuristic labellers: Dawid and Skene's expectation-maximisation over vote patterns."""

from __future__ import annotations

from math import exp, log


def label_model(patterns: dict[tuple, float], prior: float = 0.5, rounds: int = 50, start: tuple[float, float] = (0.02, 0.3)) -> tuple[dict[tuple, float], list[dict]]:
    """patterns: votes of the labellers (1, 0, None to abstain) and how often each pattern occurs.

    Returns each pattern's posterior chance of 1, and each labeller's chances of a vote given the class; an abstention says
    nothing. start: the chances with which labellers are taken to vote 0 at first where the class is 1 and where it is 0: a
    labeller looks for one kind of flaw, so its 0 is rare but telling. Counts are smoothed by one. What is summed is the
    patterns, so the work does not depend on the number of rows.
    """
    if not patterns:
        return {}, []
    width = len(next(iter(patterns)))
    chances = [{1: {0: start[0], 1: 1 - start[0]}, 0: {0: start[1], 1: 1 - start[1]}} for _ in range(width)]
    posterior: dict[tuple, float] = {}
    total = sum(patterns.values())
    for _ in range(rounds):
        for votes in patterns:
            score = log(prior) - log(1 - prior) + sum(log(chances[j][1][v]) - log(chances[j][0][v]) for j, v in enumerate(votes) if v is not None)
            posterior[votes] = 1 / (1 + exp(-max(-50.0, min(50.0, score))))
        prior = min(0.999, max(0.001, (sum(n * posterior[votes] for votes, n in patterns.items()) + 1) / (total + 2)))
        for j in range(width):
            for c in (0, 1):
                weight = {0: 1.0, 1: 1.0}
                for votes, n in patterns.items():
                    if votes[j] is not None:
                        weight[votes[j]] += n * (posterior[votes] if c else 1 - posterior[votes])
                chances[j][c] = {v: w / sum(weight.values()) for v, w in weight.items()}
    return posterior, chances
