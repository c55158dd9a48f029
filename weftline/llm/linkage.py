"""Probabilistic record linkage: agreement levels of fields, weights by expectation-maximisation.

A comparison gives each field a level; level ``MISSING`` says that a side lacks the field, and has probabilities of its own in every class, so
a missing value is evidence of its own (mostly none). Patterns of levels are counted by the cluster; there are at most the product of the level counts of them,
and only those counts reach the driver. EM runs on the counts; fields are independent inside a class.

Pairs that don't match are no single class: neighbours agree in all but the field that tells them apart, and two classes alone would call them matches, as agreement everywhere else outweighs one
disagreement. So there is one class of matches, one of unrelated pairs, and one of neighbours for each field that defines an entity; a neighbour class disagrees in its field in a share of at
least ``apart``, and matches disagree there in a share of at most ``slip`` (misread or mistyped parts). Everything else about the classes, their sizes too, is estimated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = -1


class Weights:
    """Shares of the classes and the probabilities of each field's levels in them; class 0 holds the matches."""

    def __init__(self, shares: list[float], classes: list[list[dict[int, float]]]):
        self.shares, self.classes = shares, classes

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        """Of a match."""
        each = [np.log(s) + sum(np.log(c.get(level, 1e-4)) for c, level in zip(fields, pattern)) for s, fields in zip(self.shares, self.classes)]
        return float(each[0] - np.logaddexp.reduce(each[1:])) if len(each) > 1 else 0.0

    def probability(self, pattern: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.log_odds(pattern), -500, 500))))


def estimate(counts: dict[tuple[int, ...], int], defining: list[int] | None = None, rounds: int = 300, start: float = 0.3, apart: float = 0.95, slip: float = 0.002, prior: float = 10.0, floor: float = 1e-4) -> Weights:
    """EM from a start in which higher levels are likelier among matches; ``defining`` are the fields with a class of neighbours. Classes lean, with the
    weight of ``prior`` pairs, on the frequencies of all pairs (neighbours) or on where they start: what few pairs leave open. Without any pair: even weights."""
    if not counts:
        return Weights([0.5, 0.5], [[], []])
    patterns = np.array(sorted(counts))
    n = np.array([counts[tuple(p)] for p in patterns.tolist()], dtype=float)
    fields = patterns.shape[1]
    levels = [sorted(set(patterns[:, f].tolist())) for f in range(fields)]
    # A field that never disagrees tells no neighbours apart.
    own = [None, None, *(f for f in defining or [] if 0 in levels[f])]

    def spread(f: int, power: float) -> dict[int, float]:
        raw = {v: (1.0 if v == MISSING else 4.0 ** (power * v)) for v in levels[f]}
        total = sum(raw.values())
        return {v: x / total for v, x in raw.items()}

    def bounded(k: int, f: int, c: dict[int, float]) -> dict[int, float]:
        """Within the bounds on level 0, the other levels in proportion."""
        want = max(c[0], apart) if f == own[k] else min(c[0], slip) if k == 0 and f in own else c.get(0, 0.0)
        rest = sum(x for v, x in c.items() if v != 0)
        return c if len(c) == 1 or want == c.get(0, 0.0) else {v: want if v == 0 else x * (1 - want) / rest for v, x in c.items()}

    classes = [[bounded(k, f, spread(f, -1 if k == 1 else 1)) for f in range(fields)] for k in range(len(own))]
    shares = np.array([start, *[(1 - start) / (len(own) - 1)] * (len(own) - 1)])
    first = shares.copy()
    pooled = [{v: float(n[patterns[:, f] == v].sum() / n.sum()) for v in levels[f]} for f in range(fields)]
    # Classes of neighbours lean on the frequencies of all pairs, the two others on where they start.
    lean = [c if k < 2 else pooled for k, c in enumerate([[dict(x) for x in c] for c in classes])]
    where = [{v: patterns[:, f] == v for v in levels[f]} for f in range(fields)]
    for _ in range(rounds):
        log = np.tile(np.log(shares), (len(patterns), 1))
        for k, c in enumerate(classes):
            for f in range(fields):
                for v in levels[f]:
                    log[where[f][v], k] += np.log(c[f][v])
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post = post / post.sum(axis=1, keepdims=True) * n[:, None]
        new = np.maximum((post.sum(axis=0) + prior * first) / (n.sum() + prior), 1e-6)
        for k in range(len(classes)):
            mine = post[:, k]
            for f in range(fields):
                c = {v: max(floor, float((mine[where[f][v]].sum() + prior * lean[k][f][v]) / (mine.sum() + prior))) for v in levels[f]}
                classes[k][f] = bounded(k, f, c)
        if np.abs(new - shares).max() < 1e-9:
            break
        shares = new
    return Weights(list(shares / shares.sum()), classes)


def pattern_counts(compared: DataFrame, fields: list[str], most: int = 100_000) -> dict[tuple[int, ...], int]:
    rows = compared.groupBy(*fields).agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    return {tuple(r[f] for f in fields): r["n"] for r in rows}
