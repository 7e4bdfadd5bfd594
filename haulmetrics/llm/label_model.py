"""Weak-label model: expectation-maximisation over counts of vote patterns.

A pattern is `sum(vote_l * 3^l)`; votes are 0 (no), 1 (yes) and 2 (none). The work here depends on the number
of labellers alone; the counts come from an aggregation over all rows.
"""

from typing import NamedTuple

import numpy as np

NO, YES, NONE = 0, 1, 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class LabelModel(NamedTuple):
    prior: float
    given: np.ndarray  # [class, labeller, vote]: chance of the vote
    posterior: np.ndarray  # chance of "yes" by pattern


def estimate(counts: dict[int, int], labellers: int, rounds: int = 200) -> LabelModel:
    """Dawid-Skene with no vote as an outcome of its own.

    Starts from "yes unless a labeller says no", which fixes the names of the classes; pseudo-counts keep a
    labeller that never votes harmless.
    """
    cast = (np.arange(3 ** labellers)[:, None] // 3 ** np.arange(labellers)) % 3
    weight = np.array([counts.get(p, 0) for p in range(3 ** labellers)], dtype=float)
    outcomes = np.stack([(cast == v).astype(float) for v in range(3)], 2)
    chance = np.where((cast == NO).any(1), 0.1, 0.95)
    for _ in range(rounds):
        by_class = np.stack((weight * (1 - chance), weight * chance))
        prior = (by_class[1].sum() + 1) / (weight.sum() + 2)
        tallies = np.einsum("cp,plv->clv", by_class, outcomes)
        tallies += np.array([[1.0, 0.1, 1.0], [0.1, 1.0, 1.0]])[:, None, :]
        given = tallies / tallies.sum(2, keepdims=True)
        chance = sigmoid(np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", outcomes, np.log(given[1] / given[0])))
    return LabelModel(prior, given, chance)
