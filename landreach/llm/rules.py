"""Ordered rule lists by incremental reduced-error pruning, and their export to SQL.

Fuernkranz and Widmer, "Incremental reduced error pruning" (ICML 1994).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Share of the examples that rules are grown on (the rest prunes them), the most tests of a rule, and the least of a rule's worth and
#: of its share in its kind's pruning examples.
GROW, TESTS, LEAST, SHARE = 2 / 3, 7, 0.7, 0.001


@dataclass(frozen=True)
class Rule:
    kind: str
    tests: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, op, at in self.tests:
            out &= x[name] >= at if op == ">=" else x[name] <= at
        return out


def _best_test(x: dict[str, np.ndarray], y: np.ndarray, w: np.ndarray) -> tuple[str, str, float] | None:
    """The test of most gain by FOIL's measure, over all places between two values of a statistic."""
    p0, n0 = (w * y).sum(), (w * ~y).sum()
    best, test = 1e-9, None
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v = values[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum((w * y)[order])[cut], np.cumsum((w * ~y)[order])[cut]
        for op, p1, n1 in (("<=", p, n), (">=", p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0))), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, test = gain[k], (name, op, round(float(v[cut[k]] + v[cut[k] + 1]) / 2, 5))
    return test


def _grow(kind: str, x: dict[str, np.ndarray], y: np.ndarray, w: np.ndarray) -> Rule:
    rule, held = Rule(kind, ()), np.arange(len(y))
    while (~y[held]).any() and y[held].any() and len(rule.tests) < TESTS:
        test = _best_test({k: v[held] for k, v in x.items()}, y[held], w[held])
        if test is None:
            break
        rule = Rule(kind, (*rule.tests, test))
        held = held[Rule(kind, (test,)).covers({k: v[held] for k, v in x.items()})]
    return rule


def _tight(rule: Rule) -> Rule:
    """Of several tests of one statistic in one direction the tightest."""
    held: dict[tuple[str, str], float] = {}
    for name, op, at in rule.tests:
        before = held.get((name, op), at)
        held[name, op] = max(before, at) if op == ">=" else min(before, at)
    return Rule(rule.kind, tuple((name, op, at) for (name, op), at in held.items()))


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray, w: np.ndarray) -> tuple[Rule, float]:
    """The rule without its last tests, as far as that helps on examples it wasn't grown on; and its worth there."""

    def worth(r: Rule) -> float:
        hit = r.covers(x)
        p, n = (w * (hit & y)).sum(), (w * (hit & ~y)).sum()
        return (p - n) / (p + n) if p + n else -1.0

    options = [Rule(rule.kind, rule.tests[:k]) for k in range(len(rule.tests), 0, -1)] or [rule]
    best = max(options, key=worth)
    return best, worth(best)


def induce(x: dict[str, np.ndarray], kinds: np.ndarray, order: list[str], weight: np.ndarray | None = None, seed: int = 0, misses: int = 3) -> list[Rule]:
    """Rules for each kind in ``order``, to be read from the first; what no rule covers is none of them.

    Each rule is grown on part of the examples left and pruned on the rest; both
    parts are drawn anew. The examples it covers are then taken away. A kind
    ends when ``misses`` draws in a row give a rule whose worth, (right - wrong)
    / all on the pruning part, is below LEAST, or that covers next to nothing. Examples count by their weight.
    """
    rng, out = np.random.default_rng(seed), []
    w = np.ones(len(kinds)) if weight is None else weight.astype(float)
    left, missed = np.ones(len(kinds), dtype=bool), 0
    for kind in order:
        missed = 0
        while missed < misses and (left & (kinds == kind)).any():
            at = rng.permutation(np.flatnonzero(left))
            cut = int(len(at) * GROW)
            part = lambda ids: ({k: v[ids] for k, v in x.items()}, kinds[ids] == kind, w[ids])  # noqa: B023, E731
            rule, worth = _prune(_grow(kind, *part(at[:cut])), *part(at[cut:]))
            if worth < LEAST or not rule.tests or (w * rule.covers(x) * (kinds == kind) * left).sum() < SHARE * (w * (kinds == kind)).sum():
                missed += 1
                continue
            missed = 0
            out.append(_tight(rule))
            left &= ~rule.covers(x)
    return out


def to_sql(rules: list[Rule], otherwise: str = "NULL") -> str:
    """The rule list as one CASE expression."""
    if not rules:
        return otherwise
    whens = (f"WHEN {' AND '.join(f'{name} {op} {at!r}D' for name, op, at in r.tests)} THEN '{r.kind}'" for r in rules)
    return f"CASE {' '.join(whens)} ELSE {otherwise} END"


def decide(rules: list[Rule], x: dict[str, np.ndarray], otherwise: str = "text") -> np.ndarray:
    """What the CASE expression gives."""
    out = np.full(len(next(iter(x.values()))), otherwise, dtype=object)
    open_ = np.ones(len(out), dtype=bool)
    for r in rules:
        hit = open_ & r.covers(x)
        out[hit], open_ = r.kind, open_ & ~hit
    return out
