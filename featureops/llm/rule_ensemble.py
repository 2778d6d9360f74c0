"""A sparse rule ensemble in numpy: shallow trees give conjunctive rules, a lasso weighs them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Condition = tuple[int, bool, float]  # column, at most (else above), limit


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * holds(x, r) for r, w in self.rules), np.zeros(len(x)))


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for column, low, limit in rule:
        out &= (x[:, column] <= limit) if low else (x[:, column] > limit)
    return out


def limits_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate limits of each column: midpoints between neighbouring quantiles."""
    out = []
    for column in x.T:
        edges = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
        out.append((edges[:-1] + edges[1:]) / 2)
    return out


def paths(x: np.ndarray, y: np.ndarray, rows: np.ndarray, limits: list[np.ndarray], depth: int, least: int, columns: np.ndarray, so_far: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Conjunctions that lead to the nodes of a tree grown on ``rows``."""
    if depth == 0 or len(rows) < 2 * least or y[rows].min() == y[rows].max():
        return []
    best: tuple[float, int, float] | None = None
    n, ones = len(rows), y[rows].sum()
    for c in columns:
        if not len(limits[c]):
            continue
        place = np.searchsorted(limits[c], x[rows, c], "left")  # limits below the value
        total = np.bincount(place, minlength=len(limits[c]) + 1)[:-1].cumsum()
        good = np.bincount(place, y[rows], minlength=len(limits[c]) + 1)[:-1].cumsum()
        ok = (total >= least) & (n - total >= least)
        if not ok.any():
            continue
        t, g = total[ok], good[ok]
        impurity = g * (t - g) / t + (ones - g) * (n - t - ones + g) / (n - t)
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0]:
            best = (float(impurity[k]), int(c), float(limits[c][ok][k]))
    if best is None or best[0] >= ones * (n - ones) / n - 1e-9:
        return []
    _, c, limit = best
    low = x[rows, c] <= limit
    out = []
    for side, part in ((True, rows[low]), (False, rows[~low])):
        rule = so_far + ((c, side, limit),)
        out += [rule, *paths(x, y, part, limits, depth - 1, least, columns, rule)]
    return out


def shorter(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The same rule with one limit for each column and side."""
    kept: dict[tuple[int, bool], float] = {}
    for c, low, limit in rule:
        old = kept.get((c, low))
        kept[c, low] = limit if old is None else (min if low else max)(old, limit)
    return tuple(sorted((c, low, limit) for (c, low), limit in kept.items()))


def lasso_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Weighted logistic regression with an L1 penalty on all but the bias, by accelerated proximal steps."""
    z1 = np.concatenate([np.ones((len(z), 1)), z], 1)
    weight = weight / weight.sum()
    step = 4 / max(1e-9, np.linalg.norm(z1 * np.sqrt(weight)[:, None], 2) ** 2)
    w = v = np.zeros(z1.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z1 @ v)))
        new = v - step * (z1.T @ (weight * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 48, penalty: float = 0.0004, rounds: int = 400, seed: int = 3) -> RuleModel:
    """Trees on random halves of rows and columns; their paths, weighed by the lasso. Constant labels give a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return RuleModel(float(np.log(share / (1 - share))), ())
    g = np.random.default_rng(seed)
    limits = limits_of(x, bins)
    found: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        rows = g.permutation(len(x))[: max(2, (len(x) + 1) // 2)]
        columns = g.permutation(x.shape[1])[: max(1, (2 * x.shape[1] + 2) // 3)]
        for rule in paths(x, y, rows, limits, depth, max(3, len(x) // 2000), columns):
            found[shorter(rule)] = None
    rules = list(found)
    if not rules:
        return RuleModel(float(np.log(share / (1 - share))), ())
    z = np.stack([holds(x, r) for r in rules], 1).astype("f8")
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows
    keep = np.sort(first)
    bias, w = lasso_logistic(z[:, keep], y, np.ones(len(y)), penalty, rounds)
    used = [(rules[k], float(v)) for k, v in zip(keep, w) if abs(v) > 1e-6]
    return RuleModel(bias, tuple(used))
