"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Method: boosted shallow trees are grown on labelled text statistics; every path from a root to a node becomes a
conjunctive rule. A lasso-penalised logistic regression weighs all rules and drops most of them; the strength of the
penalty is the one that does best on a validation part. The score of a text is the logistic function of the summed
weights of the rules that hold, one Spark expression over JVM columns.

Defined cases: a null or empty text has statistics 0 and is scored by them; without labelled rows the score is 0.5, with
rows of one kind only the share of good rows (smoothed by one row of each kind).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerloom.llm._spark import packed_row
from layerloom.llm._stats import RATIOS, labelled_ratios, ratios, with_counts

#: Labelled rows to learn from, at most.
SAMPLE = 8_000
TREES, DEPTH, BINS, STEP = 25, 3, 48, 0.3
PENALTIES = (0.03, 0.01, 0.003, 0.001)
THRESHOLD = 0.3

Path = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    """bias, and rules: conditions (statistic, above, threshold) and a weight each."""

    bias: float
    rules: tuple[tuple[Path, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for path, w in self.rules:
            z += w * _holds(x, path)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as a Spark expression over the counts of a text."""
        stats = list(ratios().values())

        def holds(path: Path) -> Column:
            return reduce(lambda a, b: a & b, [stats[k] > F.lit(t) if above else stats[k] <= F.lit(t) for k, above, t in path])

        z = reduce(lambda a, b: a + b, [F.when(holds(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in self.rules], F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _holds(x: np.ndarray, path: Path) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in path:
        out &= (x[:, k] > t) == above
    return out


def _tree(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: Path, value: np.ndarray, paths: list[Path]) -> None:
    """Grows one node: fills value with each row's step and paths with every conjunction on the way."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    value[rows] = -g / (h + 1.0)
    if len(path) == DEPTH or len(rows) < 10:
        return
    best, gain, split = g * g / (h + 1.0), 1e-6, None
    for k, edge in enumerate(edges):
        if not len(edge):
            continue
        gs = np.cumsum(np.bincount(binned[rows, k], gradient[rows], len(edge) + 1))[:-1]
        hs = np.cumsum(np.bincount(binned[rows, k], hessian[rows], len(edge) + 1))[:-1]
        found = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - best
        found[(hs < 0.5) | (h - hs < 0.5)] = 0
        if found.max() > gain:
            gain, split = found.max(), (k, int(found.argmax()))
    if split is None:
        return
    k, b = split
    low = binned[rows, k] <= b
    for above, part in ((False, rows[low]), (True, rows[~low])):
        if len(part):
            longer = (*path, (k, above, float(edges[k][b])))
            paths.append(longer)
            _tree(binned, edges, gradient, hessian, part, longer, value, paths)


def _paths(x: np.ndarray, y: np.ndarray) -> list[Path]:
    edges = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        middles = (values[1:] + values[:-1]) / 2
        even = np.linspace(0, len(middles) - 1, min(BINS, len(middles))).astype(int)
        common = np.searchsorted(values, np.quantile(x[:, k], np.linspace(0, 1, BINS))).clip(0, max(0, len(middles) - 1))
        edges.append(middles[np.unique(np.concatenate([even, common]))] if len(middles) else middles)
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    random, f, paths = np.random.default_rng(7), np.full(len(x), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(random.random(len(x)) < 0.6)
        value = np.zeros(len(x))
        before = len(paths)
        _tree(binned, edges, p - y, p * (1 - p), rows, (), value, paths)
        if len(paths) == before:
            continue
        step = np.zeros(len(x))
        for path in paths[before:]:  # deeper paths overwrite: each row ends with its leaf's step
            inside = _holds(x, path)
            picked = rows[inside[rows]]
            step[inside] = value[picked].mean() if len(picked) else 0.0
        f += STEP * step
    return list(dict.fromkeys(tuple(sorted(p)) for p in paths))


def _lasso(matrix: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps."""
    n, m = matrix.shape
    probe = np.ones(m) / m**0.5
    for _ in range(20):  # the largest eigenvalue, for the length of a step
        probe = matrix.T @ (matrix @ probe)
        largest = np.linalg.norm(probe)
        probe /= largest
    size = 1.1 * largest / n / 4 + 0.25
    w, v, bias, vb, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(matrix @ v + vb, -40, 40)))
        new = v - matrix.T @ (p - y) / n / size
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / size, 0)
        new_bias = vb - (p - y).mean() / size
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, vb = new + (last - 1) / t * (new - w), new_bias + (last - 1) / t * (new_bias - bias)
        w, bias = new, new_bias
    return bias, w


def learn(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """The ensemble for rows of RATIOS and labels (1: good)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    paths = _paths(x, y)
    if not paths:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    columns = {}
    for path in paths:  # rules that hold for the same rows are one
        columns.setdefault(_holds(x, path).tobytes(), path)
    paths = list(columns.values())
    matrix = np.stack([_holds(x, p) for p in paths], axis=1).astype(float)
    check = np.arange(len(x)) % 4 == 0
    best, loss = PENALTIES[-1], np.inf
    for penalty in PENALTIES:
        bias, w = _lasso(matrix[~check], y[~check], penalty)
        z = np.clip(matrix[check] @ w + bias, -40, 40)
        if (found := np.mean(np.logaddexp(0, z) - y[check] * z)) < loss - 1e-4:
            best, loss = penalty, found
    bias, w = _lasso(matrix, y, best)
    return RuleEnsemble(float(bias), tuple((p, float(c)) for p, c in zip(paths, w, strict=True) if abs(c) > 1e-6))


def learn_from(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> RuleEnsemble:
    x, y = labelled_ratios(docs, labels, "quality", limit)
    return learn(x, y)


def quality_scores(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs' other columns as `row`, the text (if keep_text), its counts, score and predicted."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(packed_row(docs, others), F.col(f"`{text_col}`").alias("text"))
    counted = with_counts(rows, "text", keep_text)
    return counted.withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


__all__ = ["RATIOS", "SAMPLE", "THRESHOLD", "RuleEnsemble", "learn", "learn_from", "quality_scores"]
