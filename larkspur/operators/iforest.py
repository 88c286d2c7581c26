"""Isolation forests: trained on a bounded sample, scored in vectorised batches.

All figures of a row (score, confidence) come from one pass over the trees in one vectorised function, which a forest
makes once: Spark evaluates equal calls of it once, however many figures a query asks for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


#: Rows whose way through the trees is followed at once: they stay in the cache.
ROWS_AT_ONCE = 8192


@dataclass
class Tree:
    """Nodes by number: split feature (-1: leaf), split value, left child (right is next), leaf depth; and steps to the deepest leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    steps: int

    def path(self, flat: np.ndarray, n: int) -> np.ndarray:
        """Depth of the leaf of each of n rows; flat holds their features, one column after the other. A leaf
        leads to itself, so all rows take as many steps as the deepest one."""
        leaf = self.feature < 0
        start, value = np.where(leaf, 0, self.feature) * n, np.where(leaf, np.inf, self.value)
        left = np.where(leaf, np.arange(len(leaf)), self.left)
        row, at = np.arange(n), np.zeros(n, np.int64)
        for _ in range(self.steps):
            own = flat.take(start.take(at) + row)
            at = left.take(at) + (own >= value.take(at))
        return self.depth.take(at)


def _grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    limit = math.ceil(math.log2(max(2, len(x))))
    feature, value, left, depth = [-1], [0.0], [0], [0.0]
    todo, deepest = [(0, np.arange(len(x)), 0)], 0
    while todo:
        node, rows, level = todo.pop()
        deepest = max(deepest, level)
        low, high = x[rows].min(0), x[rows].max(0)
        spread = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or not len(spread):
            depth[node] = level + expected_depth(len(rows))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(low[f], high[f]))
        right = x[rows, f] >= cut
        feature[node], value[node], left[node] = f, cut, len(feature)
        for part in (rows[~right], rows[right]):
            todo.append((len(feature), part, level + 1))
            feature.append(-1), value.append(0.0), left.append(0), depth.append(0.0)
    return Tree(np.array(feature), np.array(value), np.array(left), np.array(depth), deepest)


@dataclass
class Forest:
    features: list[str]
    trees: list[Tree]
    sample_size: int
    threshold: float | None = None
    low: float = 0.0
    high: float = 1.0
    seed: int = 42
    ages: list[int] = field(default_factory=list)
    _functions: dict = field(default_factory=dict, repr=False, compare=False)

    def figures(self, x: np.ndarray, decay: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Score 2^(-E[h]/c) and confidence 1 / (1 + variation of h) of each row; with decay, trees count less for the score the older they are."""
        weights = np.ones(len(self.trees)) if decay is None else np.power(decay, np.array(self.ages, float))
        score, confidence = np.empty(len(x)), np.empty(len(x))
        for low in range(0, len(x), ROWS_AT_ONCE):
            part = x[low : low + ROWS_AT_ONCE]
            flat = np.ascontiguousarray(part.T).ravel()
            total, weighted, squares = (np.zeros(len(part)) for _ in range(3))
            for tree, w in zip(self.trees, weights, strict=True):
                h = tree.path(flat, len(part))
                total += h
                weighted += w * h
                squares += h * h
            mean = total / len(self.trees)
            spread = np.sqrt(np.maximum(squares / len(self.trees) - mean * mean, 0))
            score[low : low + len(mean)] = np.power(2.0, -weighted / weights.sum() / max(expected_depth(self.sample_size), 1e-12))
            confidence[low : low + len(mean)] = 1.0 / (1.0 + spread / np.maximum(mean, 1e-12))
        return score, confidence

    def scores(self, x: np.ndarray, decay: float | None = None) -> np.ndarray:
        return self.figures(x, decay)[0]

    def function(self, decay: float | None = None):
        """The vectorised function of this forest: a struct of score and confidence, NULL where a feature is."""
        if decay not in self._functions:
            self._functions[decay] = _udf(self, decay)
        return self._functions[decay]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_functions"}

    def __setstate__(self, state):
        self.__dict__.update(state, _functions={})


def sample(df: DataFrame, features: list[str], n: int, seed: int) -> np.ndarray:
    """At most n rows, chosen by hash, so the same rows give the same sample. Rows with NULLs are left out."""
    rows = df.select(*[F.col(c).cast("double") for c in features]).dropna()
    held = rows.orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(n).toArrow()
    return np.column_stack([held[c].to_numpy() for c in features]) if held.num_rows else np.empty((0, len(features)))


def train(df: DataFrame, features: list[str], n_trees: int = 100, sample_size: int = 256, seed: int = 42, contamination: float | None = None) -> Forest:
    """Grow n_trees on random subsets of a bounded sample (n_trees * sample_size rows at most)."""
    x = sample(df, features, n_trees * sample_size, seed)
    if not len(x):
        raise ValueError("no rows without NULL to train on")
    size = min(sample_size, len(x))
    rng = np.random.default_rng(seed)
    trees = [_grow(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(n_trees)]
    forest = Forest(features, trees, size, seed=seed, ages=[0] * n_trees)
    if contamination is not None:
        own = np.sort(forest.scores(x))
        forest.threshold = float(own[min(len(own) - 1, int((1 - contamination) * len(own)))])
        forest.low, forest.high = float(own[0]), float(own[-1])
    return forest


def rotate(forest: Forest, df: DataFrame, k: int | None = None, seed: int | None = None) -> Forest:
    """Replace the k oldest trees (a tenth by default) by trees grown on new rows."""
    k = max(1, len(forest.trees) // 10) if k is None else k
    seed = forest.seed + 1 if seed is None else seed
    x = sample(df, forest.features, k * forest.sample_size, seed)
    rng = np.random.default_rng(seed)
    size = min(forest.sample_size, len(x))
    new = [_grow(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(k)]
    return Forest(forest.features, forest.trees[k:] + new, forest.sample_size, forest.threshold, forest.low, forest.high, seed, [a + 1 for a in forest.ages[k:]] + [0] * k)


def _udf(forest: Forest, decay: float | None):
    @F.pandas_udf("score double, confidence double")
    def apply(*columns):
        import pandas as pd

        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        known = ~np.isnan(x).any(1)
        out = np.full((2, len(x)), np.nan)  # NaN is sent as NULL
        if known.any():
            out[:, known] = forest.figures(x[known], decay)
        return pd.DataFrame({"score": out[0], "confidence": out[1]})

    return apply


def _figure(forest: Forest, name: str, columns=None, decay: float | None = None):
    return forest.function(decay)(*(columns or [F.col(c).cast("double") for c in forest.features]))[name]


def anomaly_score(forest: Forest, columns=None):
    return _figure(forest, "score", columns)


def anomaly_weighted(forest: Forest, decay: float = 0.98, columns=None):
    return _figure(forest, "score", columns, decay)


def anomaly_predict(forest: Forest, threshold: float | None = None, columns=None):
    threshold = forest.threshold if threshold is None else threshold
    if threshold is None:
        raise ValueError("no threshold: train with contamination or give one")
    return (anomaly_score(forest, columns) > threshold).cast("bigint")


def anomaly_proba(forest: Forest, columns=None):
    score = anomaly_score(forest, columns)
    if forest.threshold is None:
        return score
    if forest.high - forest.low < 1e-10:
        return F.when(score.isNotNull(), 0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - forest.low) / (forest.high - forest.low)))


def anomaly_confidence(forest: Forest, columns=None):
    """1 / (1 + coefficient of variation of the path lengths)."""
    return _figure(forest, "confidence", columns)
