"""Histogram trees and their flat traversal against plain recursion over the rows."""

import numpy as np

from peakloom.llm import quality


def plain_boosting(x, y, trees, depth, bins, rate, penalty, least):
    """Score of a row, from trees grown by trying every threshold on the rows themselves."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    base = np.log(y.mean() / (1 - y.mean()))
    margin, grown = np.full(len(y), base), []

    def grow(rows, g, h, level):
        best = None
        total, weight = g[rows].sum(), h[rows].sum()
        if level < depth:
            for j, own in enumerate(edges):
                for t in own:
                    low = rows[x[rows, j] <= t]
                    a, b = g[low].sum(), h[low].sum()
                    if b < least / 4 or weight - b < least / 4:
                        continue
                    gain = a**2 / (b + penalty) + (total - a) ** 2 / (weight - b + penalty) - total**2 / (weight + penalty)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, j, t)
        if best is None:
            return -rate * total / (weight + penalty)
        _, j, t = best
        low = x[rows, j] <= t
        return j, t, grow(rows[low], g, h, level + 1), grow(rows[~low], g, h, level + 1)

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), 0)
        margin = margin + np.array([walk(tree, r) for r in x])
        grown.append(tree)
    return lambda row: 1 / (1 + np.exp(-(base + sum(walk(t, row) for t in grown))))


def test_trees_against_recursion():
    rng = np.random.default_rng(15)
    for n, ties in ((150, False), (220, True)):
        x = rng.normal(size=(n, 4))
        if ties:
            x[:, 1] = np.round(x[:, 1])
            x[:, 3] = 1.0  # nothing to split on
        y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.5, n)) > 0.3).astype(float)
        settings = {"trees": 6, "depth": 3, "bins": 12, "rate": 0.3, "penalty": 1.0, "least": 5.0}
        forest = quality.train(x, y, **settings)
        score = plain_boosting(x, y, **settings)
        fresh = rng.normal(size=(60, 4))
        assert np.allclose(forest.score(fresh), [score(r) for r in fresh], atol=1e-9)
        assert np.allclose(forest.score(x), [score(r) for r in x], atol=1e-9)


def test_one_label_and_tied_rows():
    x = np.zeros((20, 3))
    assert np.allclose(quality.train(x, np.ones(20)).score(x), 0.99) and len(quality.train(x, np.ones(20)).feature) == 0
    tied = quality.train(x, np.arange(20) % 2.0, trees=3).score(x)
    assert np.allclose(tied, 0.5)  # rows alike score alike
