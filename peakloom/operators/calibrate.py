"""Calibration: local regression from sums that Spark computes, applied as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import quantiles


@dataclass
class Local:
    """Local polynomials at a few centres, mixed by tricube weights."""

    centres: np.ndarray
    widths: np.ndarray
    coefficients: np.ndarray  # centre x power of (x - centre) / width

    def weights(self, x: Column) -> list[Column]:
        """Tricube weight of each centre; beyond the ends the outer kernels stay open."""
        first, last = float(self.centres[0]), float(self.centres[-1])
        inner = F.least(F.greatest(x, F.lit(first)), F.lit(last))
        return [F.pow(1 - F.pow(F.least(F.abs(inner - float(c)) / float(w), F.lit(1.0)), 3), 3) for c, w in zip(self.centres, self.widths)]

    def predict(self, x: Column) -> Column:
        """Column of fitted values."""
        w = self.weights(x)
        fits = [sum((float(b) * F.pow((x - float(c)) / float(v), p) for p, b in enumerate(row)), F.lit(0.0)) for c, v, row in zip(self.centres, self.widths, self.coefficients)]
        return sum((a * b for a, b in zip(w, fits)), F.lit(0.0)) / F.greatest(sum(w, F.lit(0.0)), F.lit(1e-12))


def fit_local(df: DataFrame, x: str, y: str, *, kernels: int = 6, degree: int = 2, trim: tuple[float, float] = (0.001, 0.999), density: bool = False) -> Local:
    """Fit local polynomials: one aggregation gives every kernel's normal equations.

    Centres are spread evenly between the trimmed ends or, with ``density``, at evenly spread
    ranks of the data, so that where rows lie close kernels are narrow. A kernel reaches half as
    far again as its farther neighbour. Few rows or distinct values lower the number of kernels
    and the degree.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    (lo, hi), n = quantiles(rows, "x", list(trim)), rows.count()
    if not n:
        raise ValueError("no rows to fit")
    kernels = max(1, min(kernels, n // (degree + 1)))
    degree = min(degree, max(0, n - 1)) if hi > lo else 0
    centres = np.linspace(lo, hi, kernels) if kernels > 1 else np.array([(lo + hi) / 2])
    if density and kernels > 1:
        centres = np.unique(quantiles(rows, "x", np.linspace(*trim, kernels).tolist()))
        kernels = len(centres)
    gaps = np.diff(centres) if kernels > 1 else np.array([hi - lo])
    widths = 1.5 * np.maximum(np.append(gaps, gaps[-1]), np.insert(gaps, 0, gaps[0]))[:kernels]
    widths[widths == 0] = 1.0
    model = Local(centres, widths, np.zeros((kernels, degree + 1)))
    sums = []
    for c, width, w in zip(centres.tolist(), widths.tolist(), model.weights(F.col("x"))):
        z = (F.col("x") - c) / width  # powers stay near one
        sums += [F.sum(w * F.pow(z, p)) for p in range(2 * degree + 1)] + [F.sum(w * F.pow(z, p) * F.col("y")) for p in range(degree + 1)]
    flat = np.array(rows.where(F.col("x").between(lo, hi)).agg(*sums).first(), float).reshape(kernels, -1)
    for k, s in enumerate(flat):
        gram = np.array([[s[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
        model.coefficients[k] = np.linalg.lstsq(gram + 1e-12 * np.eye(degree + 1), s[2 * degree + 1 :], rcond=None)[0]
    return model


@dataclass
class Estimator:
    """A named calibration: expected and observed columns, and how deviations are measured."""

    name: str
    expected: str
    observed: str
    output: str
    relative: bool = False
    kernels: int = 2
    degree: int = 2
    model: Local | None = None

    def fit(self, df: DataFrame) -> Estimator:
        """Fit the deviation of observed from expected values."""
        self.model = fit_local(df.withColumn("_d", self.deviation(F.col(self.observed))), self.expected, "_d", kernels=self.kernels, degree=self.degree)
        return self

    def deviation(self, value: Column) -> Column:
        """Difference from the expected value, in ppm if relative."""
        d = value - F.col(self.expected)
        return d / F.col(self.expected) * 1e6 if self.relative else d

    def predict(self, df: DataFrame) -> DataFrame:
        """Add the calibrated column."""
        d = self.model.predict(F.col(self.expected))
        return df.withColumn(self.output, F.col(self.expected) * (1 + d * 1e-6) if self.relative else F.col(self.expected) + d)

    def interval(self, df: DataFrame, share: float = 0.95) -> float:
        """Half width that holds ``share`` of the residuals after calibration."""
        d = self.deviation(F.col(self.observed)) - self.model.predict(F.col(self.expected))
        lo, hi = quantiles(df, d, [(1 - share) / 2, (1 + share) / 2])
        return (abs(lo) + abs(hi)) / 2


@dataclass
class Calibrations:
    """Estimators by name; those whose columns a table lacks are skipped."""

    estimators: list[Estimator] = field(default_factory=list)

    def fit(self, df: DataFrame) -> None:
        """Fit what the table has columns for."""
        for e in self.estimators:
            if {e.expected, e.observed} <= set(df.columns):
                e.fit(df)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add the calibrated columns of fitted estimators."""
        for e in self.estimators:
            if e.model is not None and e.expected in df.columns:
                df = e.predict(df)
        return df


def _rectangle(x: Column, p: list[Column | float]) -> tuple[Column, list[Column]]:
    """Difference of two logistic steps at p[0] and p[1] with slopes p[2] and p[3], and its derivatives."""
    up, down = ((x - p[i]) / p[i + 2] for i in (0, 1))
    step = lambda z: 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))
    a, b = step(up), step(down)
    da, db = a * (1 - a), b * (1 - b)
    return a - b, [-da / p[2], db / p[3], -da * up / p[2], db * down / p[3]]


def fit_rectangles(df: DataFrame, by: str, x: str, y: str, starts: dict[object, tuple[float, float, float, float]], *, steps: int = 40, close: float = 1e-7) -> dict[object, np.ndarray]:
    """Transfer curve of each isolation window: edges and slopes of a difference of logistic steps.

    ``df`` has the window's number ``by``, the distance ``x`` and the transmitted share ``y``.
    A damped Gauss-Newton step for all windows is one aggregation of their normal equations (ten
    products, four gradients and the cost), so rows stay where they are and only a row per
    window, of which ``starts`` names the first guesses, comes back. Rows that lack a value, or
    belong to no window of ``starts``, take no part; a window without rows keeps its guess.
    """
    rows = df.select(F.col(by).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    held = {k: np.array(p, float) for k, p in starts.items()}
    best = {k: (np.inf, p, 1e-2) for k, p in held.items()}  # cost, parameters, damping
    system: dict[object, tuple[np.ndarray, np.ndarray]] = {}
    open_ = set(held)
    for _ in range(steps):
        if not open_:
            break
        table = df.sparkSession.createDataFrame([(k, *map(float, held[k])) for k in open_], f"k {dict(rows.dtypes)['k']}, p0 double, p1 double, p2 double, p3 double")
        value, slopes = _rectangle(F.col("x"), [F.col(f"p{i}") for i in range(4)])
        joined = rows.join(F.broadcast(table), "k")  # a row per window
        named = joined.withColumns({"r": F.col("y") - value, **{f"d{i}": s for i, s in enumerate(slopes)}})
        pairs = [(i, j) for i in range(4) for j in range(i, 4)]
        sums = [F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"g{i}{j}") for i, j in pairs] + [F.sum(F.col(f"d{i}") * F.col("r")).alias(f"b{i}") for i in range(4)]
        found = {r["k"]: r for r in named.groupBy("k").agg(F.sum(F.col("r") * F.col("r")).alias("cost"), *sums).collect()}
        for k in list(open_):
            if k not in found:
                open_.discard(k)
                continue
            r, (cost, p, damp) = found[k], best[k]
            if r["cost"] < cost:
                gram = np.zeros((4, 4))
                for i, j in pairs:
                    gram[i, j] = gram[j, i] = r[f"g{i}{j}"]
                system[k] = (gram, np.array([r[f"b{i}"] for i in range(4)]))
                if cost - r["cost"] <= close * r["cost"] or r["cost"] < 1e-12:
                    open_.discard(k)
                best[k] = (r["cost"], held[k], damp / 3)
            else:
                best[k] = (cost, p, damp * 5)
                if damp > 1e8:
                    open_.discard(k)
            gram, slope = system[k]
            cost, p, damp = best[k]
            new = p + np.linalg.solve(gram + damp * np.diag(np.diag(gram) + 1e-12), slope)
            new[2:] = np.maximum(new[2:], 1e-6)
            held[k] = new
    return {k: p for k, (_, p, _) in best.items()}


def transfer_limits(curve: np.ndarray, share: float = 0.01) -> tuple[float, float]:
    """Distances at which a window's steps let ``share`` through, below and above it."""
    odds = np.log(share / (1 - share))
    return float(curve[0] + curve[2] * odds), float(curve[1] - curve[3] * odds)
