"""Perceptrons of several folds, learned together: gradients are sums over Spark's partitions."""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.sources.shared import Scratch

#: Rows of one product; small enough for it to stay in one thread.
CHUNK = 2048


def first_weights(spark: SparkSession, sizes: list[int], seed: int) -> np.ndarray:
    """Weights that pyspark.ml's perceptron of these layers begins with."""
    two = spark.createDataFrame([(Vectors.dense([0.0] * sizes[0]), y) for y in (0.0, 1.0)], ["x", "y"]).coalesce(1)
    return np.array(MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=sizes, seed=seed, maxIter=0).fit(two).weights)


def _layers(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (inputs, outputs) and offsets of each layer, as pyspark.ml lays them out."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Outputs of the input and the hidden layers, and by how much class 1 is ahead."""
    seen = [x]
    with np.errstate(over="ignore"):
        for w, b in layers[:-1]:
            z = seen[-1] @ w
            z += b
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1
            seen.append(np.reciprocal(z, out=z))
    w, b = layers[-1]
    return seen, seen[-1] @ (w[:, 1] - w[:, 0]) + (b[1] - b[0])


def _gradient(x: np.ndarray, y: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows, cross entropy and its gradient, summed over rows."""
    seen, ahead = _forward(x, layers)
    small = np.exp(-np.abs(ahead))
    loss = (np.maximum(np.where(y == 1, -ahead, ahead), 0) + np.log(1 + small)).sum(dtype=np.float64)
    off = np.where(ahead >= 0, 1, small) / (1 + small) - y  # of class 1; class 0 is off by as much the other way
    last = np.outer(seen[-1].T @ off, [-1, 1])
    parts: list[np.ndarray] = [last.ravel(), off.sum() * np.array([-1, 1])]
    w = layers[-1][0]
    e = np.outer(off, w[:, 1] - w[:, 0])
    for k in range(len(layers) - 1, 0, -1):
        e *= seen[k]
        e *= np.subtract(1, seen[k], out=seen[k])
        parts = [(seen[k - 1].T @ e).ravel(), e.sum(0), *parts]
        if k > 1:
            e = e @ layers[k - 1][0].T
    return np.concatenate([[len(x), loss], *parts])


def _pack(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Rows (_fold, _y, features) as blocks of bytes, a batch each, which later scans need not turn into batches again."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, y, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = ((np.column_stack(columns) - mean) * scale).astype(np.float32)
            yield pa.RecordBatch.from_pydict({name: pa.array([v.tobytes()], pa.binary()) for name, v in (("fold", fold.astype(np.int32)), ("y", y.astype(np.int8)), ("x", x))})

    return rows.mapInArrow(part, "fold binary, y binary, x binary")


def _sums(blocks: DataFrame, points: dict[int, np.ndarray], scales: dict[int, tuple[np.ndarray, np.ndarray]], every: set[int], sizes: list[int]) -> dict[int, tuple[float, np.ndarray]]:
    """Mean cross entropy and gradient at each fold's point, over the rows that it learns from."""
    length = 2 + len(next(iter(points.values())))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = {f: (_layers(w.astype(np.float32), sizes), *(v.astype(np.float32) for v in scales[f])) for f, w in points.items()}
        sums = {f: np.zeros(length) for f in points}
        for batch in batches:
            for block in zip(*batch.columns):
                fold, y, x = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(block, (np.int32, np.int8, np.float32)))
                x = x.reshape(len(y), sizes[0])
                for f, (net, mean, scale) in nets.items():
                    rows = slice(None) if f in every else fold != f
                    z, label = (x[rows] - mean) * scale, y[rows].astype(np.float32)
                    for at in range(0, len(z), CHUNK):
                        sums[f] += _gradient(z[at : at + CHUNK], label[at : at + CHUNK], net)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"task": pa.array([task] * len(sums), pa.int32()), "fold": pa.array(list(sums), pa.int32()), "sums": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))})

    rows = blocks.mapInArrow(part, "task int, fold int, sums array<double>").collect()  # weights per task and fold
    total = {f: np.zeros(length) for f in points}
    for r in sorted(rows, key=lambda r: r["task"]):  # in one order, so that runs agree
        total[r["fold"]] += r["sums"]
    return {f: (s[1] / s[0], s[2:] / s[0]) for f, s in total.items()}


def _step(w: np.ndarray, d: np.ndarray, f0: float, g0: np.ndarray, t: float) -> Generator:
    """Length, value, slope and gradient of a step along ``d`` by the strong Wolfe rules; None if there is none."""
    slope = g0 @ d
    low, high = (0.0, f0, slope, g0), None
    for _ in range(20):
        f, g = yield w + t * d
        if not np.isfinite(f):
            t /= 2
            continue
        here = (t, f, g @ d, g)
        if f > f0 + 1e-4 * t * slope or f >= low[1]:
            high = here
        elif abs(here[2]) <= 0.9 * abs(slope):
            return here
        elif high is None and here[2] < 0:
            low, t = here, 1.5 * t
            continue
        else:
            if high is None or here[2] * (high[0] - low[0]) >= 0:
                high = low
            low = here
        a, b = sorted((low, high), key=lambda p: p[0])
        d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        d2 = np.sqrt(max(d1 * d1 - a[2] * b[2], 0.0))
        wide = b[0] - a[0]
        t = float(np.clip(b[0] - wide * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2 or 1e-300), a[0] + 0.1 * wide, a[0] + 0.9 * wide))
    return None


def _minimise(w: np.ndarray, iterations: int, *, memory: int = 10, tol: float = 1e-6) -> Generator:
    """L-BFGS that yields points and is sent (value, gradient); its result is the last point."""
    f, g = yield w
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(iterations):
        if np.linalg.norm(g) <= max(tol * abs(f), 1e-8):
            break
        d, shares = -g, []
        for s, y in reversed(past):
            shares.append((s @ d) / (s @ y))
            d = d - shares[-1] * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), share in zip(past, reversed(shares)):
            d = d + s * (share - (y @ d) / (s @ y))
        found = yield from _step(w, d, f, g, 1.0 if i else 1 / np.linalg.norm(d))
        if found is None:
            break
        t, f, _, after = found
        if (t * d) @ (after - g) > 0:
            past = [*past, (t * d, after - g)][-memory:]
        w, g = w + t * d, after
    return w


def learn(rows: DataFrame, features: list[str], sizes: list[int], begin: dict[int, np.ndarray], every: set[int], iterations: int) -> dict[int, tuple]:
    """Weights, means and scales by fold, each learned from the rows (_fold, _y, features) of the other folds.

    ``begin`` holds each fold's first weights; folds in ``every`` learn from all rows. A scan of the
    rows serves all folds; products are in single precision, sums in double.
    """
    stats = rows.groupBy("_fold").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(features) for f in (F.avg, F.var_pop))).collect()
    stats = sorted(stats, key=lambda r: r["_fold"])

    def scale_of(some: list) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([r["n"] for r in some], dtype=float)[:, None]
        means, spread = (np.array([[r[f"{name}{i}"] for i in range(len(features))] for r in some]) for name in ("avg", "var_pop"))
        mean = (n * means).sum(0) / n.sum()
        std = np.sqrt((n * (spread + (means - mean) ** 2)).sum(0) / max(n.sum() - 1, 1))
        return mean, np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)

    scales = {f: scale_of([r for r in stats if f in every or r["_fold"] != f]) for f in begin}
    centre, unit = scale_of(stats)
    inner = {f: ((mean - centre) * unit, np.divide(scale, unit, out=np.zeros_like(unit), where=unit > 0)) for f, (mean, scale) in scales.items()}
    scratch = Scratch(rows.sparkSession, "perceptron")
    blocks = scratch.save(_pack(rows, centre, unit))
    searches = {f: _minimise(w, iterations) for f, w in begin.items()}
    points, done = {f: next(s) for f, s in searches.items()}, {}
    while points:
        for f, value in _sums(blocks, points, inner, every, sizes).items():
            try:
                points[f] = searches[f].send(value)
            except StopIteration as end:
                done[f] = end.value
                del points[f]
    scratch.drop(blocks)
    return {f: (w, *scales[f]) for f, w in done.items()}


def score(models: dict[int, tuple], sizes: list[int], fold: str, features: list[str]) -> Column:
    """Probability of class 1 by the model of the row's fold."""

    @F.pandas_udf("double")
    def probability(number: pd.Series, *columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        out = np.full(len(number), np.nan)
        for f, (w, mean, scale) in models.items():
            rows = (number == f).to_numpy()
            with np.errstate(over="ignore"):
                out[rows] = 1 / (1 + np.exp(-_forward((x[rows] - mean) * scale, _layers(w, sizes))[1]))
        return pd.Series(out)

    return probability(fold, *(F.col(c).cast("double") for c in features))
