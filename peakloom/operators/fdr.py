"""Error control: classify targets against decoys, then q-values of the best rows."""

from __future__ import annotations

import warnings
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.sources.shared import Scratch

from .aggregates import any_null, protein_features
from .perceptron import first_weights, learn, score
from .ranking import keep_best, q_values


def classify(df: DataFrame, features: list[str], decoy: str, *, layers: tuple[int, ...] = (20, 5), seed: int = 0, folds: int = 3, iterations: int = 15, out: str = "proba", by: list[str] | None = None, starts: dict[str, list[float]] | None = None) -> DataFrame:
    """Rows with the probability that each is a decoy; rows that lack a feature are dropped.

    Rows fall into folds by the hash of the columns ``by`` (the features by default, whose last
    bits may differ from run to run), and each fold is scored by a perceptron that learned on the
    others, so that no row's own label speaks for it; few ``iterations`` keep it from learning
    single rows by heart. Where the others lack one of the classes,
    all rows are learned from. Targets and decoys should be about as many; a warning tells if not.

    ``starts`` holds the weights of earlier models by features, layers and fold: a model begins
    with those of its own, and leaves its weights there for the next search. A fold's weights
    never came from its rows, as long as rows keep their fold (``by`` names stable columns).
    """
    scratch = Scratch(df.sparkSession, "classify")
    fold = F.pmod(F.xxhash64(*(by or features), F.lit(seed)), F.lit(folds)).cast("int")
    known = scratch.save(df.where(~any_null(features)).withColumn("_y", F.col(decoy).cast("double")).withColumn("_fold", fold))
    counts = Counter({(r["_fold"], r["_y"]): r["count"] for r in known.groupBy("_fold", "_y").count().collect()})
    decoys, targets = (sum(n for (_, y), n in counts.items() if y == label) for label in (1.0, 0.0))
    if abs(decoys - targets) > 0.1 * (decoys + targets) / 2:
        warnings.warn(f"{targets} targets and {decoys} decoys are far from equal in number", stacklevel=2)
    sizes, first, names = [len(features), *layers, 2], None, {}
    begin, every = {}, set()
    for f in range(folds):
        others = all(sum(n for (g, y), n in counts.items() if g != f and y == label) for label in (0.0, 1.0))
        if not any(counts[f, y] for y in (0.0, 1.0)):
            continue
        if others:
            names[f] = f"{'|'.join(features)}/{layers}/{folds}/{seed}/{f}"
        else:
            every.add(f)
        start = (starts or {}).get(names.get(f))
        if start is None and first is None:
            first = first_weights(df.sparkSession, sizes, seed)
        begin[f] = first if start is None else np.array(start)
    if not begin:
        return known.select(*df.columns, F.lit(1.0).alias(out))
    rows = known.select("_fold", "_y", *(F.col(c).cast("double").alias(c) for c in features))
    models = learn(rows, features, sizes, begin, every, iterations)
    if starts is not None:
        starts.update({name: [float(x) for x in models[f][0]] for f, name in names.items()})
    return known.withColumn(out, score(models, sizes, "_fold", features)).select(*df.columns, out)


def control(df: DataFrame, features: list[str], *, keys: list[str], idx: str = "precursor_idx", decoy: str = "decoy", least: int = 20, seed: int = 0, starts: dict[str, list[float]] | None = None) -> DataFrame:
    """Probabilities and q-values of the best row per key.

    With too few rows to learn from, proba and qval are 1. ``starts`` is as for classify.
    """
    counts = df.groupBy(decoy).count().collect()
    if len(counts) < 2 or min(r["count"] for r in counts) < least:
        return keep_best(df.withColumn("proba", F.lit(1.0)), keys, [idx]).withColumn("qval", F.lit(1.0))
    scored = classify(df, features, decoy, seed=seed, by=[idx], starts=starts)
    best = keep_best(scored, keys, ["proba", idx])
    return q_values(best, "proba", decoy, [idx])


def control_by_channel(df: DataFrame, features: list[str], channels: list[int], *, decoy_channel: int | None = None, **settings) -> DataFrame:
    """Error control in each channel on its own, against decoys or a decoy channel."""
    parts = []
    for c in channels:
        rows = df.where(F.col("channel") == c)
        if decoy_channel is not None:
            both = df.where((F.col("channel") == c) | (F.col("channel") == decoy_channel))
            rows = both.where(F.col("decoy") == 0).withColumn("decoy", (F.col("channel") == decoy_channel).cast("int"))
        parts.append(control(rows, features, **settings))
    return reduce(DataFrame.unionByName, parts)


def protein_control(psm: DataFrame, *, seed: int = 42, least: int = 20) -> DataFrame:
    """Add pg_qval: q-values of protein groups from features of their rows, joined back.

    With fewer than ``least`` targets or decoys to learn from, a group's best row is its score.
    """
    # Without the names all values are numbers, and Spark aggregates by hash instead of sorting all rows; the perceptron keeps the order of groups.
    features = protein_features(psm).drop("genes", "proteins").sortWithinPartitions("pg", "decoy")
    numbers = ["n_precursors", "n_peptides", "n_runs", "mean_score", "best_score", "worst_score", "n_rows"]
    counts = {r["decoy"]: r["count"] for r in features.groupBy("decoy").count().collect()}
    if len(counts) < 2:
        return psm.withColumn("pg_qval", F.lit(0.0 if counts.get(0) else 1.0))
    scale = counts[0] / counts[1]
    learned = classify(features, numbers, "decoy", seed=seed, by=["pg", "decoy"]) if min(counts.values()) >= least else features.withColumn("proba", F.col("best_score"))
    scored = q_values(learned, "proba", "decoy", ["pg"], scale=scale)
    return psm.join(scored.select("pg", "decoy", F.col("qval").alias("pg_qval")), ["pg", "decoy"], "left")
