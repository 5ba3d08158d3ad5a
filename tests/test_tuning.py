"""The tuning loop and the index of peaks."""

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from peakloom.operators import fdr, perceptron
from peakloom.operators.candidates import extract_traces
from peakloom.operators.joins import band_join
from peakloom.operators.optimise import Lock, Targeted, doubling_batches
from peakloom.operators.peak_index import build_index
from peakloom.plans.optimisation import Tuning, tune_search
from peakloom.plans.search import Settings


def test_index_gives_the_band_join(spark):
    rng = np.random.default_rng(1)
    peaks = spark.createDataFrame(pd.DataFrame({"cycle": rng.integers(0, 2000, 5000), "mz": np.r_[rng.uniform(200, 210, 3000), np.full(2000, 205.0)], "intensity": rng.uniform(1, 9, 5000)}))
    wanted = spark.createDataFrame(pd.DataFrame({"precursor_idx": np.arange(300), "fragment": "y1", "mz_library": np.r_[rng.uniform(200, 210, 299), 205.0]}))
    index = build_index(peaks, ppm=20, cycles=300, buckets=4)
    for ppm in (5, 20, 90):
        rows = lambda df: sorted(tuple(r) for r in df.select("precursor_idx", "cycle", "mz").collect())
        got, want = rows(index.near(wanted, "mz_library", ppm=ppm)), rows(band_join(peaks, wanted, "mz", "mz_library", ppm=ppm))
        assert got == want and len(got) > 2000
        limited = wanted.withColumns({"first_cycle": F.lit(250), "last_cycle": F.lit(900)})
        assert rows(index.near(limited, "mz_library", ppm=ppm)) == [r for r in want if 250 <= r[1] <= 900]
    index.drop()


def test_index_is_read_without_a_shuffle(spark):
    peaks = spark.range(20_000).select(F.pmod("id", F.lit(500)).alias("cycle"), (200 + F.col("id") / 100).alias("mz"), F.lit(1.0).alias("intensity"))
    wanted = spark.range(2000).select(F.col("id").alias("precursor_idx"), F.lit("y1").alias("fragment"), (200 + F.col("id") / 10).alias("mz_library"))
    index = build_index(peaks, buckets=3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = index.near(wanted, "mz_library", ppm=10)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert extract_traces(index, wanted, ppm=10).count() > 0
    index.drop()


def test_lock_follows_its_plan():
    rng = np.random.default_rng(2)
    for _ in range(200):
        total, first = (int(x) for x in rng.integers(1, 5000, 2))
        plan = doubling_batches(total, first)
        assert plan[0][0] == 0 and plan[-1][1] == total and all(a[1] == b[0] for a, b in zip(plan, plan[1:]))
        assert all(b[1] - b[0] == 2 * (a[1] - a[0]) for a, b in zip(plan, plan[1:-1]))
        lock, target = Lock(total, first, 50), 50
        while True:
            found = int(rng.integers(0, 120))
            start, stop = lock.span
            more = lock.update(found)
            if found >= target:
                assert more and lock.span[0] == 0
                ends = [e for _, e in plan]
                assert lock.span[1] == min(e for e in ends if e >= min(stop * target / found, total))
                break
            assert more == (stop < total)
            if not more:
                break
            assert lock.span[0] == stop


def test_tuning_finds_a_shift(spark):
    """Peaks lie 12 ppm off and 20 s late: both are found on a part of the library, and tolerances close in."""
    rng = np.random.default_rng(5)
    n, cycles = 400, 60
    rt = rng.uniform(15, 45, n)
    prec = spark.createDataFrame(pd.DataFrame({
        "precursor_idx": np.arange(n), "elution_group_idx": np.arange(n) // 2, "decoy": np.arange(n) % 2, "proteins": [f"P{i}" for i in range(n)], "sequence": [f"S{i}" for i in range(n)], "rt_library": rt * 2.0}))
    frag, peaks = [], []
    for i in range(n):
        for k in range(5):
            mz = 300.0 + i * 1.5 + k * 0.21
            frag.append((i, f"y{k + 1}", mz, 1.0 + k))
            shape = np.exp(-((np.arange(cycles) - rt[i] - 10) ** 2) / 8) * (1.0 + k) * 1000 if i % 2 == 0 else np.zeros(cycles)
            peaks += [(c, mz * (1 + 12e-6 + rng.normal(0, 1e-6)), float(v)) for c, v in enumerate(shape + rng.uniform(1, 60, cycles))]
    f = spark.createDataFrame(frag, "precursor_idx long, fragment string, mz_library double, intensity_library double")
    index = build_index(spark.createDataFrame(pd.DataFrame(peaks, columns=["cycle", "mz", "intensity"])), ppm=30)
    tuning = Tuning(first_batch=50, target=40, fdr=0.05, mz=Targeted(30.0, 6.0), rt=Targeted(60.0, 40.0))
    out = tune_search(prec, f, index, Settings(cycle_seconds=2.0), tuning)
    assert out.enough and out.settings.selection.ppm == 6.0 and out.rt_tolerance == 40.0
    moved = out.library(prec, f).agg(F.avg((F.col("mz_library") / F.col("mz_theoretical") - 1) * 1e6)).first()[0]
    assert abs(moved - 12) < 0.5
    late = out.rt.predict(prec).agg(F.avg(F.col("rt_predicted") - F.col("rt_library"))).first()[0]
    assert abs(late - 20) < 2
    assert max(r["stop"] for r in out.rounds) < n // 2 and len(out.rounds) >= 3
    assert out.settings.selection.score_cutoff == 0  # it would have left no decoys
    index.drop()


def test_classifiers_start_where_the_last_ended(spark):
    rng = np.random.default_rng(7)
    n = 1200
    decoy = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 3)) + decoy[:, None] * np.array([1.5, 0.0, 0.0])
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "decoy": decoy, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    starts: dict = {}
    settings = {"by": ["i"], "layers": (4,), "folds": 2}

    def right(**more):
        out = fdr.classify(df, ["a", "b", "c"], "decoy", **settings, **more)
        return out.select(F.avg(((F.col("proba") > 0.5) == (F.col("decoy") == 1)).cast("int"))).first()[0]

    cold, learned = right(iterations=1), right(iterations=40, starts=starts)
    assert len(starts) == 2 and learned > 0.7
    before = {k: list(v) for k, v in starts.items()}
    assert right(iterations=1, starts=starts) >= learned - 0.02 > cold - 0.02
    assert all(np.abs(np.array(starts[k]) - np.array(before[k])).max() < 1 for k in before)
    assert right(iterations=1, starts={"other": [0.0]}) == cold  # other features, other models


def test_folds_learn_in_shared_scans_as_pyspark_does(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n = 3000
    decoy = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.01] + decoy[:, None] * np.array([1.0, 40.0, 0.0]) + [0.0, 5000.0, 0.0]
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "decoy": decoy, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    scans, sums = [], perceptron._sums
    monkeypatch.setattr(perceptron, "_sums", lambda *a: scans.append(sorted(a[1])) or sums(*a))
    got = {r["i"]: r["proba"] for r in fdr.classify(df, ["a", "b", "c"], "decoy", by=["i"], seed=5).collect()}
    assert len(got) == n and scans[0] == [0, 1, 2] and len(scans) < 30
    rows = df.withColumn("fold", F.expr("pmod(xxhash64(i, 5), 3)")).withColumn("y", F.col("decoy").cast("double"))
    net = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[3, 20, 5, 2], seed=5, maxIter=15, blockSize=4096)  # one block: pyspark.ml weighs blocks, not rows
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), net]).fit(rows.where("fold <> 1").coalesce(1))
    for r in model.transform(rows.where("fold = 1")).select("i", "probability").collect():
        assert abs(got[r["i"]] - r["probability"][1]) < 0.002


def test_gradient_is_that_of_the_cross_entropy():
    rng = np.random.default_rng(2)
    sizes = [3, 4, 3, 2]
    w, x, y = rng.normal(size=4 * 4 + 5 * 3 + 4 * 2), rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    rows, loss, *gradient = perceptron._gradient(x, y, perceptron._layers(w, sizes))
    at = lambda v: perceptron._gradient(x, y, perceptron._layers(v, sizes))[1]
    assert rows == 50 and np.allclose(gradient, [(at(w + d) - at(w - d)) / 2e-6 for d in np.eye(len(w)) * 1e-6], atol=1e-5)
