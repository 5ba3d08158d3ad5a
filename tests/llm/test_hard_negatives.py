"""Hard negatives against plain sorting."""

import numpy as np
from pyspark.sql import functions as F

from peakloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def truth(rows, divisor=10, positives=5, negatives=10):
    sound = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (a, va, ya) in enumerate(sound):
        if a % divisor:
            continue
        others = [(sum(x * y for x, y in zip(va, v)), i, y) for m, (i, v, y) in enumerate(sound) if m != n and len(v) == len(va)]
        best = sorted((-s, i) for s, i, y in others if y == ya)[:positives]
        for p, i in best:
            found = sorted((-s, j) for s, j, y in others if y != ya and 30 * -p <= 100 * s <= 90 * -p)[:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(found)]
    return sorted(out)


def rows_of(n=700, dims=6):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[100:330] = x[100]  # a third of the rows is one vector: ties everywhere
    rows = [(int(i), [float(v) for v in e], int(rng.integers(0, 4))) for i, e in enumerate(x)]
    rows += [rows[20], rows[20], rows[40], (60, rows[40][1], 1), (-10, rows[50][1], 2)]
    return rows + [(None, rows[0][1], 1), (1000, None, 1), (1010, rows[1][1], None), (1020, [1.0, None], 1), (1030, [float("inf")] * dims, 0), (1040, [], 0), (1050, [1.0, 2.0], 0), (1060, [1.0, 1.0], 0), (1070, [1.0, 1.5], 1)]


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_sorting(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = truth(rows)
    assert len(want) > 500 and len({r[0] for r in want}) > 30
    assert collected(hn.hard_negatives(df, F.col("vec_id") % 10 == 0)) == want
    monkeypatch.setattr(hn, "PASS_ANCHORS", 20)  # several passes, tiles and batches
    monkeypatch.setattr(hn, "TILE", 7)
    monkeypatch.setattr(hn, "ROWS", 50)
    assert collected(hn.hard_negatives(df.withColumns({c: F.lit("x") for c in ("anchor", "mark", "score", "copies", "place", "block")}), F.col("vec_id") % 10 == 0)) == want


def test_large_components_stay_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20 + 1, 5.0], [1.0, 1.0]])
    assert hn.products(a, b).tolist() == [[2**40 * (2**20 + 1) + 15, 2**40 + 3]]


def test_empty(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 2)], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
