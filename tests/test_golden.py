"""Small cases with known results."""

import math
import time
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from peakloom.functions import scalars
from peakloom.operators import aggregates, calibrate, candidates, competition, fdr, grouping, joins, library, optimise, quantify, ranking, signal
from peakloom.operators.components import connected_components
from peakloom.plans.search import Settings, combine, merge_config, requantify_all_fragments, requantify_channels, search_run
from peakloom.sources import saved, spectra, tables
from peakloom.sources.shared import Scratch, shared_dir
from peakloom.streaming import accumulate


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_keep_best(spark):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({"proba": rng.permutation(400) / 400, "precursor_idx": rng.integers(0, 60, 400), "channel": rng.integers(0, 3, 400)})
    for keys in (["precursor_idx"], ["channel", "precursor_idx"]):
        for n in (1, 3):
            want = pdf.sort_values("proba").groupby(keys).head(n)
            got = ranking.keep_best(spark.createDataFrame(pdf), keys, ["proba"], n).toPandas()
            assert sorted(got.proba) == sorted(want.proba)


def plain_q_values(rows):
    """q-values of (score, decoy) in order, by their definition."""
    ratios, t, d = [], 0, 0
    for _, decoy in rows:
        t, d = t + (not decoy), d + decoy
        ratios.append(d / t if t else ranking.NO_TARGET)
    return [min(ratios[i:]) for i in range(len(rows))]


def test_q_values(spark):
    rng = np.random.default_rng(11)
    for n, values in ((1, 5), (300, 40), (300, 10_000)):
        rows = sorted((int(rng.integers(values)) / values, int(rng.random() < 0.3)) for _ in range(n))
        df = frame(spark, i=list(range(n)), proba=[r[0] for r in rows], decoy=[r[1] for r in rows])
        got = [r["qval"] for r in ranking.q_values(df, "proba", "decoy", ["i"]).orderBy("i").collect()]
        assert np.allclose(got, plain_q_values(rows))
    first = frame(spark, i=[0, 1], proba=[0.1, 0.2], decoy=[1, 1])
    assert {r["qval"] for r in ranking.q_values(first, "proba", "decoy", ["i"]).collect()} == {ranking.NO_TARGET}


def test_q_values_take_linear_time(spark):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("i"), (F.xxhash64("id") % 100_000 / 100_000).alias("proba"), (F.col("id") % 3 == 0).cast("int").alias("decoy"))
    began = time.time()
    ranking.q_values(df, "proba", "decoy", ["i"]).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 60  # a quadratic pass over two blocks of 100,000 rows takes minutes


def test_quantiles(spark):
    rng = np.random.default_rng(12)
    for n in (1, 2, 7, 1000):
        x = rng.integers(0, 50, n) / 7
        shares = [0.0, 0.001, 0.3, 0.5, 0.975, 1.0]
        assert np.allclose(ranking.quantiles(frame(spark, x=x), "x", shares), np.quantile(x, shares))
    none = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert ranking.quantiles(none, "x", [0.5]) == [None]


@pytest.mark.parametrize("most", [0, 30, 1000])
def test_protein_grouping(spark, most):
    rng = np.random.default_rng(13)
    lists = [";".join(f"P{p:02d}" for p in rng.choice(25, int(rng.integers(1, 5)), replace=False)) for _ in range(120)]
    decoy = [int(x) for x in rng.random(120) < 0.3]
    df = frame(spark, precursor_idx=list(range(120)), proteins=lists, decoy=decoy)
    master = {}
    for side in (0, 1):  # repeated choice of the id with most uncovered rows, the first seen on ties
        open_ = {i: lists[i].split(";") for i in range(120) if decoy[i] == side}
        seen = list(dict.fromkeys(p for ids in open_.values() for p in ids))
        while open_:
            best = max(seen, key=lambda p: (sum(p in ids for ids in open_.values()), -seen.index(p)))  # noqa: B023
            for i in [i for i, ids in open_.items() if best in ids]:
                master[i] = best
                del open_[i]
    chosen = set(master.values())
    rows = grouping.infer_groups(df, most=most).orderBy("precursor_idx").collect()
    assert [r["pg_master"] for r in rows] == [master[i] for i in range(120)]
    assert [r["pg"] for r in rows] == [";".join(sorted(set(ids.split(";")) & chosen)) for ids in lists]
    if most == 1000:
        parsimony = grouping.infer_groups(df, strategy="maximum_parsimony").orderBy("precursor_idx").collect()
        assert [r["pg"] for r in parsimony] == [master[i] for i in range(120)]


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(200)]
    more = [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 300, (150, 2))]
    got = {r["u"]: r["component_id"] for r in connected_components(spark.createDataFrame(chain + more, "u long, v long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(201))
    up = {n: n for e in more for n in e}
    for _ in range(300):
        for a, b in more:
            up[a] = up[b] = min(up[a], up[b])
    assert all(got[n] == c for n, c in up.items() if n in got)


def test_fragment_overlap():
    rng = np.random.default_rng(14)
    for n, m in ((40, 60), (1, 9), (0, 5), (5, 0)):
        a, b = rng.uniform(400, 400.2, n), rng.uniform(400, 400.2, m)
        assert competition.shared_fragments(a, b, 20) == (np.abs(a[:, None] - b[None, :]) <= b[None, :] * 20e-6).sum()


@pytest.mark.parametrize("most", [0, 10, 10_000])
def test_competition(spark, most):
    rng = np.random.default_rng(15)
    n = 150
    psm = pd.DataFrame({"id": range(n), "window_idx": rng.integers(0, 2, n), "rt": rng.uniform(0, 30, n), "proba": rng.permutation(n) / n})
    mz = {i: rng.choice(np.arange(300.0, 330.0), 6, replace=False) for i in range(n)}
    frag = frame(spark, id=[i for i in range(n) for _ in mz[i]], mz=[float(v) for i in range(n) for v in mz[i]])
    gone = set()
    for a in psm.sort_values("proba").itertuples():
        if a.id not in gone:
            for b in psm.itertuples():
                if b.proba > a.proba and b.window_idx == a.window_idx and abs(a.rt - b.rt) < 3 and len(set(mz[a.id]) & set(mz[b.id])) >= 3:
                    gone.add(b.id)
    assert gone
    got = {r["id"] for r in competition.compete(spark.createDataFrame(psm), frag, most=most).collect()}
    assert got == set(range(n)) - gone


def test_hashes(spark):
    rng = np.random.default_rng(16)
    cols = {c: [int(x) for x in rng.integers(0, top, 20)] for c, top in (("i", 1 << 31), ("r", 200), ("k", 99), ("z", 5), ("l", 99))}
    df = frame(spark, n=list(range(20)), **cols).orderBy("n")
    c = {k: F.col(k) for k in cols}
    got = df.select(scalars.candidate_hash(c["i"], c["r"]).alias("a"), scalars.ion_hash(c["i"], c["r"], c["k"], c["z"], c["l"]).alias("b")).collect()
    for j, r in enumerate(got):
        i, rank, k, z, loss = (cols[x][j] for x in "irkzl")
        assert r["a"] == i + rank * 2**32 and r["b"] == i + rank * 2**32 + k * 2**40 + z * 2**48 + loss * 2**56


def test_multiplex(spark):
    cand = frame(spark, eg=[7, 7, 9, 9], prec=[70, 71, 90, 91], proba=[0.35, 0.25, 0.6, 0.75])
    lib = frame(spark, precursor_idx=[70, 71, 72, 90, 91, 92, 99], eg=[7, 7, 7, 9, 9, 9, 11], channel=[0, 2, 5, 0, 2, 5, 0])
    out = joins.multiplex(cand, lib, group="eg", channel="channel", order=["proba"], channels=[0, 5]).orderBy("precursor_idx").collect()
    assert [(r["precursor_idx"], r["proba"]) for r in out] == [(70, 0.25), (72, 0.25), (90, 0.6), (92, 0.6)]
    assert joins.multiplex(cand, lib, group="eg", channel="channel", order=["proba"], channels=[]).count() == 0


def test_lookup(spark):
    targets = frame(spark, k=[3, 5, 8, 13], f=[1, 1, 2, 4])
    out = joins.lookup_with_fallback(targets, frame(spark, k=[5], v=[-1.5]), frame(spark, f=[1, 2], v=[6.5, 7.5]), key="k", fallback_key="f", value="v", out="x")
    assert [r["x"] for r in out.orderBy("k").collect()] == [6.5, -1.5, 7.5, None]


def test_band_join_is_exact(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(100, 110, 300), rng.uniform(100, 110, 300)
    got = joins.band_join(frame(spark, x=a), frame(spark, y=b), "x", "y", ppm=500).count()
    assert got == int((np.abs(a[:, None] - b[None, :]) <= b[None, :] * 500e-6).sum())


def test_fragment_filter(spark):
    rng = np.random.default_rng(17)
    pdf = pd.DataFrame({"pg": rng.choice(list("UVW"), 90), "quality": rng.permutation(90) / 90})
    pdf["ion"] = pdf.pg + rng.integers(0, 8, 90).astype(str)
    mean = pdf.groupby(["pg", "ion"]).quality.mean().reset_index()
    for n, least in ((2, 0.5), (1, 0.6), (3, 2.0)):
        rank = mean.groupby("pg").quality.rank(ascending=False)
        want = set(mean[(rank <= n) | (mean.quality > least)].ion)
        assert {r["ion"] for r in quantify.filter_ions(spark.createDataFrame(pdf), "pg", "ion", "quality", top_n=n, min_quality=least).collect()} == want


def test_label_free_recovers_ratios(spark):
    true = {"r1": 1.0, "r2": 2.0, "r3": 4.0}
    rows = [(f"g{g}", f"g{g}i{i}", r, 1000.0 * (i + 1) * (f if g == 0 else 1.0)) for g in range(6) for i in range(4) for r, f in true.items()]
    out = quantify.label_free(spark.createDataFrame(rows, "g string, i string, run string, v double"), "g", "i", "run", "v").toPandas()
    p = out[out.g == "g0"].set_index("run").intensity
    assert math.isclose(p["r2"] / p["r1"], 2, rel_tol=1e-6) and math.isclose(p["r3"] / p["r1"], 4, rel_tol=1e-6)
    assert math.isclose(out[out.g == "g1"].intensity.std(), 0, abs_tol=1e-6)


def test_label_free_is_a_median_polish(spark):
    rng = np.random.default_rng(18)
    logs = rng.normal(20, 3, (30, 1)) + rng.normal(0, 1, (1, 7)) + rng.normal(0, 0.2, (30, 7))
    logs[rng.random(logs.shape) < 0.3] = np.nan
    logs = logs[np.isfinite(logs).sum(1) > 1]
    means = np.nanmean(logs, 1, keepdims=True)
    table = logs - np.nanmedian(logs - means, 0, keepdims=True)
    profile = np.zeros(7)
    for _ in range(4):
        shift = np.nanmedian(table - profile, 1, keepdims=True)
        profile = np.nanmedian(table - shift, 0)
    want = 2**profile * np.nansum(2**table) / (2**profile).sum()
    rows = [("g", i, r, float(2 ** logs[i, r])) for i in range(len(logs)) for r in range(7) if np.isfinite(logs[i, r])]
    got = quantify.label_free(spark.createDataFrame(rows, "g string, i long, run int, v double"), "g", "i", "run", "v").orderBy("run").toPandas()
    assert np.allclose(got.intensity, want)


def test_cycle():
    """Random schemes, with and without other spectra before the first cycle."""
    rng = np.random.default_rng(31)
    for _ in range(60):
        scheme = rng.permutation(1000)[: int(rng.integers(2, 40))].astype(float).tolist()  # a window occurs once a cycle
        repeats = int(rng.integers(4, 9))
        assert signal.cycle_length(scheme * repeats) == len(scheme)
        lead = (rng.permutation(1000)[: int(rng.integers(0, len(scheme)))] + 5000.0).tolist()
        assert signal.cycle_start(lead + scheme * repeats, len(scheme)) == len(lead)
        assert signal.cycle_start(rng.permutation(500).tolist(), len(scheme)) == -1


def test_preprocess(spark):
    rows = [(i, i / 60, 1 if i % 5 == 0 else 2, 0.0 if i % 5 == 0 else 400.0 + 100 * (i % 5), 0.0 if i % 5 == 0 else 500.0 + 100 * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "spec_idx long, rt double, ms_level int, isolation_lower_mz double, isolation_upper_mz double")
    out = spectra.preprocess(df)
    assert out.agg(F.max("cycle"), F.countDistinct("slot")).first() == (11, 5)
    assert spectra.run_statistics(out).first()["n_cycles"] == 12


def test_batches_and_tolerances(spark):
    rng = np.random.default_rng(32)
    for total, first in rng.integers(1, 3000, (50, 2)).tolist():
        sizes, left = [], total
        while left > 0:
            sizes.append(min(left, first << len(sizes)))
            left -= sizes[-1]
        ends = np.cumsum(sizes).tolist()
        assert optimise.doubling_batches(total, first) == list(zip([0, *ends[:-1]], ends))
        assert optimise.doubling_batches(total, first, from_start=True) == [(0, e) for e in ends]
    values = rng.normal(size=(3, 41))
    values[rng.random(values.shape) < 0.3] = np.nan
    values[2] = np.nan
    got = aggregates.median_known(frame(spark, a=values[0], b=values[1], c=values[2]), ["a", "b", "c"])
    assert got == {"a": np.nanmedian(values[0]), "b": np.nanmedian(values[1])}
    out = optimise.optimise(lambda v: {"t": (0, v["t"] / 2), "a": (-abs(v["a"] - 3), v["a"] / 1.5)}, {"t": optimise.Targeted(40, 10), "a": optimise.Automatic(12)})
    assert out["t"] == 10 and 1 < out["a"] < 12


def test_local_regression(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 2000)
    df = frame(spark, x=x, y=np.sin(x) * 5 + rng.normal(0, 0.1, 2000))
    model = calibrate.fit_local(df, "x", "y", kernels=8)
    error = df.select((model.predict(F.col("x")) - F.sin("x") * 5).alias("e")).where(F.col("x").between(0.2, 9.8)).agg(F.max(F.abs("e"))).first()[0]
    assert error < 0.5
    line = calibrate.Estimator("mz", "x", "y", "z", relative=True).fit(frame(spark, x=x + 100, y=(x + 100) * (1 + 5e-6)))
    assert line.interval(frame(spark, x=x + 100, y=(x + 100) * (1 + 5e-6))) < 1e-3


def test_classifier_separates(spark):
    rng = np.random.default_rng(4)
    n = 600
    decoy = np.arange(n) % 2
    df = frame(spark, precursor_idx=np.arange(n), decoy=decoy, a=rng.normal(3 * (1 - decoy), 1), b=rng.normal(0, 1, n))
    out = fdr.control(df, ["a", "b"], keys=["precursor_idx"]).toPandas()
    assert out[(out.qval < 0.05) & (out.decoy == 0)].shape[0] > 200
    assert fdr.control(df.limit(10), ["a", "b"], keys=["precursor_idx"]).select("qval").distinct().collect() == [(1.0,)]


def test_digest_and_fragments(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">sp|P1|X one\nMAAAKCCCCCR\nPDDK\n>P2\nCCCCCRPDDKEE\n")
    prot = spectra.read_fasta(spark, str(tmp_path / "p.fasta"))
    got = {r["peptide"]: r["proteins"] for r in library.digest(prot, missed=1, length=(2, 30)).collect()}
    assert got == {"MAAAK": "P1", "CCCCCRPDDK": "P1;P2", "MAAAKCCCCCRPDDK": "P1", "EE": "P2", "CCCCCRPDDKEE": "P2"}
    lib = frame(spark, precursor_idx=[1], sequence=["PEPTIDEK"])
    f = {(r["type"], r["number"]): r["mz_library"] for r in library.fragments(lib).collect()}
    assert len(f) == 14 and math.isclose(f["y", 1], 147.1128, abs_tol=1e-3) and math.isclose(f["b", 2], 227.1026, abs_tol=1e-3)
    assert [r["sequence"] for r in library.add_decoys(lib).orderBy("decoy").collect()] == ["PEPTIDEK", "PDPTIDDK"]


def test_io_roundtrip(spark, tmp_path):
    df = frame(spark, a=[1, 2], b=[0.5, 1.25], run=["x", "y"])
    for name in ("t.parquet", "t.tsv", "t.csv", "t.jsonl"):
        tables.write_table(df, str(tmp_path / name))
        assert sorted(tuple(r) for r in tables.read_table(spark, str(tmp_path / name)).select("a", "b", "run").collect()) == [(1, 0.5, "x"), (2, 1.25, "y")]
    tables.write_runs(df, str(tmp_path / "runs"))
    assert tables.missing_runs(spark, str(tmp_path / "runs"), ["x", "z"]) == ["z"]
    assert tables.read_runs(spark, {"x": str(tmp_path / "runs/run=x"), "q": str(tmp_path / "none")} | {}, "") .count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        tables.format_of("x.docx")


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        frame(spark, k=["a", "b"], v=[3 - i, i], run=[f"r{i}"] * 2).write.mode("append").parquet(src)
    accumulate.keep_top(accumulate.read_stream(spark, src), str(tmp_path / "out"), str(tmp_path / "c1"), ["k"], ["v"], 1).awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(last)).select("k", "v").collect()) == [("a", 1), ("b", 0)]

    def search(df):
        if df.first()["run"] == "r1":
            raise ValueError("bad run")
        return df

    accumulate.process_runs(accumulate.read_stream(spark, src), search, str(tmp_path / "runs"), str(tmp_path / "c2")).awaitTermination()
    assert tables.missing_runs(spark, str(tmp_path / "runs"), ["r0", "r1", "r2"]) == ["r1"]
    assert {r["run"] for r in spark.read.json(f"{tmp_path}/runs_failed").collect()} == {"r1"}


def test_small_search(spark):
    rng = np.random.default_rng(5)
    n, cycles = 60, 60
    prec = frame(spark, precursor_idx=np.arange(n), decoy=np.arange(n) % 2, proteins=[f"P{i // 4}" for i in range(n)], sequence=[f"S{i}" for i in range(n)])
    frag = [(i, f"f{k}", 200.0 + i * 10 + k, 1.0 + k) for i in range(n) for k in range(5)]
    peaks = []
    for i, _, mz, w in frag:
        for c in range(cycles):
            shape = np.exp(-((c - 30) ** 2) / 18) * w * 1000 if i % 2 == 0 else 0
            peaks.append((c, mz * (1 + rng.normal(0, 2e-6)), float(shape + rng.uniform(1, 60))))
    f = spark.createDataFrame(frag, "precursor_idx long, fragment string, mz_library double, intensity_library double")
    p = spark.createDataFrame(pd.DataFrame(peaks, columns=["cycle", "mz", "intensity"]))
    settings = Settings(fdr=0.2, compete=False)
    psm, ions = zip(*(search_run(r, prec, f, p, settings) for r in ("r1", "r2")))
    out = combine(psm[0].unionByName(psm[1]), ions[0].unionByName(ions[1]), settings)
    found = out["precursors"].toPandas()
    assert len(found) >= 40 and (found.decoy == 0).all() and ((found.cycle_center - 30).abs() <= 1).mean() > 0.9
    assert set(out["pg_matrix"].columns) == {"pg", "r1", "r2"}
    assert ions[0].where("correlation > 0.9").count() > 100


def test_search_competition_and_precursor_traces(spark):
    """Precursors of one window and time that share fragments compete; those of another window do not."""
    rng = np.random.default_rng(19)
    n, cycles = 48, 40
    prec = frame(spark, precursor_idx=np.arange(n), decoy=np.arange(n) % 2, mz=[400.2 + 100 * (i % 3 == 2) + i / 1000 for i in range(n)], charge=[2] * n, proteins=[f"P{i}" for i in range(n)], sequence=[f"S{i}" for i in range(n)])
    base = lambda i: 0 if i in (0, 2, 4) else i  # noqa: E731  0, 2 and 4 have the same fragments; 2 lies in another window
    frag = [(i, f"y{k + 1}", 200.0 + base(i) * 10 + k, 1.0 + k) for i in range(n) for k in range(5)]
    peaks = []
    for i, _, mz, w in frag:
        if base(i) == i:
            for c in range(cycles):
                shape = np.exp(-((c - 20) ** 2) / 10) * w * 1000 if i % 2 == 0 else 0
                peaks.append((c, mz, float(shape + rng.uniform(1, 60))))
    f = spark.createDataFrame(frag, "precursor_idx long, fragment string, mz_library double, intensity_library double")
    p = spark.createDataFrame(pd.DataFrame(peaks, columns=["cycle", "mz", "intensity"]))
    ms1 = frame(spark, cycle=list(range(cycles)), mz=[400.2 + 6 / 1000] * cycles, intensity=[1000.0 * float(np.exp(-((c - 21) ** 2) / 10)) for c in range(cycles)])
    settings = Settings(fdr=1.0, windows=((400.0, 450.0), (450.0, 550.0)))
    psm = search_run("r", prec, f, p, settings, ms1=ms1)[0].toPandas()
    kept = set(psm.precursor_idx)
    assert len(kept & {0, 4}) == 1 and 2 in kept and {6, 8, 10} <= kept
    scored = search_run("r", prec, f, p, replace(settings, compete=False, ms1_scores=True), ms1=ms1)[0].toPandas().set_index("precursor_idx")
    assert len(scored) == n and scored.loc[6, "sum_ms1_intensity"] > 0 and scored.loc[40, "sum_ms1_intensity"] == 0
    traces = candidates.extract_traces(p, f, ppm=15)
    isotopes = candidates.isotope_traces(ms1, prec, ppm=15, n=3)
    plain, more = ({r["precursor_idx"]: r["score"] for r in candidates.select(traces, settings.selection, x).where("rank = 0").collect()} for x in (None, isotopes))
    assert more[6] > plain[6] and more[40] == plain[40]
    cut = candidates.select(traces, candidates.Selection(score_cutoff=plain[6])).collect()
    assert cut and min(r["score"] for r in cut) > plain[6]


def plain_envelope(x):
    """Both sides outwards: a point is at most the mean of the two before it."""
    x, n = list(x), len(x)
    if n < 3:
        return x
    for sign, centre in ((-1, n // 2 - (n % 2 == 0)), (1, n // 2)):
        limit = (x[centre] + x[centre + sign]) / 2 if n % 2 else x[centre]
        at = centre + sign
        while 0 <= at < n:
            x[at] = min(x[at], limit)
            limit, at = (x[at] + x[at - sign]) / 2, at + sign
    return x


def test_centre_envelope(spark):
    rng = np.random.default_rng(21)
    rows = [[], [3.0], [2.0, 5.0]] + [list(map(float, rng.integers(0, 9, n))) for n in range(3, 12) for _ in range(5)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<double>")
    got = [r["y"] for r in df.select("i", signal.centre_envelope(F.col("x")).alias("y")).orderBy("i").collect()]
    assert all(np.allclose(g, plain_envelope(r)) for g, r in zip(got, rows))


def test_peaks_of_a_grid(spark):
    rng = np.random.default_rng(22)
    top = rng.random((12, 14))
    cells = [(k, i, j, float(top[i, j])) for k in (0, 1) for i in range(12) for j in range(14) if not (k == 1 and (i, j) == (9, 7))]
    for i, j in ((2, 2), (2, 11), (9, 6)):  # planted cones
        cells = [(k, a, b, v + max(0, 40 - 10 * (abs(a - i) + abs(b - j)))) for k, a, b, v in cells]
    value = {(k, i, j): v for k, i, j, v in cells}
    rise = lambda k, places: all(p in value for p in ((k, *q) for q in places)) and all(value[k, *p] < value[k, *q] for p, q in zip(places, places[1:]))
    want = {
        (k, i, j) for k, i, j, _ in cells
        if all(rise(k, [(i + 2 * a, j + 2 * b), (i + a, j + b), (i, j)]) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    }
    df = spark.createDataFrame(cells, "k int, i int, j int, v double")
    assert {(r.k, r.i, r.j) for r in signal.local_peaks_2d(df, ["k"], "i", "j", "v").collect()} == want and len(want) > 2
    best = signal.local_peaks_2d(df, ["k"], "i", "j", "v", top=1).collect()
    assert {(r.k, r.v) for r in best} == {(k, max(value[w] for w in want if w[0] == k)) for k in {w[0] for w in want}}


def test_modifications(spark):
    df = frame(spark, peptide=["MCM", "", "AK"])
    got = library.modify(df, fixed={"Carb@C": 57.0}, variable={"Ox@M": 16.0, "Acetyl@Any_N-term": 42.0, "Odd@C": 1.0}, most=2)
    rows = {(r.peptide, r.mods, r.mod_sites, r.mod_mass) for r in got.collect()}
    carb = ["", "0", "1", "3", "0;1", "0;3", "1;3"]
    name = lambda sites: [{"0": "Acetyl@Any_N-term", "1": "Ox@M", "3": "Ox@M"}[s] for s in sites.split(";") if s]
    mass = {"Acetyl@Any_N-term": 42.0, "Ox@M": 16.0}
    want = {("MCM", ";".join(["Carb@C", *name(s)]), ";".join(filter(None, ["2", s])), 57.0 + sum(mass[n] for n in name(s))) for s in carb}
    assert rows == want | {("AK", "", "", 0.0), ("AK", "Acetyl@Any_N-term", "0", 42.0)} and got.count() == len(rows)


def test_saved_state_and_models(spark, tmp_path):
    path = f"{tmp_path}/state"
    with pytest.warns(UserWarning, match="no state"):
        assert saved.load_state(spark, path, 1) is None
    saved.save_state(spark, path, {"ppm": 7.5, "names": ["a"]}, 1)
    assert saved.load_state(spark, path, 1) == {"ppm": 7.5, "names": ["a"]}
    with pytest.warns(UserWarning, match="another version"):
        assert saved.load_state(spark, path, 2) is None
    df = frame(spark, a=[0.0, 1.0, 2.0], b=[1.0, 0.0, 5.0])
    fit = lambda *cols: Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="x")]).fit(df)
    assert saved.load_model(spark, str(tmp_path), ["a", "b"]) is None
    assert [saved.save_model(spark, str(tmp_path), c, fit(*c)) for c in (["a", "b"], ["b", "a"], ["a"])] == [0, 1, 0]
    assert saved.load_model(spark, str(tmp_path), ["b", "a"]).transform(df).first()["x"].toArray().tolist() == [1.0, 0.0]
    assert saved.load_model(spark, str(tmp_path), ["a", "b"], 0).transform(df).first()["x"].toArray().tolist() == [0.0, 1.0]
    assert saved.load_model(spark, str(tmp_path), ["a", "b"], 5) is None


def test_requantification(spark):
    """Channels are read at the place of their group's best row; every fragment of a found target is summed."""
    rng = np.random.default_rng(23)
    groups, cycles = 40, 21
    lib = [(3 * g + c, g, c, 0, f"AK{'G' * (g % 3)}R") for g in range(groups) for c in (0, 1, 2) if not (g == 39 and c == 0)]
    library_df = spark.createDataFrame(lib, "precursor_idx long, elution_group_idx long, channel long, decoy int, sequence string")
    frag = [(i, f"y{k + 1}", 200.0 + g * 30 + k + (0.0 if k == 0 else 5.0 * c), 1.0 + k) for i, g, c, *_ in lib for k in range(4)]
    peaks = []
    for i, _, mz, w in frag:
        for t in range(cycles):
            peaks.append((t, mz, float((np.exp(-((t - 10) ** 2) / 8) * w * 1000 if i % 3 < 2 else 0) + rng.uniform(1, 60))))
    f = spark.createDataFrame(frag, "precursor_idx long, fragment string, mz_library double, intensity_library double")
    p = spark.createDataFrame(peaks, "cycle long, mz double, intensity double")
    found = spark.createDataFrame([(g, q, 3 * g + 1, 0, a, a + 5, a + 10) for g in range(groups) for q, a in ((0.1, 5), (0.5, 0))],
                                  "elution_group_idx long, proba double, precursor_idx long, decoy int, cycle_start long, cycle_center long, cycle_stop long")
    got = requantify_channels(found, library_df, f, p, reference=0, targets=[0, 1], decoy_channel=2, ppm=15).toPandas()
    assert set(got.elution_group_idx) == set(range(39)) and (got.cycle_start == 5).all() and (got.n_fragments == 3).all()
    real = got[got.decoy == 0]
    assert set(real.channel) == {0, 1} and (real.qval <= 0.05).mean() > 0.9
    one = frame(spark, precursor_idx=[1, 2], decoy=[0, 1], cycle_start=[2, 2], cycle_stop=[4, 4])
    seqs = frame(spark, precursor_idx=[1, 2, 3], sequence=["AKR", "GGK", "AAK"])
    ions = library.all_fragments(seqs).where("precursor_idx = 1").collect()
    assert len(ions) == 8 and {r.intensity_library for r in ions} == {1.0}
    at = spark.createDataFrame([(t, r.mz_library, 10.0 * (t + 1)) for r in ions for t in range(6)], "cycle long, mz double, intensity double")
    table = requantify_all_fragments(one, seqs, at, ppm=5).toPandas()
    assert set(table.precursor_idx) == {1} and len(table) == 8 and (table.intensity == 30.0 + 40.0 + 50.0).all() and np.allclose(table.correlation, 1.0)


def test_overlap_by():
    names, seen = np.array(["b1", "b2", "b5", "y4", "y6"]), np.array([True] * 5)
    assert candidates.overlap_by(names, seen, 8) == 3.0 and candidates.overlap_by(names, seen & (names != "y6"), 8) == 1.0
    assert candidates.overlap_by(names[:3], seen[:3]) == 0.0


def test_scratch_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Session())
    Context.master = "local[4]"
    assert shared_dir(Session()).startswith("/tmp/")


def test_config_layers():
    assert merge_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, {"d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}


def test_peaks_and_smoothing():
    k = candidates.gaussian(3, 1, 11)
    x = np.zeros((1, 50))
    x[0, 20] = 1
    assert np.allclose(candidates.smooth(x, k)[0, 15:26], k) and candidates.peaks_of(candidates.smooth(x, k)[0], 3) == [20]
    assert candidates.apart([5, 7, 20], np.arange(30.0), 3) == [20, 7]
