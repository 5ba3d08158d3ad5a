"""Kernels against plain versions on made-up data."""

import itertools
import math
import time
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from peakloom.operators import calibrate, candidates, competition, fdr, grouping, joins, library, peak_index, quantify, ranking
from peakloom.plans import analogues

from .conftest import DATA


def test_isotopes_against_all_isotopologues(spark):
    """Every choice of isotopes of every element, with multinomial weights."""

    def plain(atoms, n):
        out = np.zeros(n)
        per_element = []
        for (_, shares), count in zip(library.ELEMENTS.items(), atoms):
            heights = np.zeros(n)
            for extra in itertools.product(*(range(n) for _ in shares[1:])):
                at = sum((i + 1) * k for i, k in enumerate(extra))
                if at < n and sum(extra) <= count:
                    ways = math.factorial(count) // math.factorial(count - sum(extra))
                    for k in extra:
                        ways //= math.factorial(k)
                    heights[at] += ways * shares[0] ** (count - sum(extra)) * math.prod(s**k for s, k in zip(shares[1:], extra))
            per_element.append(heights)
        for places in itertools.product(range(n), repeat=len(per_element)):
            if sum(places) < n:
                out[sum(places)] += math.prod(h[p] for h, p in zip(per_element, places))
        return out / out.sum()

    rows = [("PEPTIDEK", ""), ("MCMWK", "Oxidation@M;Carbamidomethyl@C"), ("G", "Deamidated@N"), ("ACDEFGHIKLMNPQRSTVWY", "Phospho@S"), ("", None)]
    df = spark.createDataFrame(rows, "s string, m string")
    got = df.select("s", "m", library.composition(F.col("s"), F.col("m")).alias("c"), library.isotope_pattern(F.col("s"), 4, F.col("m")).alias("p")).collect()
    for r in got:
        assert np.allclose(r["p"], plain([int(x) for x in r["c"]], 4), atol=1e-9)
    assert dict(zip(library.ELEMENTS, got[0]["c"])) == {"C": 40, "H": 65, "N": 9, "O": 16, "S": 0, "P": 0}


def test_annotation_is_a_substring_search(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: "".join(rng.choice(list("AK"), n))  # noqa: E731  two letters: every run is frequent
    proteins = [(f"P{i}", draw(int(rng.integers(0, 60)))) for i in range(150)] + [("P0", "AAAA"), ("Q", None), (None, "AKA")]
    peptides = [(draw(int(rng.integers(1, 14))),) for _ in range(200)] + [("",), (None,), ("W" * 9,)]
    got = {r["peptide"]: r["proteins"] for r in library.annotate(spark.createDataFrame(peptides, "peptide string"), spark.createDataFrame(proteins, "protein string, sequence string"), k=5, heavy=20).collect()}
    want = {}
    for (p,) in peptides:
        names = sorted({n for n, s in proteins if p and s and n and p in s})
        if names:
            want[p] = ";".join(names)
    assert {k: v for k, v in got.items() if v} == want and len(want) > 100
    assert library.annotate(spark.createDataFrame([], "peptide string"), spark.createDataFrame(proteins, "protein string, sequence string")).count() == 0


def polish(x, rounds):
    fit = np.zeros(x.shape[1])
    for _ in range(rounds):
        fit = np.nanmedian(x - np.nanmedian(x - fit, 1, keepdims=True), 0)
    return fit


def test_traces_nearest_first():
    """Ratios come back with 40 % missing, and where ions link few runs each, which a median polish misses."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        profile, x = rng.normal(0, 2, 8), rng.normal(20, 3, (12, 1)) + rng.normal(0, 0.02, (12, 8))
        x = x + profile
        x[rng.random(x.shape) < 0.4] = np.nan
        got, _ = quantify.merge_traces(x, np.isfinite(x).astype(float))
        assert np.nanstd(got - profile) < 0.1
        chain = np.full((28, 8), np.nan)
        for i in range(28):
            runs = [i % 7, i % 7 + 1]
            chain[i, runs] = rng.normal(20, 3) + profile[runs] + rng.normal(0, 0.02, 2)
        got, _ = quantify.merge_traces(chain, np.isfinite(chain).astype(float))
        assert 4 * np.nanstd(got - profile) < np.nanstd(polish(chain, 4) - profile)
    apart = np.array([[1.0, 2.0, np.nan, np.nan], [np.nan, np.nan, 5.0, 6.0]])
    assert quantify.merge_traces(apart, np.isfinite(apart).astype(float))[0].tolist() == [1, 2, 5, 6]


def test_nearest_lfq(spark):
    rng = np.random.default_rng(9)
    rows, truth = [], {}
    offsets = rng.normal(0, 1, 9)
    for g in range(12):
        profile = rng.normal(0, 1, 9) if g < 4 else np.zeros(9)  # most groups do not change, so runs can be aligned
        x = rng.normal(20, 3, (10 if g else 40, 1)) + profile + rng.normal(0, 0.01, (10 if g else 40, 9))
        x[rng.random(x.shape) < 0.3] = np.nan
        truth[f"g{g}"] = profile
        rows += [(f"g{g}", f"g{g}i{i}", f"r{r}", float(2 ** (x[i, r] + offsets[r]))) for i in range(len(x)) for r in range(9) if np.isfinite(x[i, r])]
    df = spark.createDataFrame(rows, "g string, ion string, run string, v double")
    for settings in ({}, {"block": 8}, {"core": 5}):  # the first group in several parts; runs beyond the core
        got = quantify.nearest_lfq(df, "g", "ion", "run", "v", **settings).toPandas()
        for g, profile in truth.items():
            own = np.log2(got[got.g == g].set_index("run").intensity.reindex([f"r{i}" for i in range(9)]).to_numpy())
            if g != "g0":
                assert np.nanmax(np.abs((own - np.nanmean(own)) - (profile - profile.mean()))) < 0.35, (settings, g)
    assert quantify.nearest_lfq(df.limit(0), "g", "ion", "run", "v").count() == 0


def test_kernels_at_ranks_follow_skewed_data(spark):
    rng = np.random.default_rng(6)
    x = rng.exponential(1.0, 6000) ** 2
    y = np.sin(6 * np.sqrt(x)) + rng.normal(0, 0.02, len(x))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    errors = []
    for density in (False, True):
        model = calibrate.fit_local(df, "x", "y", kernels=12, density=density)
        dense = df.where(F.col("x") < 2).select(F.abs(model.predict(F.col("x")) - F.sin(6 * F.sqrt("x"))).alias("e"))
        errors.append(dense.agg(F.avg("e")).first()[0])
        widths = np.asarray(model.widths)
    assert errors[1] < 0.6 * errors[0] and widths.max() > 3 * widths.min()


def test_transfer_curves_of_several_windows(spark):
    rng = np.random.default_rng(11)
    step = lambda z: 1 / (1 + np.exp(-z))
    truth = {k: (rng.uniform(-12, -8), rng.uniform(8, 12), rng.uniform(0.3, 1), rng.uniform(0.3, 1)) for k in range(4)}
    parts = []
    for k, (a, b, s, t) in truth.items():
        x = rng.uniform(-25, 25, 800)
        parts.append(pd.DataFrame({"k": k, "x": x, "y": step((x - a) / s) - step((x - b) / t) + rng.normal(0, 0.01, len(x))}))
    df = spark.createDataFrame(pd.concat(parts))
    got = calibrate.fit_rectangles(df, "k", "x", "y", {k: (-9.0, 9.0, 0.8, 0.8) for k in range(5)})
    for k, p in truth.items():
        assert np.allclose(got[k], p, atol=0.1)
        low, high = calibrate.transfer_limits(got[k])
        edge = lambda v, p=p: step((v - p[0]) / p[2]) - step((v - p[1]) / p[3])
        assert abs(edge(low) - 0.01) < 0.004 and abs(edge(high) - 0.01) < 0.004
    assert got[4].tolist() == [-9.0, 9.0, 0.8, 0.8]  # no rows


def test_limits_of_a_peak():
    """Against a walk outwards, step by step."""
    rng = np.random.default_rng(13)
    seen = set()
    for _ in range(500):
        n = int(rng.integers(5, 60))
        centre, most, least = int(rng.integers(0, n)), int(rng.integers(2, 20)), int(rng.integers(1, 4))
        score = np.exp(-((np.arange(n) - centre) ** 2) / rng.uniform(1, 60)) * 100 + rng.uniform(0, 3, n)
        width, held = least, score[centre]
        for s in range(least + 1, most):
            ends = (score[max(centre - s, 0)] + score[min(centre + s, n - 1)]) / 2
            if not (ends < 0.95 * held and ends > 0.01 * score[centre]):
                break
            width, held = s, ends
        assert candidates.limits(score, centre, most, least=least) == (max(centre - width, 0), min(centre + width, n - 1))
        seen.add(width)
    assert len(seen) > 8


def test_cover_where_ids_share_sets_all_over(spark):
    """A few ids that almost all sets list: rounds by overlaps give the masters of the visit in order."""
    rng = np.random.default_rng(14)
    sets = [(int(part), k, sorted({f"p{int(x)}" for x in rng.zipf(1.3, int(rng.integers(1, 7))) % 40}, key=lambda i: hash((i, k)) % 97), int(rng.integers(1, 4))) for part in (0, 1) for k in range(600)]
    df = spark.createDataFrame(sets, "part int, key long, list array<string>, n long")
    got = {(r["part"], r["key"]): r["master"] for r in grouping.cover(df, most=100).collect()}
    for part in (0, 1):
        want = grouping.greedy_cover([(k, ids, n) for p, k, ids, n in sets if p == part])
        assert {k: got[part, k] for k in want} == want and len(want) == 600


def test_cover_takes_many_ids_a_round(spark, monkeypatch):
    """Ids of nearly equal weight that sets share all over: few rounds, and the masters of the visit in order."""
    rng = np.random.default_rng(3)
    sets = [(part, k, [f"p{int(x)}" for x in rng.choice(60, int(rng.integers(1, 6)), replace=False)], int(rng.integers(1, 3))) for part in (0, 1) for k in range(2500 + 500 * part)]
    df = spark.createDataFrame(sets, "part int, key long, list array<string>, n long")
    rounds, save = [], grouping.Scratch.save
    monkeypatch.setattr(grouping.Scratch, "save", lambda self, d: rounds.append(d.columns) or save(self, d))
    got = {(r["part"], r["key"]): r["master"] for r in grouping.cover(df, most=4000).collect()}
    for part in (0, 1):
        want = grouping.greedy_cover([(k, ids, n) for p, k, ids, n in sets if p == part])
        assert {k: got[part, k] for k in want} == want
    assert len(got) == len(sets) and sum("place" in c and "lost" not in c for c in rounds) > 0
    assert len(rounds) < 60


def test_greedy_cover_of_many_ids_takes_little_time():
    began = time.time()
    sets = [(k, [2 * k, 2 * k + 1, 2 * k + 2], 1 + k % 3) for k in range(20_000)]
    assert len(grouping.greedy_cover(sets)) == 20_000 and time.time() - began < 10


def test_annotate_shuffles_no_runs(spark):
    """Peptides at every place of texts of several pieces, without an index of all runs."""
    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 19) for i in range(900))
    peptides = sorted({text[i : i + n] for i in range(0, 1780, 7) for n in (3, 6, 20)} | {"absent", text[400:1200]})
    proteins = [("a", text), ("b", text[450:560]), ("c", None)]
    out = library.annotate(spark.createDataFrame([(p,) for p in peptides], "peptide string"), spark.createDataFrame(proteins, "protein string, sequence string"))
    assert {r["peptide"]: r["proteins"] for r in out.collect()} == {p: ";".join(n for n, t in proteins if t and p in t) for p in peptides if p in text}
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_trace_distances_take_little_time():
    rng = np.random.default_rng(3)
    x = np.where(rng.random((256, 7)) < 0.2, np.nan, rng.normal(size=(256, 7)))
    x[5] = np.nan
    shift, spread = quantify._distances(x[0], x[1:])
    d = x[0] - x[1:]
    n = np.isfinite(d).sum(1)
    known = n > 1
    assert np.array_equal(shift[known], np.nanmedian(d[known], 1)) and np.allclose(spread[known], np.nanvar(d[known], 1) / (n[known] - 1), rtol=1e-12)
    assert np.isinf(spread[n == 0]).all() and np.isnan(shift[n == 0]).all() and (spread[n == 1] == 1e12).all()
    began = time.process_time()
    quantify.merge_traces(x, np.isfinite(x).astype(float))
    assert time.process_time() - began < 0.15


def test_forms_of_many_sites(spark):
    """Forms grow from shorter ones and are never compared with each other."""
    df = spark.createDataFrame([("S" * 600,)], "peptide string")
    began = time.time()
    out = library.modify(df, fixed={}, variable={"Phospho@S": 80.0}).agg({"mod_mass": "sum", "mods": "count"}).first()
    assert sorted(out) == sorted([1 + 600 + 600 * 599 // 2, 600 * 80.0 + 600 * 599 // 2 * 160.0])
    assert time.time() - began < 20


def test_interval_cells_are_dealt_over_parts(spark):
    rng = np.random.default_rng(8)
    spans = lambda n: [(i, float(x), float(x + w)) for i, (x, w) in enumerate(zip(rng.uniform(-3, 3, n), rng.uniform(0, 3, n)))]
    one, two = spans(60) + [(60, None, 1.0)], spans(40)
    left, right = spark.createDataFrame(one, "i long, a double, b double"), spark.createDataFrame(two, "j long, c double, d double")
    want = sorted((i, j) for i, a, b in one if a is not None for j, c, d in two if a <= d and c <= b)
    for heavy in (7, 1000, 10**9):
        got = joins.interval_overlap_join(left, right, ("a", "b"), ("c", "d"), 1.0, heavy=heavy)
        assert sorted((r["i"], r["j"]) for r in got.select("i", "j").collect()) == want


def test_index_has_buckets_for_its_peaks(spark, monkeypatch):
    monkeypatch.setattr(peak_index, "BUCKET", 100)
    peaks = spark.range(1000).selectExpr("id % 50 AS cycle", "100.0D + id AS mz", "1.0D AS intensity")
    index = peak_index.build_index(peaks)
    assert spark.sql(f"DESCRIBE FORMATTED {index.name}").where("col_name = 'Num Buckets'").first()["data_type"] == "10"
    wanted = spark.range(0, 1000, 3).selectExpr("id", "100.0D + id AS mz_library")
    assert index.near(wanted, "mz_library", ppm=20).count() == 334
    index.drop()


def test_candidate_groups_are_dealt(spark):
    """Many small groups stay spread over tasks, and correlations equal numpy's."""
    rng = np.random.default_rng(8)
    table = rng.normal(size=(6, 9))
    table[2] = 4.0
    want = [candidates.correlation(x, table.sum(0)) for x in table]
    assert np.allclose(candidates.correlations(table, table.sum(0)), want, atol=1e-12)
    assert not candidates.correlations(table, np.ones(9)).any() and not candidates.correlations(table[:, :1], table[:, 0][:1]).any()
    rows = [(p, f, c, float(np.exp(-((c - 16) ** 2) / 4) * (p + 1))) for p in range(40) for f in ("b1", "b2", "y1", "y2") for c in range(40)]
    traces = spark.createDataFrame(rows, "precursor_idx long, fragment string, cycle long, intensity double")
    found = candidates.select(traces)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert {(r["precursor_idx"], r["cycle_center"]) for r in found.where("rank = 0").collect()} == {(p, 16) for p in range(40)}


def test_competition_in_batches(spark, monkeypatch):
    """Batches, equal rows and ties give what the visit in order gives, without pairs of equal rows."""
    rng = np.random.default_rng(12)
    n = 150
    base = pd.DataFrame({"window_idx": rng.integers(0, 2, n), "rt": rng.integers(0, 12, n).astype(float), "proba": rng.integers(0, 60, n) / 60})
    mz = [np.sort(rng.choice(np.arange(400.0, 440.0), rng.integers(1, 5), replace=False)) for _ in range(n)]
    psm = pd.concat([base.assign(id=np.arange(n) + k * 1000) for k in range(4)])
    frag = [(int(i + k * 1000), float(m)) for k in range(4) for i in range(n) for m in mz[i]]
    pairs, plain = [], competition._overlaps

    def spy(*a, **settings):
        out = plain(*a, **settings)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(competition, "FIRST", 10, raising=False)
    monkeypatch.setattr(competition, "_overlaps", spy)
    of = {i: mz[i % 1000] for i in psm["id"]}
    for least in (1, 2):
        pairs.clear()
        got = {r["id"] for r in competition.compete(spark.createDataFrame(psm), spark.createDataFrame(frag, "id long, mz double"), least=least).collect()}
        kept, every = [], 0
        for r in psm.sort_values(["proba", "id"]).itertuples():
            if not any(k.window_idx == r.window_idx and abs(k.rt - r.rt) < 3 and competition.shared_fragments(of[k.id], of[r.id], 15.0) >= least for k in kept):
                kept.append(r)
            every += 1
        assert got == {k.id for k in kept}
        assert len(pairs) > 2 and sum(pairs) < every * 8

def test_precursor_scores_deal_by_rows(spark, monkeypatch):
    """Partitions follow the number of traces, and isotopes that were not seen count as zero."""
    monkeypatch.setattr(candidates, "TRACES", 20, raising=False)
    iso = [(p, i, 500.0 + i, c, float(1 + p + i), 500.0 + i) for p in range(40) for i in range(2) for c in range(4)]
    isotopes = spark.createDataFrame(iso, "precursor_idx long, isotope int, mz_library double, cycle long, intensity double, mz double")
    picked = spark.createDataFrame([(p, r, 2 * r, 2 * r + 1) for p in range(41) for r in range(3)], "precursor_idx long, rank int, cycle_start long, cycle_stop long")
    library_ = spark.createDataFrame([(p, i, 1.0 / (1 + i)) for p in range(41) for i in range(3)], "precursor_idx long, isotope int, intensity double")
    out = candidates.precursor_scores(isotopes, picked, library_)
    assert out.rdd.getNumPartitions() >= 16
    got = {(r["precursor_idx"], r["rank"]): (r["mono_ms1_intensity"], r["sum_ms1_intensity"]) for r in out.collect()}
    seen = {(p, r): (2.0 * (1 + p), 2.0 * (1 + p) + 2.0 * (2 + p)) for p in range(40) for r in range(2)}
    assert got == {(p, r): seen.get((p, r), (0.0, 0.0)) for p in range(41) for r in range(3)}


def test_protein_control_sorts_no_rows(spark, monkeypatch):
    """Evidence per group is aggregated by hash."""
    plans, save = [], ranking.Scratch.save
    monkeypatch.setattr(ranking.Scratch, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df))
    rows = [(f"g{i % 9}", i % 2, i, i % 7, i % 3, i / 90, "g", "p") for i in range(90)]
    psm = spark.createDataFrame(rows, "pg string, decoy int, precursor_idx long, sequence long, run int, proba double, genes string, proteins string")
    assert fdr.protein_control(psm, least=100).count() == 90
    assert plans and not any("SortAggregate" in p for p in plans)


def test_protein_fdr_covers_every_line(spark, tmp_path, monkeypatch):
    """Every line has the plain q-value of its group, and twice the parts are twice the groups."""
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    lines.unionByName(lines.withColumn("l_partkey", F.col("l_partkey") + 200)).write.parquet(f"{tmp_path}/lineitem.parquet")
    learned, q_values = [], fdr.q_values
    monkeypatch.setattr(fdr, "q_values", lambda df, *a, **k: learned.append(df) or q_values(df, *a, **k))
    sizes = []
    for folder in (DATA, str(tmp_path)):
        rows = analogues.QUERIES["protein_fdr"](spark, folder).collect()
        given = spark.read.parquet(f"{folder}/lineitem.parquet").collect()
        names = ["l_orderkey", "precursor_idx", "sequence", "run", "proba", "genes", "proteins"]
        want = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus"]
        assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(tuple(r[c] for c in want) for r in given)
        groups = learned.pop().orderBy("proba", "decoy", "pg").collect()
        assert {(r["pg"], r["decoy"]): r["n_rows"] for r in groups} == Counter((r["pg"], r["decoy"]) for r in rows)
        assert len({r["proba"] for r in groups}) > len(groups) / 2
        decoys, ratios = 0, []
        for i, r in enumerate(groups):
            decoys += r["decoy"]
            ratios.append(decoys / (i + 1 - decoys) if i + 1 > decoys else ranking.NO_TARGET)
        scale = (len(groups) - decoys) / decoys
        plain = {(r["pg"], r["decoy"]): scale * min(ratios[i:]) for i, r in enumerate(groups)}
        assert all(math.isclose(r["pg_qval"], plain[r["pg"], r["decoy"]], rel_tol=1e-9) for r in rows)
        sizes.append(len(groups))
    assert sizes == [120, 240]
