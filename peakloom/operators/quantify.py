"""Quantities across runs: accumulation, filters, label-free quantification, merge back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.sources.shared import Scratch

from .ranking import rank_or_quality


def accumulate(fragments: DataFrame, keys: list[str], run: str, value: str, runs: list[str] | None = None) -> DataFrame:
    """Wide matrix of summed values, a column per run, missing ones 0."""
    pivot = fragments.groupBy(*keys).pivot(run, runs) if runs else fragments.groupBy(*keys).pivot(run)
    wide = pivot.agg(F.sum(value))
    return wide.fillna(0.0, [c for c in wide.columns if c not in keys])


def melt(matrix: DataFrame, keys: list[str], run: str = "run", value: str = "intensity") -> DataFrame:
    """Long form of a matrix: a row per key and run."""
    return matrix.unpivot(keys, [c for c in matrix.columns if c not in keys], run, value)


def filter_ions(frag: DataFrame, group: str, ion: str, quality: str, *, top_n: int, min_quality: float) -> DataFrame:
    """Rows of the ions whose mean quality ranks among the first of their group or exceeds the limit."""
    means = frag.groupBy(group, ion).agg(F.avg(quality).alias("_mean"))
    kept = rank_or_quality(means, [group], [F.desc("_mean"), ion], top_n, F.col("_mean") > min_quality)
    return frag.join(kept.select(group, ion), [group, ion], "left_semi")


def merge_levels(psm: DataFrame, matrices: dict[str, tuple[str, DataFrame]], run: str = "run") -> DataFrame:
    """Add {level}_intensity from each level's matrix (key column, matrix) by key and run."""
    for level, (key, matrix) in matrices.items():
        long = melt(matrix.select(key, *(c for c in matrix.columns if c != key)), [key], run, f"{level}_intensity")
        psm = psm.join(long, [key, run], "left")
    return psm


def align_runs(long: DataFrame, ion: str, run: str, value: str) -> DataFrame:
    """Shift log2 values of each run to the median of its differences from the ions' means.

    Ions seen in at least two runs take part; means come from all of them.
    """
    logs = long.where(F.col(value) > 0).withColumn("_log", F.log2(value))
    means = logs.groupBy(ion).agg(F.avg("_log").alias("_mean"), F.count("*").alias("_n")).where("_n > 1").select(ion, "_mean")
    shift = logs.join(means, ion).groupBy(run).agg(F.median(F.col("_log") - F.col("_mean")).alias("_shift"))
    return logs.join(shift, run, "left").withColumn("_log", F.col("_log") - F.coalesce("_shift", F.lit(0.0))).drop("_shift")


def run_profiles(logs: DataFrame, group: str, ion: str, run: str, *, rounds: int = 4) -> DataFrame:
    """Median polish of log values in each group: (group, ion, run, _log, _profile).

    Ions shift to the profile by their median difference from it, and a run's profile is the
    median of the shifted ions, in turns. A window holds the runs of an ion, or the ions of one
    run of a group, so a large group is spread over its ions and its runs.
    """
    ions, runs = Window.partitionBy(group, ion), Window.partitionBy(group, run)
    rows = logs.withColumn("_profile", F.lit(0.0))
    for _ in range(rounds):
        rows = rows.withColumn("_shift", F.median(F.col("_log") - F.col("_profile")).over(ions))
        rows = rows.withColumn("_profile", F.median(F.col("_log") - F.col("_shift")).over(runs))
    return rows.drop("_shift")


def label_free(long: DataFrame, group: str, ion: str, run: str, value: str, *, least: int = 1, rounds: int = 4) -> DataFrame:
    """Intensity per group and run from the ratios of its ions: (group, run, intensity).

    Profiles are scaled so that a group keeps the total of its aligned ions. Groups of fewer
    than ``least`` ions are left out; repeated rows of an ion and run count as the largest.
    """
    aligned = align_runs(long, ion, run, value).groupBy(group, ion, run).agg(F.max("_log").alias("_log"))
    profiles = run_profiles(aligned, group, ion, run, rounds=rounds)
    by_run = profiles.groupBy(group, run).agg(F.first("_profile").alias("_profile"), F.sum(F.pow(F.lit(2.0), F.col("_log"))).alias("_sum"))
    whole = Window.partitionBy(group)  # a row per run
    scaled = by_run.withColumn("intensity", F.pow(F.lit(2.0), F.col("_profile")) * F.sum("_sum").over(whole) / F.sum(F.pow(F.lit(2.0), F.col("_profile"))).over(whole))
    if least > 1:
        scaled = scaled.join(aligned.groupBy(group).agg(F.countDistinct(ion).alias("_n")).where(F.col("_n") >= least), group, "left_semi")
    return scaled.select(group, run, "intensity")


# --- nearest traces first -------------------------------------------------------------------


def _distances(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and variance of the differences of one trace from each row of ``y``; no shared run is infinitely far.

    A single shared run says nothing about the spread, so such pairs come after all others.
    """
    d = x - y
    seen = np.isfinite(d)
    shared = seen.sum(1)
    n = np.maximum(shared, 1)
    rows, ordered = np.arange(len(d)), np.sort(np.where(seen, d, np.inf), 1)  # what is missing comes last
    shift = np.where(shared == 0, np.nan, (ordered[rows, (n - 1) // 2] + ordered[rows, n // 2]) / 2)
    mean = np.where(seen, d, 0).sum(1) / n
    spread = (np.where(seen, d - mean[:, None], 0) ** 2).sum(1) / n
    spread = np.where(shared == 1, 1e12, spread / np.maximum(shared - 1, 1))
    return shift, np.where(shared == 0, np.inf, spread)


def merge_traces(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge traces (rows of logarithms, NaN where missing) nearest first: the profile and each run's weight.

    The two traces whose differences vary least are joined: one is shifted by the median
    difference and both are averaged by weight, so each later distance is measured on all that
    was joined before. A run's profile is then the median of the shifted traces, or their mean by
    weight where traces stand for several. Traces without a shared run are never shifted upon
    each other: of the parts left, the heaviest leads, and others fill runs that it lacks.
    """
    own, counts = x, weight
    x, weight = x.copy(), weight.astype(float).copy()
    n = len(x)
    moved_by, part = np.zeros(n), np.arange(n)
    shift, spread = np.zeros((n, n)), np.full((n, n), np.inf)
    for i in range(n - 1):
        shift[i, i + 1 :], spread[i, i + 1 :] = _distances(x[i], x[i + 1 :])
    alive = np.ones(n, bool)
    for _ in range(n - 1):
        i, j = np.unravel_index(np.argmin(spread), spread.shape)
        if not np.isfinite(spread[i, j]):
            break
        moved = x[j] + shift[i, j]
        moved_by[part == j] += shift[i, j]
        part[part == j] = i
        both = np.stack([x[i], moved])
        w = np.stack([weight[i], weight[j]]) * np.isfinite(both)
        total = w.sum(0)
        x[i] = np.where(total > 0, np.nansum(both * w, 0) / np.maximum(total, 1e-300), np.nan)
        weight[i] = total
        alive[j] = False
        spread[j], spread[:, j] = np.inf, np.inf
        others = np.flatnonzero(alive & (np.arange(n) != i))
        if len(others):
            s, v = _distances(x[i], x[others])
            after = others > i
            shift[i, others[after]], spread[i, others[after]] = s[after], v[after]
            shift[others[~after], i], spread[others[~after], i] = -s[~after], v[~after]
    for i in np.flatnonzero(alive):
        members = own[part == i] + moved_by[part == i, None]
        seen = np.isfinite(members).any(0)
        if counts.max(initial=0) <= 1:
            x[i, seen] = np.nanmedian(members[:, seen], 0)
        else:
            w = counts[part == i] * np.isfinite(members)
            x[i, seen] = np.nansum(members * w, 0)[seen] / w.sum(0)[seen]
    left = np.flatnonzero(alive)
    order = left[np.argsort(-weight[left].sum(1), kind="stable")]
    profile, held = x[order[0]].copy(), weight[order[0]].copy()
    for k in order[1:]:
        gap = np.isnan(profile) & np.isfinite(x[k])
        profile[gap], held[gap] = x[k][gap], weight[k][gap]
    return profile, held


def run_shifts(logs: DataFrame, ion: str, run: str, *, core: int = 50) -> dict[object, float]:
    """Shift of each run's logarithms, by merging runs nearest first.

    One aggregation gives number, sum, squares and median of the differences of every pair of
    the ``core`` fullest runs (``core`` squared rows at most come back); the two clusters of runs
    that differ with the least variance are joined by the medians, which the ions that change
    move little, and the shifts of a cluster move along. The other runs are shifted to the
    joined profile of these, in one aggregation more.
    """
    counts = logs.groupBy(run).count().orderBy(F.desc("count"), run).collect()  # a row per run
    if not counts:
        return {}
    first = [r[run] for r in counts[:core]]
    inside = logs.where(F.col(run).isin(first)).groupBy(ion, run).agg(F.max("_log").alias("_log"))
    one, two = inside.withColumnsRenamed({run: "_r1", "_log": "_l1"}), inside.withColumnsRenamed({run: "_r2", "_log": "_l2"})
    d = F.col("_l1") - F.col("_l2")
    pairs = one.join(two, ion).where("_r1 < _r2").groupBy("_r1", "_r2").agg(F.count("*").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"), F.percentile_approx(d, 0.5, 10_000).alias("m")).collect()
    number = {r: i for i, r in enumerate(first)}
    n, s, q, middle = (np.zeros((len(first), len(first))) for _ in range(4))
    for r in pairs:
        i, j = number[r["_r1"]], number[r["_r2"]]
        n[i, j] = n[j, i] = r["n"]
        s[i, j], s[j, i] = r["s"], -r["s"]
        q[i, j] = q[j, i] = r["q"]
        middle[i, j], middle[j, i] = r["m"], -r["m"]
    shifts = np.zeros(len(first))
    of = np.arange(len(first))  # cluster of each run
    while True:
        best = None
        for a in np.unique(of):
            for b in np.unique(of):
                if a < b:
                    x, y = np.flatnonzero(of == a), np.flatnonzero(of == b)
                    m = n[np.ix_(x, y)]
                    if (total := m.sum()) < 2:
                        continue
                    moved = shifts[x][:, None] - shifts[y][None, :]
                    sums = (s[np.ix_(x, y)] + m * moved).sum()
                    squares = (q[np.ix_(x, y)] + 2 * moved * s[np.ix_(x, y)] + m * moved**2).sum()
                    spread = max(squares / total - (sums / total) ** 2, 0.0) / total
                    if best is None or spread < best[0]:
                        best = (spread, a, b, (m * (middle[np.ix_(x, y)] + moved)).sum() / total)
        if best is None:
            break
        _, a, b, gap = best
        shifts[of == b] += gap
        of[of == b] = a
    out = {r: float(shifts[number[r]]) for r in first}
    if len(counts) > core:
        known = F.create_map(*(F.lit(v) for kv in out.items() for v in kv))
        profile = inside.groupBy(ion).agg(F.avg(F.col("_log") + F.element_at(known, F.col(run))).alias("_profile"))
        rest = logs.where(~F.col(run).isin(first)).join(profile, ion).groupBy(run).agg(F.median(F.col("_profile") - F.col("_log")).alias("s"))
        out |= {r[run]: float(r["s"]) for r in rest.collect()}
    return out


def nearest_lfq(long: DataFrame, group: str, ion: str, run: str, value: str, *, least: int = 1, core: int = 50, block: int = 256) -> DataFrame:
    """Intensity per group and run from the ratios of its ions, nearest traces first: (group, run, intensity).

    Runs are shifted upon each other by the ions they share, then the ions of a group by the
    runs they share. Groups are merged in parts of about ``block`` ions, and the profiles of
    the parts again, so no task holds more than ``block`` traces of a group; up to that size the
    result is that of one merge. A group keeps the total of its shifted ions. Rows without a
    positive value take no part, repeated rows of an ion and run count as the largest, and
    groups of fewer than ``least`` ions are left out.
    """
    scratch = Scratch(long.sparkSession, "lfq")
    logs = scratch.save(long.where(F.col(value) > 0).groupBy(group, ion, run).agg(F.log2(F.max(value)).alias("_log")))
    shifts = run_shifts(logs, ion, run, core=core)
    if not shifts:
        return logs.select(group, run, F.lit(0.0).alias("intensity"))
    moved = F.create_map(*(F.lit(v) for kv in shifts.items() for v in kv))
    sizes = logs.select(group, ion).distinct().groupBy(group).agg(F.count("*").alias("_n"))
    rows = logs.join(sizes.where(F.col("_n") >= least), group).withColumn("_log", F.col("_log") + F.coalesce(F.element_at(moved, F.col(run)), F.lit(0.0)))
    rows = scratch.save(rows.select(group, run, F.xxhash64(ion).alias("trace"), "_log", F.lit(1.0).alias("weight"), F.pow(F.lit(2.0), "_log").alias("total")))
    kinds = dict(rows.dtypes)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        traces, i = np.unique(pdf["trace"], return_inverse=True)
        runs, j = np.unique(pdf[run], return_inverse=True)
        x, w = np.full((len(traces), len(runs)), np.nan), np.zeros((len(traces), len(runs)))
        x[i, j], w[i, j] = pdf["_log"], pdf["weight"]
        profile, held = merge_traces(x, w)
        total = pdf.groupby(run)["total"].sum().loc[runs].to_numpy()
        return pd.DataFrame({group: pdf[group].iloc[0], run: runs, "trace": traces[0], "_log": profile, "weight": held, "total": total})

    schema = f"`{group}` {kinds[group]}, `{run}` {kinds[run]}, trace long, _log double, weight double, total double"
    while True:
        parts = rows.select(group, "trace").distinct().groupBy(group).agg(F.ceil(F.count("*") / block).alias("parts"))
        most = parts.agg(F.max("parts")).first()[0] or 0
        dealt = rows.join(parts, group).withColumn("part", F.pmod(F.xxhash64("trace", F.lit(most)), F.col("parts")))
        rows = scratch.save(dealt.drop("parts").groupBy(group, "part").applyInPandas(lambda pdf: merge(pdf), schema))
        if most <= 1:
            break
    whole = Window.partitionBy(group)  # a row per run
    return rows.select(group, run, (F.pow(F.lit(2.0), "_log") * F.sum("total").over(whole) / F.sum(F.pow(F.lit(2.0), "_log")).over(whole)).alias("intensity"))
