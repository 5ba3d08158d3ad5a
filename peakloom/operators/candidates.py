"""Candidate peak groups: dense traces per precursor, smoothing, peaks, boundaries, features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.scalars import damped_pearson, isotope_mz, weighted_mean

from .joins import band_join
from .peak_index import PeakIndex


#: Isotope peaks of a task of precursor_scores, about.
TRACES = 500_000


@dataclass(frozen=True)
class Selection:
    """Settings of candidate selection."""

    ppm: float = 15.0
    fwhm_cycles: float = 3.0
    sigma_scale: float = 0.5
    candidates: int = 3
    least_fragments: int = 4
    close: int = 3
    half_width: int = 10
    isotopes: int = 3
    score_cutoff: float = 0.0
    least_width: int = 3
    most_width: int = 15
    fall: float = 0.99
    share: float = 0.5


def extract_traces(peaks: DataFrame | PeakIndex, fragments: DataFrame, *, ppm: float) -> DataFrame:
    """Summed intensity and weighted m/z of the peaks near each library fragment, per cycle.

    ``peaks`` has cycle, mz and intensity, or is an index of such peaks; ``fragments`` has
    precursor_idx, fragment and mz_library, and optionally first_cycle and last_cycle, which
    limit the search.
    """
    if isinstance(peaks, PeakIndex):
        pairs = peaks.near(fragments, "mz_library", ppm=ppm)
    else:
        pairs = band_join(peaks, fragments, "mz", "mz_library", ppm=ppm)
    if "first_cycle" in fragments.columns and not isinstance(peaks, PeakIndex):
        pairs = pairs.where(F.col("cycle").between(F.col("first_cycle"), F.col("last_cycle")))
    return pairs.groupBy("precursor_idx", "fragment", "mz_library", "cycle").agg(
        F.sum("intensity").alias("intensity"), F.try_divide(F.sum(F.col("intensity") * F.col("mz")), F.sum("intensity")).alias("mz")
    )


def isotope_traces(peaks: DataFrame, precursors: DataFrame, *, ppm: float, n: int) -> DataFrame:
    """Summed intensity of the MS1 peaks near the first ``n`` isotopes of each precursor, per cycle.

    ``precursors`` has precursor_idx, mz and charge; the result has precursor_idx, isotope,
    mz_library, cycle, intensity and mz.
    """
    each = precursors.select("precursor_idx", F.posexplode(isotope_mz(F.col("mz"), F.col("charge"), n)).alias("isotope", "mz_library"))
    return extract_traces(peaks, each.withColumnRenamed("isotope", "fragment"), ppm=ppm).withColumnRenamed("fragment", "isotope")


def precursor_scores(isotopes: DataFrame, candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Scores of the isotope traces inside each candidate (precursor_idx, rank).

    ``isotopes`` is what isotope_traces gives; ``library`` has precursor_idx, isotope and its
    expected intensity. Intensities and heights are of the first, the strongest expected and all
    isotopes; errors in m/z are weighted by the expected intensities of the isotopes seen.
    """
    count = max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-isotopes.count() // TRACES))
    deal = lambda df: df.repartition(count, "precursor_idx")  # noqa: E731  the only shuffle of each table: all joins and sums are by precursor first
    c, t = deal(candidates.select("precursor_idx", "rank", "cycle_start", "cycle_stop")).alias("c"), deal(isotopes).alias("t")
    inside = c.join(t, F.expr("c.precursor_idx = t.precursor_idx AND t.cycle BETWEEN c.cycle_start AND c.cycle_stop"), "left")
    seen = inside.groupBy("c.precursor_idx", "rank", "isotope").agg(
        F.sum("intensity").alias("total"), F.max("intensity").alias("height"), weighted_mean("mz", "intensity").alias("mz"), F.min("mz_library").alias("mz_library")
    )
    values = ["total", "height", "mz", "mz_library"]
    each = seen.groupBy("precursor_idx", "rank").agg(F.collect_list(F.struct("isotope", *values)).alias("_seen"))  # a row per isotope
    wanted = each.join(deal(library.select("precursor_idx", "isotope", F.col("intensity").alias("expected"))), "precursor_idx")
    own = wanted.withColumn("_own", F.get(F.filter("_seen", lambda s: s["isotope"] == F.col("isotope")), F.lit(0)))
    rows = own.select("precursor_idx", "rank", "isotope", "expected", *(F.col("_own")[v].alias(v) for v in values)).fillna(0.0, ["total", "height"])
    strongest = F.struct("expected", -F.col("isotope"))
    error = F.sum((F.col("mz") - F.col("mz_library")) / F.col("mz_library") * 1e6 * F.col("expected"))
    first = lambda c: F.max(F.when(F.col("isotope") == 0, F.col(c)))
    return rows.groupBy("precursor_idx", "rank").agg(
        *(f.alias(n) for c, k in (("total", "intensity"), ("height", "height")) for n, f in (
            (f"mono_ms1_{k}", first(c)), (f"top_ms1_{k}", F.max_by(c, strongest)), (f"sum_ms1_{k}", F.sum(c)),
            (f"weighted_ms1_{k}", F.sum(F.col(c) * F.col("expected"))), (f"isotope_{k}_correlation", damped_pearson("expected", c)))),
        F.coalesce(error, F.lit(0.0)).alias("weighted_mass_deviation"), F.abs(F.coalesce(error, F.lit(0.0))).alias("weighted_mass_error"),
        (first("mz_library") * (1 + F.coalesce(error, F.lit(0.0)) * 1e-6)).alias("mz_observed"),
    )


def gaussian(fwhm: float, scale: float, size: int) -> np.ndarray:
    """Kernel of ``size`` points that sums to one."""
    sigma = max(fwhm / 2.3548 * scale, 1e-6)
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def smooth(rows: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Circular convolution of each row, centred on the kernel's middle."""
    n = rows.shape[1]
    padded = np.zeros(n)
    padded[: min(n, len(kernel))] = kernel[: min(n, len(kernel))]
    padded = np.roll(padded, -((min(n, len(kernel)) - 1) // 2))
    return np.fft.irfft(np.fft.rfft(rows, axis=1) * np.fft.rfft(padded), n, axis=1)


def peaks_of(score: np.ndarray, top: int) -> list[int]:
    """Places of the ``top`` highest strict maxima of five points."""
    if len(score) < 5:
        return []
    m = score[2:-2]
    found = 2 + np.flatnonzero((score[:-4] < score[1:-3]) & (score[1:-3] < m) & (m > score[3:-1]) & (score[3:-1] > score[4:]))
    return found[np.argsort(-score[found], kind="stable")][:top].tolist()


def apart(places: list[int], score: np.ndarray, close: int) -> list[int]:
    """Peaks in order of height without those within ``close`` of a higher one."""
    kept: list[int] = []
    for p in sorted(places, key=lambda p: -score[p]):
        if all(abs(p - q) > close for q in kept):
            kept.append(p)
    return kept


def limits(score: np.ndarray, centre: int, most: int, *, least: int = 1, fall: float = 0.95, share: float = 0.01) -> tuple[int, int]:
    """First and last place of a peak that reaches equally far on both sides.

    Beyond ``least``, it widens as long as the mean of both ends is below ``fall`` times that of
    the ends before, and above ``share`` of the centre; it stays below ``most`` places a side.
    """
    n, away = len(score), np.arange(least + 1, most)
    ends = (score[np.maximum(centre - away, 0)] + score[np.minimum(centre + away, n - 1)]) / 2
    before = np.append(score[centre], ends[:-1])[: len(ends)]
    goes_on = (ends < fall * before) & (ends > share * score[centre])
    width = least + int(np.cumprod(goes_on).sum())
    return max(centre - width, 0), min(centre + width, n - 1)


def dense(fragment: np.ndarray, cycle: np.ndarray, intensity: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Matrix of intensities (fragments x cycles), sorted fragments, and the first cycle."""
    first = int(cycle.min())
    names, row = np.unique(fragment, return_inverse=True)
    out = np.zeros((len(names), int(cycle.max()) - first + 1))
    np.add.at(out, (row, cycle - first), intensity)
    return out, names, first


def per_group(rows: DataFrame, keys: list[str], solve: Callable[[dict[str, np.ndarray], np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows (keys, ...) that ``solve`` returns for each group of ``rows``.

    A group is one row of lists, so that many groups share an Arrow batch: ``solve`` gets its
    columns as arrays, with fragments as numbers in their order, and the batch's fragments.
    Groups take time rather than bytes, so partitions are not merged by size.
    """
    spark = rows.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    values = [c for c in rows.columns if c not in keys]
    lists = rows.repartition(count, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*values)).alias("_rows"))
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("_rows")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            flat = dict(zip(values, batch.column("_rows").flatten().flatten()))
            columns = {c: a.to_numpy(zero_copy_only=False) for c, a in flat.items() if c != "fragment"}
            names, columns["fragment"] = np.unique(flat["fragment"].to_numpy(zero_copy_only=False), return_inverse=True)
            found = []
            for key, start, stop in zip(zip(*(batch.column(k).to_pylist() for k in keys)), (ends - lengths).tolist(), ends.tolist()):
                found += [(*key, *row) for row in solve({c: a[start:stop] for c, a in columns.items()}, names)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=fields), schema=kinds, preserve_index=False)

    kinds = pa.schema([(f, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f_kind.strip().split(" ")[1]]) for f, f_kind in zip(fields, schema.split(","))])
    return lists.mapInArrow(run, schema)


def select(traces: DataFrame, settings: Selection = Selection(), isotopes: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Candidates per precursor: (precursor_idx, rank, score, cycle_start, cycle_center, cycle_stop).

    The score sums the logarithms of smoothed fragment traces and, where ``isotopes`` are
    given, those of the precursor; only candidates above ``score_cutoff`` stay. A group is one
    precursor's traces, bounded by its fragments and cycles.
    """
    rows = traces.select("precursor_idx", F.col("fragment").cast("string").alias("fragment"), "cycle", "intensity", F.lit(False).alias("ms1"))
    if isotopes is not None:
        rows = rows.union(isotopes.select("precursor_idx", F.concat(F.lit("isotope "), "isotope"), "cycle", "intensity", F.lit(True)))

    def solve(group: dict[str, np.ndarray], names: np.ndarray) -> list[tuple]:
        if len(np.unique(group["fragment"][~group["ms1"]])) < settings.least_fragments:
            return []
        table, _, first = dense(group["fragment"], group["cycle"], group["intensity"])
        kernel = gaussian(settings.fwhm_cycles, settings.sigma_scale, 2 * settings.half_width + 1)
        score = np.log1p(np.maximum(smooth(table, kernel), 0)).sum(0)
        places = apart(peaks_of(score, 4 * settings.candidates), score, settings.close)[: settings.candidates]
        out = []
        for rank, p in enumerate(p for p in places if score[p] > settings.score_cutoff):
            lo, hi = limits(score, p, settings.most_width, least=settings.least_width, fall=settings.fall, share=settings.share)
            out.append((rank, float(score[p]), first + lo, first + p, first + hi))
        return out

    return per_group(rows, ["precursor_idx"], solve, "precursor_idx long, rank int, score double, cycle_start long, cycle_center long, cycle_stop long")


FEATURES = (
    "n_fragments", "log_intensity", "height", "area", "base_width", "fwhm", "mean_correlation", "top3_correlation", "median_correlation", "mass_error", "library_cosine", "peak_shift", "share_observed",
    "library_correlation", "top3_mass_error", "b_correlation", "y_correlation", "log_b", "log_y", "overlap_by", "n_over_half", "height_correlation", "signal_to_ends",
)


def overlap_by(names: np.ndarray, seen: np.ndarray, length: int | None = None) -> float:
    """Places of the backbone that observed b and y fragments (b3, y7, ...) both cover.

    A b fragment covers the residues before its number, a y fragment those after it; without a
    length the longest fragment of all counts as the peptide's.
    """
    b, y = ([int(n[1:]) for n, s in zip(names, seen) if s and n[:1] == t and n[1:].isdigit()] for t in "by")
    if not b or not y:
        return 0.0
    length = length or 1 + max(int(n[1:]) for n in names if n[:1] in "by" and n[1:].isdigit())
    return float(max(max(b) + max(y) - length, 0))


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Correlation, 0 where either side does not vary."""
    return float(np.corrcoef(x, y)[0, 1]) if len(x) > 1 and x.std() > 0 and y.std() > 0 else 0.0


def correlations(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of each row with ``y``, 0 where either side does not vary."""
    if rows.shape[1] < 2 or not y.std() > 0:
        return np.zeros(len(rows))
    x, z = rows - rows.mean(1, keepdims=True), y - y.mean()
    scale = np.sqrt((x * x).sum(1)) * np.sqrt(z @ z)
    return np.where(rows.std(1) > 0, np.clip(x @ z / np.where(scale > 0, scale, 1.0), -1.0, 1.0), 0.0)


def score_candidates(traces: DataFrame, candidates: DataFrame, library: DataFrame) -> DataFrame:
    """FEATURES of each candidate (precursor_idx, rank) from its traces and library intensities.

    ``library`` has precursor_idx, fragment, mz_library and intensity_library.
    """
    rows = traces.join(candidates, "precursor_idx").where(F.col("cycle").between(F.col("cycle_start"), F.col("cycle_stop")))
    rows = rows.join(library.select("precursor_idx", "fragment", "intensity_library"), ["precursor_idx", "fragment"])

    def solve(group: dict[str, np.ndarray], names: np.ndarray) -> list[tuple]:
        table, own, first = dense(group["fragment"], group["cycle"], group["intensity"])
        row = np.searchsorted(own, group["fragment"])
        _, at = np.unique(row, return_index=True)
        weight = group["intensity_library"][at]
        profile, total = table.sum(0), table.sum(1)
        r = correlations(table, profile)
        top = np.argsort(-weight, kind="stable")[:3]
        label = names[own].astype(str)
        kind = np.array([n[:1] for n in label])
        intensity, error = group["intensity"], np.abs((group["mz"] - group["mz_library"]) / group["mz_library"] * 1e6)
        near = np.isin(row, top)
        weighted = lambda e, w: float(np.average(e, weights=w)) if w.sum() > 0 else 0.0
        centre = int(group["cycle_center"][0]) - first
        of = lambda values, which: float(values[which].mean()) if which.any() else 0.0
        ends = (profile[0] + profile[-1]) / 2
        values = (
            len(table), np.log1p(total.sum()), profile.max(), ((profile[1:] + profile[:-1]) / 2).sum(), group["cycle_stop"][0] - group["cycle_start"][0], (profile > profile.max() / 2).sum(),
            r.mean(), r[top].mean(), np.median(r), weighted(error, intensity), weight @ total / (np.linalg.norm(weight) * np.linalg.norm(total) + 1e-4), int(profile.argmax()) - centre, (total > 0).mean(),
            correlation(weight, total), weighted(error[near], intensity[near]), of(r, kind == "b"), of(r, kind == "y"), np.log1p(total[kind == "b"].sum()), np.log1p(total[kind == "y"].sum()),
            overlap_by(label, total > 0), (r > 0.5).sum(), correlation(weight, table.max(1)), np.log1p(profile.max()) - np.log1p(ends),
        )
        return [tuple(map(float, values))]

    schema = "precursor_idx long, rank int, " + ", ".join(f"{f} double" for f in FEATURES)
    return per_group(rows, ["precursor_idx", "rank"], solve, schema)
