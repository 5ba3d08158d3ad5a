"""Tuning of a search: a locked part of the library is extracted, calibrated and searched again with closer tolerances."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.scalars import safe_pearson, weighted_mean
from peakloom.operators.calibrate import Estimator
from peakloom.operators.fdr import control
from peakloom.operators.joins import only_keys
from peakloom.operators.optimise import Automatic, Lock, Targeted, batch_of
from peakloom.operators.peak_index import PeakIndex
from peakloom.operators.ranking import quantiles
from peakloom.sources.shared import Scratch

from .search import Settings, scored_rows, search_run

#: Decoys that a least score has to leave.
DECOYS = 50


@dataclass
class Tuning:
    """What the tuning of a search can be told."""

    first_batch: int = 8000
    target: int = 200
    fdr: float = 0.01
    most_rounds: int = 20
    mz: Targeted | Automatic = field(default_factory=lambda: Targeted(30.0, 7.0))
    rt: Targeted | Automatic | None = field(default_factory=lambda: Targeted(600.0, 100.0))
    least_correlation: float = 0.7
    most_fragments: int = 5000


@dataclass
class Tuned:
    """What came out: settings, calibrations, what each round did, and the weights its classifiers ended with."""

    settings: Settings
    mz: Estimator
    rt: Estimator
    rt_tolerance: float | None
    rounds: list[dict] = field(default_factory=list)
    enough: bool = False
    starts: dict[str, list[float]] = field(default_factory=dict)

    def library(self, precursors: DataFrame, fragments: DataFrame) -> DataFrame:
        """Fragments at their calibrated m/z and, where times are known, within the cycles around their calibrated time."""
        out = fragments.withColumn("mz_theoretical", F.col("mz_library"))
        if self.mz.model is not None:
            out = self.mz.predict(out)
        if self.rt_tolerance is None:
            return out
        timed = self.rt.predict(precursors) if self.rt.model is not None else precursors.withColumn("rt_predicted", F.col("rt_library"))
        seconds = self.settings.cycle_seconds
        limits = timed.select(
            "precursor_idx", F.floor((F.col("rt_predicted") - self.rt_tolerance) / seconds).alias("first_cycle"), F.ceil((F.col("rt_predicted") + self.rt_tolerance) / seconds).alias("last_cycle")
        )
        return out.join(limits, "precursor_idx")


def calibration_fragments(fragments: DataFrame, *, least_correlation: float, most: int) -> DataFrame:
    """The best correlated fragments: as many as exceed the limit, and ``most`` at most (a top-k selection)."""
    above = fragments.where(F.col("correlation") > least_correlation).count()
    return fragments.orderBy(F.desc("correlation"), "precursor_idx", "fragment").limit(min(above, most))


def observed_fragments(traces: DataFrame, found: DataFrame, library: DataFrame) -> DataFrame:
    """Observed m/z and profile correlation of each fragment inside its row's limits."""
    inside = traces.join(found.select("precursor_idx", "cycle_start", "cycle_stop"), "precursor_idx").where(F.col("cycle").between(F.col("cycle_start"), F.col("cycle_stop")))
    profile = inside.groupBy("precursor_idx", "cycle").agg(F.sum("intensity").alias("profile"))
    seen = inside.join(profile, ["precursor_idx", "cycle"]).groupBy("precursor_idx", "fragment").agg(
        weighted_mean("mz", "intensity").alias("mz_observed"), safe_pearson("intensity", "profile").alias("correlation")
    )
    return seen.join(library.select("precursor_idx", "fragment", "mz_theoretical"), ["precursor_idx", "fragment"])


def tune_search(precursors: DataFrame, fragments: DataFrame, peaks: DataFrame | PeakIndex, settings: Settings = Settings(), tuning: Tuning | None = None) -> Tuned:  # noqa: B008
    """Find tolerances and calibrations of a run.

    ``precursors`` has elution_group_idx besides what search_run needs, and rt_library (seconds)
    where times are to be calibrated. A round extracts the lock's part of the library, all rows
    found so far are classified, and

    * with fewer than ``target`` targets at ``fdr``, the next, larger part is added; where none
      is left, calibrations are fitted to what there is and ``enough`` stays false;
    * else m/z and time are calibrated on the finds, the width of the kernel and the least score
      are set from them, the lock shrinks to what the target needs, and, from the second such
      round on, each tolerance follows the residuals (Targeted) or the number of finds
      (Automatic) until all are done.

    Rounds are driver steps over saved tables; what they collect is a count, a few quantiles and
    normal equations.
    """
    tuning = tuning or Tuning()
    scratch = Scratch(precursors.sparkSession, "tuning")
    timed = tuning.rt is not None and "rt_library" in precursors.columns
    out = Tuned(
        replace(settings, selection=replace(settings.selection, ppm=tuning.mz.value)),
        Estimator("mz", "mz_theoretical", "mz_observed", "mz_library", relative=True),
        Estimator("rt", "rt_library", "rt", "rt_predicted"),
        tuning.rt.value if timed else None,
    )
    total = precursors.select("elution_group_idx").distinct().count()
    if not total:
        return out
    lock = Lock(total, min(tuning.first_batch, total), tuning.target)
    open_ = {"mz": tuning.mz} | ({"rt": tuning.rt} if timed else {})
    held: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    calibrated = False
    for _ in range(tuning.most_rounds):
        start, stop = lock.span
        batch = batch_of(precursors, "elution_group_idx", start, stop, total)
        library = scratch.save(out.library(batch, only_keys(fragments, batch, ["precursor_idx"])))
        rows, traces, features = scored_rows(batch, library, peaks, out.settings, scratch)
        held.append((rows, traces, library))
        psm = scratch.save(control(reduce(DataFrame.unionByName, (h[0] for h in held)), features, keys=["precursor_idx"], starts=out.starts))
        found = scratch.save(psm.where((F.col("qval") <= tuning.fdr) & (F.col("decoy") == 0)))
        n = found.count()
        out.rounds.append({"start": start, "stop": stop, "rows": rows.count(), "found": n, "ppm": out.settings.selection.ppm, "rt": out.rt_tolerance})
        more = lock.update(n)
        if not lock.reached and more:
            continue
        if n:
            seen = scratch.save(calibration_fragments(reduce(DataFrame.unionByName, (observed_fragments(t, found, lib) for _, t, lib in held)), least_correlation=tuning.least_correlation, most=tuning.most_fragments))
            _recalibrate(out, found, seen, psm, timed)
        if not lock.reached:
            break
        held = []
        if not calibrated:  # tolerances are followed on calibrated values alone
            calibrated = True
            continue
        for name, table in (("mz", seen), ("rt", found)):
            if name in open_:
                o, interval = open_[name], getattr(out, name).interval(table)
                if o.update(interval) if isinstance(o, Targeted) else o.update(float(n), interval):
                    del open_[name]
        out.settings = replace(out.settings, selection=replace(out.settings.selection, ppm=tuning.mz.value))
        out.rt_tolerance = tuning.rt.value if timed else None
        if not open_:
            out.enough = True
            break
    return out


def _recalibrate(out: Tuned, found: DataFrame, seen: DataFrame, psm: DataFrame, timed: bool) -> None:
    """Fit the calibrations, the kernel's width and the least score to what was found.

    A least score that would leave fewer than DECOYS decoys to control errors with is not taken.
    """
    if not seen.isEmpty():
        out.mz.fit(seen)
    if timed:
        out.rt.fit(found)
    (width,), (score,) = quantiles(found, "fwhm", [0.5]), quantiles(found, "score", [0.01])
    cutoff = 0.99 * float(score)
    if psm.where((F.col("decoy") == 1) & (F.col("score") > cutoff)).count() < DECOYS:
        cutoff = out.settings.selection.score_cutoff
    out.settings = replace(out.settings, selection=replace(out.settings.selection, fwhm_cycles=max(float(width), 1.0), score_cutoff=cutoff))


def tuned_search(run: str, precursors: DataFrame, fragments: DataFrame, peaks: DataFrame | PeakIndex, settings: Settings = Settings(), tuning: Tuning | None = None) -> tuple[DataFrame, DataFrame, Tuned]:  # noqa: B008
    """Tune on a part of the library, then search all of it: rows, fragments and what was tuned."""
    tuned = tune_search(precursors, fragments, peaks, settings, tuning)
    psm, ions = search_run(run, precursors, tuned.library(precursors, fragments), peaks, tuned.settings, starts=tuned.starts)
    return psm, ions, tuned
