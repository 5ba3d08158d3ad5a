"""Whole searches: one run, the combination of runs, and several steps in a row."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.scalars import safe_pearson
from peakloom.operators.aggregates import fdr_summary, run_statistics
from peakloom.operators.candidates import FEATURES, Selection, extract_traces, isotope_traces, precursor_scores, score_candidates, select
from peakloom.operators.competition import compete
from peakloom.operators.fdr import control, control_by_channel, protein_control
from peakloom.operators.grouping import infer_groups
from peakloom.operators.joins import multiplex, only_keys, window_index
from peakloom.operators.library import all_fragments, isotope_pattern, match_between_runs, unshared_ions, with_reference
from peakloom.operators.peak_index import PeakIndex
from peakloom.operators.quantify import accumulate, filter_ions, label_free, merge_levels
from peakloom.sources.shared import Scratch


@dataclass(frozen=True)
class Settings:
    """What a search step can be told."""

    selection: Selection = field(default_factory=Selection)
    fdr: float = 0.01
    compete: bool = True
    inference: str = "heuristic"
    top_ions: int = 12
    ion_quality: float = 0.5
    windows: tuple[tuple[float, float], ...] = ()  # isolation windows of one cycle
    cycle_seconds: float = 1.0
    rt_tolerance: float = 3.0
    ms1_scores: bool = False  # whether the classifier reads the scores of the isotope traces


def observable(library: DataFrame, spectra: DataFrame) -> DataFrame:
    """Library entries whose m/z lies in the range of the run's isolation windows."""
    limits = spectra.where("ms_level > 1").agg(F.min("isolation_lower_mz").alias("_lo"), F.max("isolation_upper_mz").alias("_hi"))
    return library.join(F.broadcast(limits), F.col("mz_library").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")  # limits is one row


def scored_rows(precursors: DataFrame, fragments: DataFrame, peaks: DataFrame | PeakIndex, settings: Settings, scratch: Scratch, *, ms1: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Scored candidates of the library, their traces, and the names of the scores."""
    traces = scratch.save(extract_traces(peaks, fragments, ppm=settings.selection.ppm))
    isotopes = None if ms1 is None else scratch.save(isotope_traces(ms1, precursors, ppm=settings.selection.ppm, n=settings.selection.isotopes))
    picked = scratch.save(select(traces, settings.selection, isotopes))
    scored = score_candidates(traces, picked, fragments).join(picked, ["precursor_idx", "rank"])
    features = [*FEATURES, "score"]
    if isotopes is not None and settings.ms1_scores:
        expected = isotope_pattern(F.col("sequence"), settings.selection.isotopes, F.col("mods") if "mods" in precursors.columns else None)
        scores = precursor_scores(isotopes, picked, precursors.select("precursor_idx", F.posexplode(expected).alias("isotope", "intensity"))).drop("mz_observed")
        scored = scored.join(scores, ["precursor_idx", "rank"])
        features += [c for c in scores.columns if c not in ("precursor_idx", "rank")]
    rows = scratch.save(scored.join(precursors, "precursor_idx").withColumn("rt", F.col("cycle_center") * settings.cycle_seconds))
    return rows, traces, features


def search_run(run: str, precursors: DataFrame, fragments: DataFrame, peaks: DataFrame | PeakIndex, settings: Settings, *, ms1: DataFrame | None = None, starts: dict[str, list[float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored rows of one run and their fragment intensities with each fragment's correlation.

    ``precursors`` has precursor_idx, decoy, proteins, sequence, and mz and charge where
    ``ms1`` peaks or isolation windows are to be used; ``fragments`` precursor_idx, fragment,
    mz_library, intensity_library; ``peaks`` (or their index) and ``ms1`` cycle, mz, intensity.
    Precursors compete inside the isolation window of their m/z, within ``rt_tolerance`` seconds.
    ``starts`` hands the weights of classifiers on from one search to the next.
    """
    scratch = Scratch(precursors.sparkSession, "search")
    rows, traces, features = scored_rows(precursors, fragments, peaks, settings, scratch, ms1=ms1)
    psm = control(rows, features, keys=["precursor_idx"], starts=starts)
    if settings.compete:
        placed = window_index(psm, "mz", list(settings.windows)) if settings.windows else psm.withColumn("window_idx", F.lit(0))
        named = scratch.save(placed.withColumn("id", F.col("precursor_idx")))
        psm = compete(named, fragments.select(F.col("precursor_idx").alias("id"), F.col("mz_library").alias("mz")), rt=settings.rt_tolerance).drop("id", "window_idx")
    psm = scratch.save(psm.where(F.col("qval") <= settings.fdr).withColumn("run", F.lit(run)))
    return psm, fragment_table(traces, psm).withColumn("run", F.lit(run))


def fragment_table(traces: DataFrame, psm: DataFrame) -> DataFrame:
    """Intensity, height and correlation with the summed profile of each fragment inside its row's limits."""
    inside = traces.join(psm.select("precursor_idx", "cycle_start", "cycle_stop"), "precursor_idx").where(F.col("cycle").between(F.col("cycle_start"), F.col("cycle_stop")))
    profile = inside.groupBy("precursor_idx", "cycle").agg(F.sum("intensity").alias("profile"))
    return inside.join(profile, ["precursor_idx", "cycle"]).groupBy("precursor_idx", "fragment").agg(
        F.sum("intensity").alias("intensity"), F.max("intensity").alias("height"), safe_pearson("intensity", "profile").alias("correlation")
    )


def requantify_all_fragments(psm: DataFrame, library: DataFrame, peaks: DataFrame, *, ppm: float, charges: tuple[int, ...] = (1, 2)) -> DataFrame:
    """fragment_table of every b and y fragment of the found targets, for a transfer library.

    ``psm`` has one row per precursor_idx with decoy, cycle_start and cycle_stop; ``library``
    precursor_idx and sequence.
    """
    found = psm.where("decoy = 0").select("precursor_idx", "cycle_start", "cycle_stop")
    ions = all_fragments(only_keys(library, found, ["precursor_idx"]), charges=charges)
    limited = ions.withColumn("fragment", F.concat("type", F.col("number").cast("string"), F.lit("+"), F.col("charge").cast("string"))).join(found, "precursor_idx")
    traces = extract_traces(peaks, limited.withColumnsRenamed({"cycle_start": "first_cycle", "cycle_stop": "last_cycle"}), ppm=ppm)
    return fragment_table(traces, found)


def requantify_channels(
    found: DataFrame, library: DataFrame, fragments: DataFrame, peaks: DataFrame, *, reference: int, targets: list[int], decoy_channel: int, ppm: float, least: int = 20
) -> DataFrame:
    """Rows of every channel at the place of each group's best row, with q-values against the decoy channel.

    ``found`` has elution_group_idx, proba, precursor_idx, cycle_start, cycle_center and
    cycle_stop; ``library`` has elution_group_idx, precursor_idx, channel and decoy. Groups
    without the reference channel are left out, and so are ions that channels share.
    """
    scratch = Scratch(peaks.sparkSession, "channels")
    places = found.select("elution_group_idx", "proba", F.col("precursor_idx").alias("found_idx"), "cycle_start", "cycle_center", "cycle_stop")
    rows = multiplex(places, library, group="elution_group_idx", channel="channel", order=["proba", "found_idx"], channels=sorted({reference, *targets, decoy_channel}))
    rows = scratch.save(with_reference(rows, reference).drop("proba").withColumn("rank", F.lit(0)))
    ions = fragments.join(rows.select("precursor_idx", "elution_group_idx", "channel", F.col("cycle_start").alias("first_cycle"), F.col("cycle_stop").alias("last_cycle")), "precursor_idx")
    own = scratch.save(unshared_ions(ions))
    traces = scratch.save(extract_traces(peaks, own, ppm=ppm))
    scored = score_candidates(traces, rows.select("precursor_idx", "rank", "cycle_start", "cycle_center", "cycle_stop"), own).join(rows, ["precursor_idx", "rank"])
    wanted = [c for c in sorted({reference, *targets}) if c != decoy_channel]
    return control_by_channel(scratch.save(scored), list(FEATURES), wanted, decoy_channel=decoy_channel, keys=["precursor_idx"], least=least)


def combine(psm: DataFrame, frag: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Results over all runs: rows with groups and quantities, matrices, summaries.

    Ions are filtered by the correlation that the search gave them.
    """
    scratch = Scratch(psm.sparkSession, "combine")
    grouped = scratch.save(protein_control(infer_groups(psm, strategy=settings.inference).withColumn("genes", F.col("proteins"))))
    found = grouped.where(F.col("pg_qval") <= settings.fdr).where("decoy = 0")
    keys = found.select("precursor_idx", "run", "pg", "sequence").distinct()
    ions = scratch.save(frag.join(keys, ["precursor_idx", "run"]).withColumn("ion", F.concat_ws(":", "precursor_idx", "fragment")))
    runs = found.select("run").distinct()
    names = sorted(r["run"] for r in runs.collect())  # one row per run
    matrices = {}
    for level, key in (("precursor", "precursor_idx"), ("peptide", "sequence"), ("pg", "pg")):
        kept = filter_ions(ions, key, "ion", "correlation", top_n=settings.top_ions, min_quality=settings.ion_quality)
        long = label_free(kept, key, "ion", "run", "intensity")
        matrices[level] = (key, scratch.save(accumulate(long, [key], "run", "intensity", names)))
    stats = run_statistics(found.withColumns({"channel": F.lit(0), "cycle_fwhm": F.col("fwhm"), "mobility_fwhm": F.lit(0.0)}), runs, [0])
    return {"precursors": merge_levels(found, matrices), "stats": stats, "fdr": fdr_summary(grouped, ["run"])} | {f"{k}_matrix": m for k, (_, m) in matrices.items()}


@dataclass
class Step:
    """One step of a search and what it hands to the next one."""

    name: str
    settings: Settings
    seconds: float = 0.0
    tolerance: float | None = None


def multistep(steps: list[Step], run: Callable[[Step], tuple[DataFrame, float]]) -> DataFrame:
    """Run steps in order; each gets the tolerance that the one before has found.

    ``run`` returns a step's rows and its optimised tolerance. Settings are merged field by
    field, so a step keeps what the hand-over does not name.
    """
    out, tolerance = None, None
    for step in steps:
        if tolerance is not None:
            step.settings = replace(step.settings, selection=replace(step.settings.selection, ppm=tolerance))
        began = time.time()
        out, tolerance = run(step)
        step.seconds, step.tolerance = time.time() - began, tolerance
    return out


def next_library(psm: DataFrame, library: DataFrame, settings: Settings) -> DataFrame:
    """Library for a second pass, from what the first one has identified."""
    return match_between_runs(psm, library, fdr=settings.fdr)


def merge_config(base: dict, *more: dict) -> dict:
    """Layers of settings: later values win, nested tables are merged."""
    out = dict(base)
    for layer in more:
        for k, v in layer.items():
            out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
