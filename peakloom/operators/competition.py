"""Fragment competition: of precursors that share fragments in a window, the best one stays."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.sources.shared import Scratch

from .joins import band_join


def shared_fragments(a: np.ndarray, b: np.ndarray, ppm: float) -> int:
    """Pairs of values within the tolerance of the second one."""
    a, b = np.sort(a), np.sort(b)
    return int((np.searchsorted(a, b * (1 + ppm * 1e-6), "right") - np.searchsorted(a, b * (1 - ppm * 1e-6), "left")).sum())


def overlapping_pairs(psm: DataFrame, frag: DataFrame, *, ppm: float = 15.0, rt: float = 3.0, least: int = 3) -> DataFrame:
    """Pairs (better, worse) of one window with close retention times and shared fragments.

    ``psm`` has window_idx, id, rt and proba; ``frag`` has id and mz. Fragments are paired by a
    binned tolerance join inside windows and cells of time, so pairs without a common fragment
    or far apart in time never appear.
    """
    rows = frag.join(psm.select("id", "window_idx", "rt", "proba"), "id")
    return _overlaps(rows, rows, ppm=ppm, rt=rt, least=least)


def _overlaps(better: DataFrame, worse: DataFrame, *, ppm: float, rt: float, least: int) -> DataFrame:
    """Pairs as overlapping_pairs gives them, between rows (window_idx, id, rt, proba, mz) of two tables."""
    cell = F.floor(F.col("rt") / rt)
    one = better.select("window_idx", F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"), *(F.col(c).alias(f"{c}_1") for c in ("id", "mz", "rt", "proba")))
    two = worse.select("window_idx", cell.alias("_cell"), *(F.col(c).alias(f"{c}_2") for c in ("id", "mz", "rt", "proba")))
    pairs = band_join(one, two, "mz_1", "mz_2", ppm=ppm, on=["window_idx", "_cell"])
    first = F.struct("proba_1", "id_1") < F.struct("proba_2", "id_2")
    near = pairs.where(first & (F.abs(F.col("rt_1") - F.col("rt_2")) < rt))
    counted = near.groupBy("window_idx", "id_1", "id_2", "proba_1", "proba_2").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).select("window_idx", F.col("id_1").alias("better"), F.col("id_2").alias("worse"), F.col("proba_1").alias("proba"))


def survivors(pairs: list[tuple], order: list) -> set:
    """Ids that go when, best first, each one still valid removes the worse ones it overlaps."""
    below: dict = {}
    for better, worse in pairs:
        below.setdefault(better, []).append(worse)
    gone: set = set()
    for i in order:
        if i not in gone:
            gone.update(below.get(i, ()))
    return gone


def lost_ids(pairs: DataFrame, *, most: int = 200_000) -> DataFrame:
    """Ids that a better one removes, as if all were visited one after the other, best first.

    In a round, ids without a live better rival stay and their worse rivals go, which is what
    the visit in order does too; pairs of ids that went are dropped. Once ``most`` pairs are
    left, one task visits them in order.
    """
    scratch = Scratch(pairs.sparkSession, "compete")
    live = scratch.save(pairs.select("better", "worse", "proba").distinct())
    kind = dict(live.dtypes)["better"]
    lost = []
    while live.count() > most:
        tops = live.select("better").distinct().join(live.select(F.col("worse").alias("better")).distinct(), "better", "left_anti")
        gone = scratch.save(live.join(tops, "better").select(F.col("worse").alias("id")).distinct())
        lost.append(gone)
        rest = live.join(gone.withColumnRenamed("id", "better"), "better", "left_anti").join(gone.withColumnRenamed("id", "worse"), "worse", "left_anti")
        before, live = live, scratch.save(rest)
        scratch.drop(before)

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["proba", "better"])["better"].drop_duplicates().tolist()
        return pd.DataFrame({"id": sorted(survivors(list(zip(pdf["better"], pdf["worse"])), order))})

    last = live.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(visit, f"id {kind}")  # at most ``most`` rows
    return reduce(DataFrame.union, lost, last)


#: Ids of the first batch, about, and how much larger each later one is than those before it.
FIRST, GROWTH = 50_000, 4


def compete(psm: DataFrame, frag: DataFrame, *, most: int = 200_000, ppm: float = 15.0, rt: float = 3.0, least: int = 3) -> DataFrame:
    """``psm`` without the rows that lose their fragments to a better one of the same window.

    Pairs of all rows would grow with the square of those close to each other, so two things
    keep them few, and neither changes what the visit in order gives. Rows that agree in
    everything but the id are one: the least id removes the others, as they share enough
    fragments, and what removes it removes them. The rest compete in batches of rising proba: a
    batch holds no row that a survivor of an earlier one removes, and survivors share few
    fragments with each other, so each row meets few of them.
    """
    scratch = Scratch(psm.sparkSession, "batches")
    settings = {"ppm": ppm, "rt": rt, "least": least}
    lists = frag.where("mz > 0 AND NOT isnan(mz)").groupBy("id").agg(F.sort_array(F.collect_list("mz")).alias("mzs"))  # an id's fragments
    known = psm.where("window_idx IS NOT NULL AND rt IS NOT NULL AND NOT isnan(rt) AND proba IS NOT NULL").select("id", "window_idx", "rt", "proba")
    own = F.when(F.size("mzs") < least, F.col("id"))  # too few to remove a copy
    rows = scratch.save(known.join(lists, "id").withColumn("_own", own))
    same = ["window_idx", "rt", "proba", "mzs", "_own"]
    live = scratch.save(rows.groupBy(*same).agg(F.min("id").alias("id")))
    copies = scratch.save(rows.select("id").join(live.select("id"), "id", "left_anti"))
    scratch.drop(rows)
    sizes = [live.count()]
    while sizes[-1] > GROWTH * FIRST:
        sizes.append(sizes[-1] // GROWTH)
    shares = [n / sizes[0] for n in reversed(sizes[1:])]
    limits = live.agg(F.percentile_approx(F.col("proba").cast("double"), shares)).first()[0] if shares else []
    lost = []
    lines = lambda df: df.select("window_idx", "id", "rt", "proba", F.explode("mzs").alias("mz"))
    for limit in [*sorted(set(limits)), None]:
        first = F.lit(True) if limit is None else F.col("proba") <= limit
        batch, before = lines(live.where(first)), live
        gone = scratch.save(lost_ids(scratch.save(_overlaps(batch, batch, **settings)), most=most))
        lost.append(gone)
        if limit is not None:
            kept, rest = lines(live.where(first).join(gone, "id", "left_anti")), live.where(~first)
            beaten = scratch.save(_overlaps(kept, lines(rest), **settings).select(F.col("worse").alias("id")).distinct())
            lost.append(beaten)
            live = scratch.save(rest.join(beaten, "id", "left_anti"))
        scratch.drop(before)
    return psm.join(reduce(DataFrame.union, lost, copies), "id", "left_anti")
