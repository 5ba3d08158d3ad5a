"""Summaries of search results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantiles

SMOOTH = 20


def protein_features(psm: DataFrame, *, group: str = "pg", decoy: str = "decoy", proba: str = "proba") -> DataFrame:
    """Per protein group and decoy flag: counts, distinct evidence, and score statistics."""
    return psm.groupBy(group, decoy).agg(
        F.count("*").alias("n_rows"), F.countDistinct("precursor_idx").alias("n_precursors"), F.countDistinct("sequence").alias("n_peptides"),
        F.countDistinct("run").alias("n_runs"), F.avg(proba).alias("mean_score"), F.min(proba).alias("best_score"), F.max(proba).alias("worst_score"),
        F.min_by("genes", F.struct("precursor_idx", "run")).alias("genes"), F.min_by("proteins", F.struct("precursor_idx", "run")).alias("proteins"),
    )


def run_statistics(psm: DataFrame, runs: DataFrame, channels: list[int]) -> DataFrame:
    """Per run and channel, empty ones included: rows, protein groups, mean peak widths."""
    base = runs.select("run").distinct().withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    stats = psm.groupBy("run", "channel").agg(
        F.count("*").alias("n"), F.countDistinct("pg").alias("n_pg"), F.avg("cycle_fwhm").alias("fwhm_rt"), F.avg("mobility_fwhm").alias("fwhm_mobility")
    )
    return base.join(stats, ["run", "channel"], "left").fillna(0, ["n", "n_pg"])


def mean_and_spread(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and standard deviation of columns per key; the deviation of a single row is null."""
    return df.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def group_ranges(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """First position of each key and the one after its last: (keys, start, stop)."""
    return df.groupBy(*keys).agg(F.min(position).alias("start"), (F.max(position) + 1).alias("stop"))


def modification_counts(psm: DataFrame, mods: str = "mods") -> DataFrame:
    """Rows with each modification, unmodified rows, and all rows."""
    each = psm.select(F.explode(F.array_distinct(F.split(mods, ";"))).alias("modification")).where("modification <> ''").groupBy("modification").agg(F.count("*").alias("n"))
    plain = psm.agg(F.count_if(F.coalesce(F.col(mods), F.lit("")) == "").alias("n")).select(F.lit("unmodified").alias("modification"), "n")
    total = psm.agg(F.count("*").alias("n")).select(F.lit("Total").alias("modification"), "n")
    return each.unionByName(plain).unionByName(total)


def fdr_summary(psm: DataFrame, keys: list[str], *, qval: str = "qval", decoy: str = "decoy", limits: tuple[float, ...] = (0.05, 0.01, 0.001)) -> DataFrame:
    """Targets and decoys per key, and targets at each q-value limit."""
    target = F.col(decoy) == 0
    at = [F.count_if(target & (F.col(qval) <= q)).alias(f"targets_{q:g}") for q in limits]
    return psm.groupBy(*keys).agg(F.count_if(target).alias("targets"), F.count_if(~target).alias("decoys"), *at)


def library_statistics(library: DataFrame) -> DataFrame:
    """Counts of a library by decoy flag, and its distinct groups, proteins and channels."""
    return library.agg(
        F.count_if(F.col("decoy") == 0).alias("targets"), F.count_if(F.col("decoy") == 1).alias("decoys"), F.countDistinct("elution_group_idx").alias("elution_groups"),
        F.countDistinct("proteins").alias("proteins"), F.countDistinct("channel").alias("channels"),
    )


def residual_interval(df: DataFrame, residual: str, share: float = 0.95) -> DataFrame:
    """Half width that holds ``share`` of the residuals: mean size of the two percentiles."""
    lo, hi = quantiles(df, residual, [(1 - share) / 2, (1 + share) / 2])
    return df.sparkSession.createDataFrame([(None if lo is None else (abs(lo) + abs(hi)) / 2,)], "ci double")


def median_known(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median of each column's numbers; columns that hold none are left out."""
    found = {c: quantiles(df, c, [0.5])[0] for c in columns}
    return {c: v for c, v in found.items() if v is not None}


def recalibration(psm: DataFrame, *, score: str, percentile: float = 0.01, factor: float = 0.99) -> DataFrame:
    """Median peak widths and the score cutoff of identified rows."""
    rt, mobility = (quantiles(psm, c, [0.5])[0] for c in ("cycle_fwhm", "mobility_fwhm"))
    cutoff = quantiles(psm, score, [percentile])[0]
    return psm.sparkSession.createDataFrame([(rt, mobility, None if cutoff is None else cutoff * factor)], "fwhm_rt double, fwhm_mobility double, score_cutoff double")


def posterior_error(df: DataFrame, score: str, decoy: str, *, bins: int = 100, sigma: float = 4.0, out: str = "pep") -> DataFrame:
    """Posterior error: smoothed share of decoys against targets in the score's bin, at most 1.

    Scores are binned between their extremes; counts (one row per bin) are smoothed by a
    Gaussian over SMOOTH bins on both sides and joined back by bin.
    """
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    place = F.least(F.floor((F.col(score) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12)) * bins), F.lit(bins - 1)).cast("int")
    rows = df.join(F.broadcast(ends)).withColumn("_bin", place).drop("_lo", "_hi")  # ends is one row
    counts = rows.groupBy("_bin").agg(F.sum(F.col(decoy)).cast("double").alias("d"), F.sum(1 - F.col(decoy)).cast("double").alias("t"))
    spread = counts.withColumn("_step", F.explode(F.sequence(F.lit(-SMOOTH), F.lit(SMOOTH))))
    weight = F.exp(-F.col("_step") * F.col("_step") / (2 * sigma * sigma))
    smooth = spread.groupBy((F.col("_bin") + F.col("_step")).alias("_bin")).agg(F.sum(F.col("d") * weight).alias("d"), F.sum(F.col("t") * weight).alias("t"))
    pep = smooth.select("_bin", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("d"), F.col("t")), F.lit(1.0))).alias(out))
    return rows.join(F.broadcast(pep), "_bin", "left").drop("_bin")


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Long table (metric, value): R2, slope, mean absolute error and its 95th percentile."""
    error = F.abs(F.col(predicted) - F.col(truth))
    high = quantiles(df, error, [0.95])[0]
    wide = df.agg(F.regr_r2(predicted, truth).alias("r_square"), F.regr_slope(predicted, truth).alias("r_slope"), F.avg(error).alias("l1")).withColumn("abs_error_95", F.lit(high).cast("double"))
    return wide.unpivot([], wide.columns, "metric", "value")


def classification_metrics(df: DataFrame, truth: str, probability: str) -> DataFrame:
    """Long table (metric, value): accuracy, precision, recall and cross entropy."""
    y, p = F.col(truth) == 1, F.col(probability)
    hit = p >= 0.5
    safe = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    wide = df.agg(
        F.avg((hit == y).cast("double")).alias("accuracy"), F.try_divide(F.count_if(hit & y), F.count_if(hit)).alias("precision"),
        F.try_divide(F.count_if(hit & y), F.count_if(y)).alias("recall"), F.avg(-F.when(y, F.log(safe)).otherwise(F.log(1 - safe))).alias("bce"),
    )
    return wide.unpivot([], wide.columns, "metric", "value")


def critical_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (column, n): rows whose value is null, not a number or infinite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    wide = df.agg(*(F.count_if(bad(c)).alias(c) for c in columns))
    return wide.unpivot([], columns, "column", "n")


def quality_control(frag: DataFrame, keys: list[str], *, intensity: str = "intensity", ratio: float = 0.75, least: float = 0.0) -> DataFrame:
    """Median of the positive values per key; weaker ones become 0, and use tells strong keys."""
    medians = frag.where(F.col(intensity) > 0).groupBy(*keys).agg(F.median(intensity).alias("median"))
    joined = frag.join(medians, keys)
    return joined.withColumn(intensity, F.when(F.col(intensity) > ratio * F.col("median"), F.col(intensity)).otherwise(0.0)).withColumn("use", F.col("median") > least)


def running_order(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Number of rows of the key before this one."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def group_quantiles(df: DataFrame, keys: list[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of a value per key, a column per name in ``shares``; a key's distinct values are held at once."""
    return df.groupBy(*keys).agg(*(F.percentile(value, p).alias(name) for name, p in shares.items()))


def score_histogram(df: DataFrame, score: str, decoy: Column, width: float) -> DataFrame:
    """Targets and decoys per score bin: (bin, t, d)."""
    return df.groupBy(F.floor(F.col(score) / width).alias("bin")).agg(F.count_if(~decoy).alias("t"), F.count_if(decoy).alias("d"))


def any_null(columns: list[str]) -> Column:
    """True if one of the columns is null or not a number."""
    return reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns))
