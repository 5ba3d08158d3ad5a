"""Joins: missing columns, filters by key, fallback lookups, tolerance and interval joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import keep_best


def merge_missing_columns(left: DataFrame, right: DataFrame, columns: list[str], on: list[str], how: str = "left") -> DataFrame:
    """Join those of ``columns`` that ``left`` lacks; nothing to do if it has all."""
    if how not in ("left", "right", "inner", "outer"):
        raise ValueError(f"unknown join: {how}")
    for side, df in (("left", left), ("right", right)):
        if absent := [k for k in on if k not in df.columns]:
            raise ValueError(f"{side} side lacks {absent}")
    missing = [c for c in columns if c not in left.columns]
    if absent := [c for c in missing if c not in right.columns]:
        raise ValueError(f"right side lacks {absent}")
    return left.join(right.select(*on, *missing), on, how) if missing else left


def unique_left_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join of columns the left side lacks; each key may occur once on the right."""
    extra = [c for c in right.columns if c not in left.columns]
    counted = right.groupBy(*on).agg(*(F.first(c).alias(c) for c in extra), F.count("*").alias("_n"))
    checked = counted.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("right keys are not unique"))))
    return left.join(checked, on, "left").where(F.col("_ok").isNull()).drop("_n", "_ok")


def only_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys.select(*on), on, "left_semi")


def without_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key does not occur in ``keys``."""
    return df.join(keys.select(*on), on, "left_anti")


def lookup_with_fallback(targets: DataFrame, specific: DataFrame, fallback: DataFrame, *, key: str, fallback_key: str, value: str, out: str) -> DataFrame:
    """Value of the specific key, else of the fallback key.

    ``specific`` has (key, value) and ``fallback`` (fallback_key, value), one row per key.
    """
    s = specific.select(F.col(key), F.col(value).alias("_specific"))
    f = fallback.select(F.col(fallback_key), F.col(value).alias("_fallback"))
    joined = targets.join(s, key, "left").join(f, fallback_key, "left")
    return joined.withColumn(out, F.coalesce("_specific", "_fallback")).drop("_specific", "_fallback")


def multiplex(candidates: DataFrame, library: DataFrame, *, group: str, channel: str, order: list[str], channels: list[int]) -> DataFrame:
    """The best candidate of each group, for every library entry of the group in ``channels``."""
    best = keep_best(candidates, [group], order)
    entries = library.where(F.col(channel).isin(channels)) if channels else library.where(F.lit(False))
    extra = [c for c in best.columns if c not in entries.columns or c == group]
    return entries.join(best.select(*extra), group)


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, *, ppm: float | None = None, width: float | None = None, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose values differ by at most a relative (ppm of the right) or fixed width.

    Values get bins as wide as the tolerance, logarithmic for a relative one; the left side is
    looked up in three bins, so the join is an equality join whose size follows the matches.
    """
    if (ppm is None) == (width is None):
        raise ValueError("give one of ppm and width")
    if ppm is not None:
        step = math.log1p(2 * ppm * 1e-6)
        bin_of = lambda c: F.floor(F.log(c) / step)
        close = F.abs(F.col(left_value) - F.col(right_value)) <= F.col(right_value) * ppm * 1e-6
    else:
        bin_of = lambda c: F.floor(F.col(c) / width)
        close = F.abs(F.col(left_value) - F.col(right_value)) <= width
    b = bin_of(left_value)
    spread = left.withColumn("_bin", F.explode(F.array(b - 1, b, b + 1)))
    return spread.join(right.withColumn("_bin", bin_of(right_value)), [*(on or []), "_bin"]).where(close).drop("_bin")


def assemble(wanted: DataFrame, index: DataFrame, place: list[str], keys: list[str], value: str) -> DataFrame:
    """Sum of the values of ``index`` at the places that each key of ``wanted`` lists."""
    return wanted.select(*keys, *place).distinct().join(index.select(*place, value), place).groupBy(*keys).agg(F.sum(value).alias(value))


def interval_overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float, *, heavy: int = 50_000_000) -> DataFrame:
    """Pairs of rows whose closed intervals overlap.

    Each interval is listed in every cell of ``width`` that it touches; a pair is kept in the
    cell where the later of the two begins, so it appears once. A cell of many pairs is dealt
    over parts of about ``heavy`` of them: a left row is in one part, a right row in all.
    """
    (a, b), (c, d) = left_span, right_span
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    one, two = left.withColumn("_cell", cells(a, b)), right.withColumn("_cell", cells(c, d))
    sizes = one.groupBy("_cell").agg(F.count("*").alias("_l")).join(two.groupBy("_cell").agg(F.count("*").alias("_r")), "_cell")
    parts = sizes.select("_cell", F.least(F.ceil(F.col("_l") * F.col("_r") / heavy), F.col("_l")).cast("int").alias("_parts"))
    dealt = one.join(parts, "_cell").withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.col("_parts").cast("long")).cast("int")).drop("_parts")
    spread = two.join(parts, "_cell").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    # Pairs take time rather than bytes, so partitions are not merged by size.
    count = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * left.sparkSession.sparkContext.defaultParallelism)
    pairs = dealt.repartition(count, "_cell", "_part").join(spread.repartition(count, "_cell", "_part").hint("shuffle_hash"), ["_cell", "_part"])
    overlap = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b))
    return pairs.where(overlap & (F.col("_cell") == F.floor(F.greatest(a, c) / width))).drop("_cell", "_part")


def window_index(df: DataFrame, value: str, windows: list[tuple[float, float]], out: str = "window_idx") -> DataFrame:
    """Number of the first window [low, high) that holds a value; 0 if none does."""
    index: Column = F.lit(0)
    for i, (lo, hi) in reversed(list(enumerate(windows))):
        index = F.when((F.col(value) >= lo) & (F.col(value) < hi), i).otherwise(index)
    return df.withColumn(out, index)


def close_pairs(df: DataFrame, keys: list[str], value: str, order: str, width: float) -> DataFrame:
    """Pairs (order_1 < order_2) of rows of one key whose values differ by less than ``width``."""
    rows = df.select(*keys, value, order)
    one = rows.withColumnsRenamed({value: f"{value}_1", order: f"{order}_1"})
    two = rows.withColumnsRenamed({value: f"{value}_2", order: f"{order}_2"})
    pairs = band_join(one, two, f"{value}_1", f"{value}_2", width=width, on=keys)
    return pairs.where((F.col(f"{order}_1") < F.col(f"{order}_2")) & (F.abs(F.col(f"{value}_1") - F.col(f"{value}_2")) < width))
