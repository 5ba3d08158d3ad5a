"""Operators on ordered signals: peaks, areas, smoothing, periodicity, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import keep_best


def local_peaks(df: DataFrame, keys: list[str], order: list[str], value: str, top: int | None = None) -> DataFrame:
    """Rows that are strict maxima of five neighbours; optionally the ``top`` highest per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = F.col(value)
    a, b, c, d = (F.lag(value, 1).over(w), F.lag(value, 2).over(w), F.lead(value, 1).over(w), F.lead(value, 2).over(w))
    found = df.withColumn("_peak", (b < a) & (a < v) & (v > c) & (c > d)).where("_peak").drop("_peak")
    if top is None:
        return found
    best = Window.partitionBy(*keys).orderBy(F.desc(value), *order)
    return found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top).drop("_rank")


def local_peaks_2d(df: DataFrame, keys: list[str], row: str, column: str, value: str, top: int | None = None) -> DataFrame:
    """Cells of a grid that are strict maxima of five neighbours along their row and their column.

    ``row`` and ``column`` are whole numbers; a cell whose two neighbours on each side are not
    all there is no peak. Optionally the ``top`` highest per key.
    """
    v, found = F.col(value), df
    for line, place in ((row, column), (column, row)):
        w = Window.partitionBy(*keys, line).orderBy(place)
        at = lambda d: F.when(F.lag(place, d).over(w) == F.col(place) - d, F.lag(value, d).over(w))  # noqa: E731, B023
        found = found.withColumn(f"_{place}", (at(2) < at(1)) & (at(1) < v) & (v > at(-1)) & (at(-1) > at(-2)))
    found = found.where(F.col(f"_{row}") & F.col(f"_{column}")).drop(f"_{row}", f"_{column}")
    return found if top is None else keep_best(found, keys, [F.desc(value), row, column], top)


def centre_envelope(profile: Column) -> Column:
    """Profile that falls off from its centre: no point is above the mean of the two before it.

    A profile of even length has two centres. The point next to a single centre is held against
    its own mean with the centre, that next to one of two centres against the centre itself.
    """
    n = F.size(profile)
    odd = n % 2 == 1

    def outward(side: Column) -> Column:
        first = F.when(odd, (side[0] + F.coalesce(F.get(side, 1), side[0])) / 2).otherwise(side[0])
        start = F.struct(F.array(side[0]).alias("kept"), first.alias("limit"))

        def step(s: Column, v: Column) -> Column:
            low = F.least(s["limit"], v)
            return F.struct(F.concat(s["kept"], F.array(low)).alias("kept"), ((low + F.element_at(s["kept"], -1)) / 2).alias("limit"))

        return F.aggregate(F.slice(side, F.lit(2), F.size(side)), start, step, lambda s: s["kept"])

    half = F.floor(n / 2).cast("int")
    left = F.reverse(outward(F.reverse(F.slice(profile, F.lit(1), F.when(odd, half + 1).otherwise(half)))))
    right = outward(F.slice(profile, half + 1, n))
    return F.when(n > 2, F.concat(left, F.when(odd, F.slice(right, F.lit(2), F.size(right))).otherwise(right))).otherwise(profile)


def trapezoid_area(df: DataFrame, keys: list[str], order: list[str], x: Column, y: str, out: str = "area") -> DataFrame:
    """Area under y over x per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_x", x)
    part = (F.col(y) + F.lag(y).over(w)) * 0.5 * (F.col("_x") - F.lag("_x").over(w))
    return rows.withColumn("_part", part).groupBy(*keys).agg(F.sum("_part").alias(out))


def fill_dips(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Replace a value that is below one of its two neighbours by their mean; both ends stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a, c = F.lag(value).over(w), F.lead(value).over(w)
    dip = ((F.col(value) < a) | (F.col(value) < c)) & a.isNotNull() & c.isNotNull()
    return df.withColumn("_v", F.when(dip, (a + c) / 2).otherwise(F.col(value))).drop(value).withColumnRenamed("_v", value)


def autocorrelation(df: DataFrame, index: str, value: str, lags: int) -> DataFrame:
    """Autocorrelation of a centred signal for lags 0 to ``lags``: (lag, r).

    The index is dense; each row is sent to the rows that lag it, so the join is an equality
    join of ``lags + 1`` times the rows.
    """
    centre = df.agg(F.avg(F.col(value).cast("double")).alias("_m"))
    rows = df.join(F.broadcast(centre)).select(F.col(index).alias("i"), (F.col(value).cast("double") - F.col("_m")).alias("d"))  # centre is one row
    spread = rows.select(F.col("d").alias("e"), "i", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")).select("e", "lag", (F.col("i") - F.col("lag")).alias("i"))
    sums = rows.join(spread, "i").groupBy("lag").agg(F.sum(F.col("d") * F.col("e")).alias("s"))
    zero = sums.where("lag = 0").select(F.col("s").alias("z"))
    return sums.join(F.broadcast(zero)).select("lag", (F.col("s") / F.col("z")).alias("r"))


def cycle_length(signature: list[float]) -> int:
    """Length of the repeating block of a short signature: the lag of the first highest peak; -1 if none.

    For the head of a run (a few hundred spectra), collected from a limited query.
    """
    n = len(signature)
    mean = sum(signature) / n if n else 0.0
    d = [x - mean for x in signature]
    total = sum(x * x for x in d)
    if not total:
        return -1
    r = [sum(d[i] * d[i + k] for i in range(n - k)) / total for k in range(n)]
    peaks = [k for k in range(1, n - 1) if r[k - 1] < r[k] > r[k + 1]]
    return max(peaks, key=lambda k: (r[k], -k)) if peaks else -1


def cycle_start(signature: list[float], length: int) -> int:
    """First place where two successive blocks agree and are not constant; -1 if there is none."""
    if length <= 0:
        return -1
    for i in range(len(signature) - 2 * length + 1):
        block = signature[i : i + length]
        if block == signature[i + length : i + 2 * length] and len(set(block)) > 1:
            return i
    return -1


def check_cycle(spectra: DataFrame, order: str, signature: str, start: int, length: int) -> DataFrame:
    """Spectra from ``start`` on whose signature differs from that of the first cycle: none if valid."""
    number = F.col(order) - start
    rows = spectra.where(number >= 0).withColumn("_slot", F.pmod(number, F.lit(length)))
    first = rows.where(number < length).select("_slot", F.col(signature).alias("_first"))
    return rows.join(F.broadcast(first), "_slot").where(F.col(signature) != F.col("_first")).drop("_slot", "_first")


def merge_boxes(df: DataFrame, keys: list[str], start: str, stop: str, order: list[str]) -> DataFrame:
    """Overlapping intervals of a key merged: (keys, start, stop, n)."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_box", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_box").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("n")).drop("_box")


def normalised_top(df: DataFrame, keys: list[str], value: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` highest rows per key, their values scaled to sum to one."""
    top = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), *order))).where(F.col("_rank") <= n).drop("_rank")
    return top.withColumn(value, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys))))
