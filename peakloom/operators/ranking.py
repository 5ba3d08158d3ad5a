"""Ordered operators: q-values, best rows per key, top rows, group numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.sources.shared import Scratch

#: Stands for a ratio whose denominator is zero.
NO_TARGET = 1e18


def ordered_blocks(df: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` in range partitions of ``keys``, written once, with the partition's number in _block.

    Running totals over a whole table then need a window per block and one row of totals per
    block, not one task for all rows. The keys should be unique, so that ties can be split.
    """
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(blocks, *keys).withColumn("_block", F.spark_partition_id())
    return Scratch(spark, "ordered").save(ranged)


def q_values(df: DataFrame, score: str, decoy: str, ties: list[str], *, scale: float = 1.0, epsilon: float = 0.0, out: str = "qval") -> DataFrame:
    """Target-decoy q-values: the least ratio of decoys to targets at this score or a worse one.

    Rows are ordered by score (smaller is better), decoy and ``ties``; the ratio of running
    counts is ``scale * decoys / (targets + epsilon)``, and NO_TARGET while no target came.
    Both running passes work on range blocks of the order with totals per block, and take time
    in proportion to a block's rows: the least ratio runs from the worst row up.
    """
    keys = [score, decoy, *ties]
    rows = ordered_blocks(df, keys)
    order = Window.partitionBy("_block").orderBy(*keys)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_block").agg(F.sum(decoy).alias("_d"), F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    totals = totals.select("_block", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    counted = rows.join(F.broadcast(totals), "_block").withColumn("_d", F.col("_d0") + F.sum(decoy).over(upto)).withColumn("_t", F.col("_n0") + F.count("*").over(upto) - F.col("_d"))
    ratio = F.when(F.col("_t") + epsilon == 0, NO_TARGET).otherwise(scale * F.col("_d") / (F.col("_t") + epsilon))
    counted = counted.withColumn("_ratio", ratio)
    after = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    least = counted.groupBy("_block").agg(F.min("_ratio").alias("_m")).select("_block", F.min("_m").over(after).alias("_after"))
    onward = Window.partitionBy("_block").orderBy(*(F.desc(k) for k in keys)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(F.broadcast(least), "_block").withColumn(out, F.least(F.min("_ratio").over(onward), F.coalesce("_after", F.lit(NO_TARGET))))
    return ranked.drop("_block", "_d0", "_n0", "_d", "_t", "_ratio", "_after")


def quantiles(df: DataFrame, value: str | Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles of the known values, linear between neighbours; nulls if there are none.

    The ranks that matter are found from the sizes of range blocks, so no task holds a whole
    column or its distinct values.
    """
    column = F.col(value) if isinstance(value, str) else value
    rows = ordered_blocks(df.select(column.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)"), ["_v"])
    sizes = sorted((r["_block"], r["n"]) for r in rows.groupBy("_block").agg(F.count("*").alias("n")).collect())  # one row per block
    total = sum(n for _, n in sizes)
    if not total:
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    wanted, before = [], 0
    for block, n in sizes:
        wanted += [(block, r - before + 1, r) for r in ranks if before <= r < before + n]
        before += n
    asked = df.sparkSession.createDataFrame(wanted, "_block int, _i int, rank long")  # two rows a share
    near = rows.join(F.broadcast(asked.select("_block").distinct()), "_block").withColumn("_i", F.row_number().over(Window.partitionBy("_block").orderBy("_v")))
    at = {r["rank"]: r["_v"] for r in near.join(F.broadcast(asked), ["_block", "_i"]).select("rank", "_v").collect()}
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def keep_best(df: DataFrame, keys: list[str], order: list[str | Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, which should end with a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def top_rows(df: DataFrame, order: list[str | Column], n: int, where: Column | None = None) -> DataFrame:
    """The first ``n`` rows of those that pass ``where``, in ``order``: a top-k over partial top-ks."""
    return (df if where is None else df.where(where)).orderBy(*order).limit(n)


def rank_or_quality(df: DataFrame, keys: list[str], order: list[str | Column], n: int, good: Column) -> DataFrame:
    """Rows among the first ``n`` of their key, or that are ``good`` by themselves."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where((F.col("_rank") <= n) | good).drop("_rank")


def dense_groups(df: DataFrame, keys: list[str], out: str = "group_id") -> DataFrame:
    """Numbers from 0 of the distinct values of ``keys``, in their order.

    Distinct keys are numbered by range blocks and block totals, then joined back.
    """
    distinct = ordered_blocks(df.select(*keys).distinct(), keys)
    totals = distinct.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    number = F.row_number().over(Window.partitionBy("_block").orderBy(*keys)) - 1
    numbered = distinct.withColumn("_i", number).join(F.broadcast(totals), "_block").select(*keys, (F.col("_n0") + F.col("_i")).cast("long").alias(out))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = df.alias("a").join(numbered.alias("b"), [c for c in same] if len(same) > 1 else same[0])
    return joined.select("a.*", f"b.{out}")


def prefix_below(df: DataFrame, value: str, limit: float, order: list[str]) -> DataFrame:
    """Rows that come before the first row whose ``value`` reaches ``limit``; all rows if none does."""
    first = df.where(F.col(value) >= limit).agg(F.min(F.struct(*order)).alias("_first"))
    # one row of the first key; a global aggregate, so the join is with a scalar
    return df.join(F.broadcast(first), F.col("_first").isNull() | (F.struct(*order) < F.col("_first"))).drop("_first")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with a repeatable random order of its keys in _order."""
    return df.withColumn("_order", F.xxhash64(key, F.lit(seed)))
