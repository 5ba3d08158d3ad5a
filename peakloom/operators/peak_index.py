"""Peaks kept in buckets of m/z, so that every extraction after the first reads them in place."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.sources.shared import Scratch


#: Peaks of a bucket, about; a task sorts the buckets that it writes and joins one by one.
BUCKET = 500_000


@dataclass
class PeakIndex:
    """A table of peaks bucketed by m/z bin and block of cycles, and sorted by them."""

    spark: SparkSession
    name: str
    ppm: float
    cycles: int
    last_block: int

    @property
    def peaks(self) -> DataFrame:
        """The table: mz_bin, block and the peaks' own columns."""
        return self.spark.table(self.name)

    def near(self, wanted: DataFrame, value: str, *, ppm: float) -> DataFrame:
        """Pairs of a peak and a row of ``wanted`` whose ``value`` it is at most ``ppm`` away from.

        Rows of ``wanted`` are listed in the bins that their tolerance touches (one or two, unless
        it is wider than the index's) and in the blocks between first_cycle and last_cycle where
        they have these. Only they are shuffled; the buckets of the table are read as they lie.
        """
        step, width = math.log1p(2 * self.ppm * 1e-6), F.col(value) * ppm * 1e-6
        bins = F.sequence(F.floor(F.log(F.col(value) - width) / step), F.floor(F.log(F.col(value) + width) / step))
        limited = "first_cycle" in wanted.columns
        block = lambda c: F.least(F.greatest(F.floor(F.col(c) / self.cycles), F.lit(0)), F.lit(self.last_block))
        blocks = F.sequence(block("first_cycle"), F.greatest(block("first_cycle"), block("last_cycle"))) if limited else F.sequence(F.lit(0), F.lit(self.last_block))
        spread = wanted.withColumn("mz_bin", F.explode(bins)).withColumn("block", F.explode(blocks.cast("array<int>")))
        pairs = self.peaks.join(spread, ["mz_bin", "block"]).where(F.abs(F.col("mz") - F.col(value)) <= width)
        return (pairs.where(F.col("cycle").between(F.col("first_cycle"), F.col("last_cycle"))) if limited else pairs).drop("mz_bin", "block")

    def drop(self) -> None:
        """Forget the table; its files go with the scratch folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def build_index(peaks: DataFrame, *, ppm: float = 25.0, cycles: int = 512, buckets: int | None = None) -> PeakIndex:
    """Index of ``peaks`` (cycle, mz, intensity, ...), for tolerances about ``ppm``.

    Bins are twice the tolerance wide. A bin that many peaks share (a contaminant seen in every
    spectrum) is spread over the blocks of ``cycles`` cycles, which also lets an extraction with
    time limits skip what it need not read. The one shuffle of the peaks is here; unless told,
    buckets are as many as keep each at about BUCKET peaks. Peaks without a positive m/z, or
    without a cycle, are left out.
    """
    spark = peaks.sparkSession
    scratch = Scratch(spark, "peaks")
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-peaks.count() // BUCKET))
    step = math.log1p(2 * ppm * 1e-6)
    placed = peaks.where("mz > 0 AND cycle IS NOT NULL").withColumns({"mz_bin": F.floor(F.log("mz") / step), "block": F.greatest(F.floor(F.col("cycle") / cycles), F.lit(0)).cast("int")})
    name = f"peaks_{uuid.uuid4().hex[:12]}"
    dealt = placed.repartition(buckets, "mz_bin", "block")  # one file per bucket
    dealt.write.bucketBy(buckets, "mz_bin", "block").sortBy("mz_bin", "block", "mz").option("path", f"{scratch.root}/index").format("parquet").saveAsTable(name)
    last = spark.table(name).agg(F.max("block")).first()[0]
    return PeakIndex(spark, name, ppm, cycles, last or 0)
