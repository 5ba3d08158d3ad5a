"""Spectra and peaks, and protein sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.operators.signal import cycle_length, cycle_start

#: Spectra from whose signatures the cycle is found.
HEAD = 2000


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Proteins of a FASTA file: (protein, description, sequence)."""
    entry = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", "\r?\n")
    head = F.element_at(lines, 1)
    parts = F.split(head, r"\s+", 2)
    name = F.when(parts[0].contains("|"), F.split(parts[0], r"\|")[1]).otherwise(parts[0])
    return entry.select(name.alias("protein"), F.coalesce(F.get(parts, 1), F.lit("")).alias("description"), F.array_join(F.slice(lines, 2, F.size(lines)), "").alias("sequence"))


def regular_ms1(spectra: DataFrame) -> bool:
    """Whether MS1 spectra follow each other at one distance."""
    gap = F.col("spec_idx") - F.lag("spec_idx").over(Window.partitionBy("run").orderBy("spec_idx"))
    return spectra.where("ms_level = 1").select("run", gap.alias("gap")).where("gap IS NOT NULL").select("gap").distinct().limit(2).count() <= 1


def preprocess(spectra: DataFrame) -> DataFrame:
    """Drop irregular MS1 spectra and what precedes the first cycle; seconds and cycle numbers.

    ``spectra`` has spec_idx, rt in minutes, ms_level, isolation_lower_mz and
    isolation_upper_mz of one run. The cycle is found from the first HEAD signatures.
    """
    rows = spectra if regular_ms1(spectra.withColumn("run", F.lit(0))) else spectra.where("ms_level > 1")
    signature = F.round(F.coalesce("isolation_lower_mz", F.lit(0.0)) + F.coalesce("isolation_upper_mz", F.lit(0.0)), 3)
    head = [r[0] for r in rows.orderBy("spec_idx").limit(HEAD).select(signature).collect()]
    length = cycle_length(head)
    start = cycle_start(head, length)
    if start < 0:
        raise ValueError("no repeating cycle found")
    first = rows.orderBy("spec_idx").limit(start + 1).agg(F.max("spec_idx")).first()[0]
    kept = rows.where(F.col("spec_idx") >= first).withColumn("rt", F.col("rt") * 60)
    place = F.col("spec_idx") - first
    return kept.withColumn("cycle", F.floor(place / length)).withColumn("slot", F.pmod(place, F.lit(length)))


def run_statistics(spectra: DataFrame) -> DataFrame:
    """Limits of a run: time range, mean cycle duration, number of cycles, MS2 range."""
    cycles = spectra.groupBy("cycle").agg(F.min("rt").alias("t"))
    whole = cycles.agg(F.count("*").alias("n_cycles"), F.try_divide(F.max("t") - F.min("t"), F.count("*") - 1).alias("cycle_duration"))
    ms2 = F.col("ms_level") > 1
    ends = spectra.agg(F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"), F.min(F.when(ms2, F.col("isolation_lower_mz"))).alias("ms2_min"), F.max(F.when(ms2, F.col("isolation_upper_mz"))).alias("ms2_max"))
    return ends.join(F.broadcast(whole))  # both are one row


def round_window(cycle_start: int, cycle_stop: int, last: int, *, least: int = 32, step: int = 16) -> tuple[int, int]:
    """Widen a range of cycles to a multiple of ``step`` of at least ``least``, inside [0, last]."""
    size = max(least, -(-(cycle_stop - cycle_start) // step) * step)
    stop = min(cycle_start + size, last)
    return max(0, min(cycle_start, stop - size)), stop
