"""Incremental results: runs that arrive one after the other, and event-time summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from peakloom.operators.ranking import keep_best
from peakloom.sources.tables import exists, write_runs


def keep_top(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], n: int) -> StreamingQuery:
    """Keep the first ``n`` rows per key over all batches, in versions under ``path``.

    A batch is merged with the newest version and written as the next one, so a repeated
    batch gives the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/version={number - 1}"
        rows = batch.unionByName(spark.read.parquet(before)) if exists(spark, before) else batch
        keep_best(rows, keys, order, n).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(stream: DataFrame, key: str, run: str, value: str, n: int) -> DataFrame:
    """Number, sum and ``n`` largest values of each key over a stream of runs, from state kept per key.

    Yields (key, n, total, top_runs, top_values) for every key that a batch touches; the newest
    row of a key stands for all runs so far, in whatever order they came. State per key is two
    numbers and ``n`` rows; a batch's rows of one key arrive in pieces, so none is held whole.
    Ties of values go to the smaller run. Null values count as rows but add nothing.
    """
    kind = dict(stream.dtypes)

    def step(name: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, total, runs, values = state.get if state.exists else (0, 0.0, [], [])
        top = list(zip(values, runs))
        for piece in pieces:
            known = piece.dropna(subset=[value])
            count, total = count + len(piece), total + float(known[value].sum())
            best = known.sort_values([value, run], ascending=[False, True]).head(n)
            top = sorted([*top, *zip(best[value].astype(float), best[run].astype(str))], key=lambda t: (-t[0], t[1]))[:n]
        values, runs = [float(t[0]) for t in top], [t[1] for t in top]
        state.update((count, total, runs, values))
        yield pd.DataFrame({key: [name[0]], "n": [count], "total": [total], "top_runs": [runs], "top_values": [values]})

    held = "n long, total double, top_runs array<string>, top_values array<double>"
    return stream.select(key, run, value).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind[key]}, {held}", held, "update", GroupStateTimeout.NoTimeout)


def process_runs(stream: DataFrame, search, path: str, checkpoint: str, run: str = "run") -> StreamingQuery:
    """Search each arriving run on its own and write its partition; a failed run is recorded and skipped."""

    def step(batch: DataFrame, number: int) -> None:
        for (name,) in batch.select(run).distinct().collect():
            try:
                write_runs(search(batch.where(F.col(run) == name)), path, run)
            except Exception as error:  # one run's failure must not stop the others
                note = batch.sparkSession.createDataFrame([(name, number, str(error)[:2000])], f"{run} string, batch long, error string")
                note.write.mode("append").json(f"{path}_failed")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, time: str, key: str, width: str, late: str | None = None) -> DataFrame:
    """Rows per key and window of event time; works on tables and, with ``late``, on streams."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """Sessions of each key: runs of rows less than ``gap`` apart."""
    out = events.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder as a stream, one file a batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
