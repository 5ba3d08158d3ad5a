"""Totals kept per key over a stream equal those of the whole table, in any order of runs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from peakloom.streaming import accumulate


def test_running_totals(spark, tmp_path):
    rng = np.random.default_rng(21)
    table = pd.DataFrame({"ion": rng.integers(0, 12, 400), "run": [f"r{i % 5}" for i in range(400)], "v": rng.integers(0, 50, 400).astype(float)})
    table.loc[rng.random(400) < 0.1, "v"] = np.nan
    want = {}
    for ion, rows in table.groupby("ion"):
        known = rows.dropna().sort_values(["v", "run"], ascending=[False, True]).head(3)
        want[ion] = (len(rows), rows.v.sum(), known.run.tolist(), known.v.tolist())
    for nth, order in enumerate(([0, 1, 2, 3, 4], [3, 0, 4, 2, 1])):
        source, sink = str(tmp_path / f"in{nth}"), str(tmp_path / f"out{nth}")
        for i in order:
            own = spark.createDataFrame(table[table.run == f"r{i}"]).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
            own.coalesce(1).write.mode("append").parquet(source)

        def save(batch, number, sink=sink):
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

        totals = accumulate.running_totals(accumulate.read_stream(spark, source), "ion", "run", "v", 3)
        totals.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / f"c{nth}")).trigger(availableNow=True).start().awaitTermination()
        seen = spark.read.parquet(sink)
        assert seen.agg(F.max("batch")).first()[0] == 4
        last = seen.groupBy("ion").agg(F.max_by(F.struct("n", "total", "top_runs", "top_values"), "batch").alias("s")).collect()
        assert {r["ion"]: tuple(r["s"]) for r in last} == want
