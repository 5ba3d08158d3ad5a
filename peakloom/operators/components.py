"""Connected components by repeated contraction, with tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.sources.shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of ``edges`` (u, v: long) with ``component_id``, the smallest node reachable.

    Each round ranks nodes by a seeded hash; every node moves to the first-ranked of itself
    and its neighbours, and edges are rewritten to the new nodes, self loops and repeats
    dropped. Random ranks shrink any graph, chains too, by a constant share a round, so there
    are O(log n) rounds on ever smaller tables. A node with many neighbours costs one
    partially aggregated minimum and a join that adaptive execution can split. Null ends and
    self loops are dropped; no edges give no rows.
    """
    edges = scratch.save(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    maps = []
    step = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        key = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        first = both.groupBy("u").agg(F.min(key("v")).alias("m")).select("u", F.least("m", key("u"))["id"].alias("to"))
        first = scratch.save(first)
        maps.append(first)
        moved = (
            edges.join(first.withColumnRenamed("to", "a"), "u")
            .join(first.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
            .where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct()
        )
        after = scratch.save(moved)
        scratch.drop(edges)
        edges, step = after, step + 1
    scratch.drop(edges)
    if not maps:
        return edges.sparkSession.createDataFrame([], "u long, component_id long")
    # Maps are joined from the last one back, each far smaller than the one before it: a node that
    # has left the graph never comes back, so the map of the next round names all that go on.
    label = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = label.select(F.col("u").alias("to"), F.col("to").alias("next"))
        label = earlier.join(later, "to", "left").select("u", F.coalesce("next", "to").alias("to"))
    label = scratch.save(label)
    scratch.drop(*maps)
    least = label.groupBy("to").agg(F.min("u").alias("component_id"))
    return label.join(least, "to").select("u", "component_id")
