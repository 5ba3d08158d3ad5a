"""Shared evidence: greedy set cover of precursors by protein ids."""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.sources.shared import Scratch

from .ranking import dense_groups, keep_best


def greedy_cover(sets: list[tuple[int, list, int]], first: dict | None = None) -> dict:
    """Master id of each set (key, ids in order, weight), by repeated choice of the largest id.

    The id with the most uncovered weight is taken; ties go to the smallest ``first`` (the
    order of first sight where none is given). Its sets leave; they come out in the order of choice.
    """
    members: dict = {i: {} for i in sorted(first or (), key=(first or {}).get)}
    for key, ids, weight in sets:
        for i in ids:
            members.setdefault(i, {})[key] = weight
    ids_of = {key: ids for key, ids, _ in sets}
    left = {i: sum(m.values()) for i, m in members.items()}
    heap = [(-w, place, i) for place, (i, w) in enumerate(left.items())]  # dictionaries keep the order of first sight
    heapify(heap)
    out: dict = {}
    while heap:
        weight, place, best = heappop(heap)
        if left[best] <= 0:
            continue
        if -weight > left[best]:  # weights only fall: it waits with the present one
            heappush(heap, (-left[best], place, best))
            continue
        for key in [k for k in members[best] if k not in out]:
            out[key] = best
            for i in ids_of[key]:
                left[i] -= members[i][key]
    return out


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Masters (part, key, num, n) of one part's pairs (part, key, num, n), in the order of choice."""
    sets = pdf.sort_values(["key", "num"], kind="stable").groupby("key", sort=True).agg(ids=("num", list), n=("n", "first"))
    masters = greedy_cover(list(zip(sets.index.tolist(), sets["ids"], sets["n"].tolist())), {i: i for i in pdf["num"].unique().tolist()})
    return pd.DataFrame({"part": pdf["part"].iloc[0], "key": list(masters), "num": list(masters.values()), "n": sets["n"].loc[list(masters)].to_numpy()})


def _choices(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ids (part, nth, num, w) that cover one part's pairs, in the order of choice, with what each takes."""
    taken = _solve(pdf).groupby("num", sort=False)["n"].sum()
    return pd.DataFrame({"part": pdf["part"].iloc[0], "nth": range(len(taken)), "num": taken.index, "w": taken.to_numpy()})


#: Candidates in the first round of _leaders, and the fewest and most in a later one.
FIRST, LEAST, MOST = 64, 14, 4096


def _candidates(left: DataFrame, top: list[int], most: int, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """Sets of ``left`` cut to the ids ``top``, equal ones as one (part, ids, n), the ids used and the pairs.

    Of more than ``most`` pairs only those of fewer, the largest, ids are kept.
    """
    cut, used = left, len(top)
    while True:
        before, inside = cut, ",".join(f"{i}L" for i in top[:used])
        cut = scratch.save(before.select("part", "n", F.expr(f"filter(ids, x -> x IN ({inside}))").alias("ids")).where("size(ids) > 0").groupBy("part", "ids").agg(F.sum("n").alias("n")))
        if before is not left:
            scratch.drop(before)
        pairs = cut.agg(F.sum(F.size("ids"))).first()[0]
        if pairs <= most or used <= LEAST:
            return cut, used, pairs
        used = max(used // 2, LEAST)


def _overtaken(weights: DataFrame, losses: DataFrame, order: dict, start: dict) -> dict:
    """By part, the first place of the order at which an id outside it is larger; parts without one are absent.

    ``order`` holds (num, weight when chosen) by part, ``start`` the place of a part's first.
    An id keeps its weight from one loss to the next, and weights in the order fall: a search in
    them gives the first place where such a stretch of an id comes before the one chosen.
    """
    wide = max(num for chosen in order.values() for num, _ in chosen) + 3
    levels = {part: np.unique([-w for _, w in chosen]) for part, chosen in order.items()}
    keys = {part: np.searchsorted(levels[part], [-w for _, w in chosen]) * wide + [num + 1 for num, _ in chosen] for part, chosen in order.items()}

    @F.pandas_udf("long")
    def place_of(part: pd.Series, w: pd.Series, num: pd.Series) -> pd.Series:
        out = np.full(len(part), -1, dtype=np.int64)
        for p, key in keys.items():
            rows = (part == p).to_numpy()
            falling, level = -w[rows].to_numpy(), levels[p]
            at = np.searchsorted(level, falling)
            tied = level[np.minimum(at, len(level) - 1)] == falling
            place = np.searchsorted(key, at * wide + np.where(tied, np.minimum(num[rows].to_numpy() + 1, wide - 1), 0), side="right")
            out[rows] = np.where(place < len(key), start[p] + place, -1)
        return pd.Series(out)

    near = weights.where(reduce(lambda a, b: a | b, ((F.col("part") == part) & (F.col("w") >= chosen[-1][1]) for part, chosen in order.items())))
    steps = near.withColumns({"place": F.lit(-1), "lost": F.lit(0).cast("long")}).unionByName(near.join(losses, ["part", "num"]))
    each = Window.partitionBy("part", "num").orderBy("place")
    held = steps.select("part", "num", "place", (F.col("w") - F.sum("lost").over(each)).alias("now"), F.lead("place").over(each).alias("until"))
    larger = held.where("now > 0").withColumn("at", place_of("part", "now", "num")).where("at >= 0").withColumn("at", F.greatest("at", F.col("place") + 1))
    found = larger.where("until IS NULL OR at <= until").groupBy("part").agg(F.min("at").alias("at")).collect()
    return {r["part"]: r["at"] for r in found if r["at"] < start[r["part"]] + len(order[r["part"]])}


def _leaders(left: DataFrame, size: int, most: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Masters (part, key, num) of the sets (part, key, n, ids) that ids take in order, until ``most`` pairs are left, and the sets left.

    The largest ids are a round's candidates. Sets cut to them, equal ones as one, are few, and
    give the order of the candidates as if there were no other ids. What each choice takes from every id
    shows the first one that an id outside comes before; the choices before it stand, at least one in a part.
    """
    spark, kind, count, done = left.sparkSession, dict(left.dtypes)["part"], FIRST, []
    weights = scratch.save(left.select("part", "n", F.explode("ids").alias("num")).groupBy("part", "num").agg(F.sum("n").alias("w")))
    held = left
    while size > most:
        top = [r["num"] for r in weights.orderBy(F.desc("w"), "num").limit(count).collect()]
        cut, used, pairs = _candidates(left, top, most, scratch)
        count = used if used < len(top) else min(2 * used, MOST) if 4 * pairs < most else len(top)
        rows = cut.withColumn("key", F.monotonically_increasing_id()).select("part", "key", F.explode("ids").alias("num"), "n")
        chosen = rows.groupBy("part").applyInPandas(_choices, f"part {kind}, nth long, num long, w long").collect()  # candidates
        order, start = {}, {}
        for place, r in enumerate(chosen := sorted(chosen, key=lambda r: (r["part"], r["nth"]))):
            start.setdefault(r["part"], place)
            order.setdefault(r["part"], []).append((r["num"], r["w"]))
        nums = ",".join(f"{r['num']}L" for r in chosen)
        place = F.expr(f"cast(array_min(transform(filter(ids, x -> x IN ({nums})), x -> array_position(array({nums}), x))) as int) - 1")
        marked = scratch.save(left.withColumn("place", place))
        losses = scratch.save(marked.where("place IS NOT NULL").select("part", "n", "place", F.explode("ids").alias("num")).groupBy("part", "num", "place").agg(F.sum("n").alias("lost")))
        ends = {part: start[part] + len(order[part]) for part in order} | _overtaken(weights, losses, order, start)
        stands = F.coalesce(reduce(lambda a, b: a | b, ((F.col("part") == part) & (F.col("place") < end) for part, end in ends.items())), F.lit(False))
        done.append(scratch.save(marked.where(stands).select("part", "key", F.expr(f"element_at(array({nums}), place + 1)").alias("num"))))
        gone = losses.where(stands).groupBy("part", "num").agg(F.sum("lost").alias("lost"))
        fewer = scratch.save(weights.join(gone, ["part", "num"], "left").select("part", "num", (F.col("w") - F.coalesce("lost", F.lit(0))).alias("w")).where("w > 0"))
        scratch.drop(held, cut, losses, weights)
        held, weights, left = marked, fewer, marked.where(~stands).drop("place")
        size = left.agg(F.sum(F.size("ids"))).first()[0] or 0
    return done, left


def cover(sets: DataFrame, *, most: int = 250_000) -> DataFrame:
    """Masters (part, key, master) of ``sets`` (part, key, list, n), as greedy_cover chooses them in each part.

    In a round, every id that is the largest in all of its uncovered sets takes them: weights
    only fall, so it would be taken before any id that shares a set with it. Where this settles
    less than a tenth of what is left, because ids share sets all over, or where ids are few, the
    largest ids are taken in order, many a round. A key names one set of its part. Once ``most``
    pairs of set and id are left, one task per part takes the rest in order.
    """
    scratch = Scratch(sets.sparkSession, "cover")
    pairs = scratch.save(sets.select("part", "key", "n", F.posexplode(F.array_distinct("list")).alias("pos", "id")))
    seen = pairs.groupBy("part", "id").agg(F.min_by("pos", "key").alias("pos"), F.min("key").alias("key"))
    names = scratch.save(dense_groups(seen, ["key", "pos", "part"], "num").select("part", "id", "num"))  # in the order of first sight
    left = scratch.save(pairs.join(names, ["part", "id"]).select("part", "key", "num", "n"))
    scratch.drop(pairs)
    done, size, few = [], left.count(), names.count() <= MOST
    while size > most:
        if few:
            lists = scratch.save(left.groupBy("part", "key").agg(F.first("n").alias("n"), F.collect_list("num").alias("ids")))
            scratch.drop(left)
            more, rest = _leaders(lists, size, most, scratch)
            done += more
            left = rest.select("part", "key", F.explode("ids").alias("num"), "n")
            break
        weights = left.groupBy("part", "num").agg(F.sum("n").alias("w"))
        top = scratch.save(left.join(weights, ["part", "num"]).groupBy("part", "key").agg(F.max_by("num", F.struct("w", -F.col("num"))).alias("best")))
        taken = left.join(top, ["part", "key"]).groupBy("part", F.col("num").alias("best")).agg(F.every(F.col("num") == F.col("best")).alias("all")).where("all")
        found = scratch.save(top.join(taken.select("part", "best"), ["part", "best"], "left_semi").select("part", "key", F.col("best").alias("num")))
        done.append(found)
        before, left = left, scratch.save(left.join(found, ["part", "key"], "left_anti"))
        scratch.drop(before, top)
        before, size = size, left.count()
        few = size > 0.9 * before
    kind = dict(left.dtypes)["part"]
    last = left.groupBy("part").applyInPandas(_solve, f"part {kind}, key long, num long, n long").select("part", "key", "num")  # at most ``most`` rows
    return reduce(DataFrame.union, done, last).join(names, ["part", "num"]).select("part", "key", F.col("id").alias("master"))


def infer_groups(df: DataFrame, *, idx: str = "precursor_idx", ids: str = "proteins", decoy: str = "decoy", strategy: str = "heuristic", most: int = 250_000) -> DataFrame:
    """Add pg_master and pg to rows of (idx, ids joined by ;, decoy).

    Targets and decoys are covered apart. Precursors with the same ids are one weighted set.
    Strategy heuristic gives pg the row's ids that are masters of targets or decoys;
    maximum_parsimony gives it the master; library keeps the ids.
    """
    if strategy not in ("library", "maximum_parsimony", "heuristic"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "library":
        return df.withColumn("pg_master", F.col(ids)).withColumn("pg", F.col(ids))
    scratch = Scratch(df.sparkSession, "grouping")
    df = scratch.save(df)
    one = keep_best(df.select(idx, ids, decoy), [idx], [ids])
    sets = scratch.save(one.groupBy(ids, F.col(decoy).alias("part")).agg(F.min(idx).cast("long").alias("key"), F.count("*").alias("n")).withColumn("list", F.split(ids, ";")))
    masters = cover(sets, most=most)
    solved = scratch.save(sets.join(masters, ["part", "key"]).select(F.col(ids), F.col("part").alias(decoy), F.col("master").alias("pg_master")))
    if strategy == "maximum_parsimony":
        return df.join(solved, [ids, decoy], "left").withColumn("pg", F.col("pg_master"))
    masters = solved.select(F.col("pg_master").alias("id")).distinct()
    named = (
        solved.select(ids).withColumn("id", F.explode(F.split(ids, ";"))).join(masters, "id")
        .groupBy(ids).agg(F.array_join(F.array_sort(F.collect_set("id")), ";").alias("pg"))
    )
    return df.join(solved, [ids, decoy], "left").join(named, ids, "left")
