"""Hard-negative mining: blocked products of anchors and candidates, kept as mergeable top lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches

#: Anchors that meet a batch of candidates in one product, and rows of such a batch.
TILE, ROWS = 1024, 2048
#: Bytes of anchors, and anchors, that one pass over the candidates broadcasts at most.
PASS_BYTES, PASS_ANCHORS = 8 << 20, 16_384
#: Marks a score that isn't admitted.
NONE = np.iinfo(np.int64).min


def dense(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of the sound rows of a batch, for each length of vector.

    Components are ``floor(scale * x)`` as doubles. Rows with a null id, label or vector, without
    components, or with a null or non-finite one are left out.
    """
    v = batch.column("embedding")
    known = ~(np.asarray(v.is_null()) | np.asarray(batch.column("vec_id").is_null()) | np.asarray(batch.column("label").is_null()))
    picked = batch.filter(pa.array(known)) if not known.all() else batch
    v = picked.column("embedding")
    lengths = np.asarray(v.value_lengths(), np.int64)
    flat = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    ids, labels = (picked.column(c).cast(pa.int64()).to_numpy() for c in ("vec_id", "label"))
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        x = flat.reshape(-1, d) if len(rows) == len(lengths) else flat[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(1)
        yield ids[rows][good], labels[rows][good], np.floor(scale * x[good])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two matrices of whole numbers.

    A float64 product is exact while every partial sum stays below 2^53, which the largest
    components bound; beyond that, Python's integers are summed. A product that no 64-bit integer
    holds is an OverflowError.
    """
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object)
    return (whole(a) @ whole(b).T).astype(np.int64)


class Best:
    """The first ``k`` (score, id) of each of ``n`` lists: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.zeros((n, k), np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge a row of scores for each list; NONE is no offer."""
        k = self.k
        hits = (score >= self.score[:, -1:]) & (score != NONE)
        many = np.flatnonzero(hits.sum(1) > k)
        if len(many):  # only what reaches the row's own k-th best can enter
            part = np.where(hits[many], score[many], NONE)
            hits[many] &= part >= np.partition(part, part.shape[1] - k, axis=1)[:, [-k]]
        r, c = np.nonzero(hits)
        if not len(r):
            return
        some = np.unique(r)
        rows = np.concatenate([r, np.repeat(some, k)])
        s = np.concatenate([score[r, c], self.score[some].ravel()])
        i = np.concatenate([ids[c], self.id[some].ravel()])
        order = np.lexsort((i, -s.clip(NONE + 1), rows))
        rows, s, i = rows[order], s[order], i[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = rank < k
        self.score[rows[first], rank[first]] = s[first]
        self.id[rows[first], rank[first]] = i[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all that is held."""
        n, at = np.nonzero(self.score != NONE)
        return n, self.score[n, at], self.id[n, at]


def anchors_of(rows: DataFrame, scale: float) -> DataFrame:
    """Distinct sound anchors (anchor_id, label, vector as bytes, dims, norm, copies), each with a number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, x in dense(batch, scale):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(labels), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array([int(products(r[None], r[None])[0, 0]) for r in x], pa.int64())],
                    ["anchor_id", "label", "vector", "dims", "norm"],
                )

    found = rows.mapInArrow(read, "anchor_id long, label long, vector binary, dims int, norm long")
    return found.groupBy("anchor_id", "label", "vector", "dims", "norm").agg(F.count("*").alias("copies")).withColumn("anchor", F.monotonically_increasing_id())


def top_lists(rows: DataFrame, anchors: DataFrame, k: int, scale: float, scratch: Scratch, share: tuple[int, int] | None = None) -> DataFrame:
    """(anchor, mark, score, vec_id): the first ``k`` rows of each list of each anchor.

    Without ``share``, an anchor has one list, of rows with its own label. With it, it has one
    per score of its ``marks``: rows of other labels whose score is from the first to the second
    of ``share`` hundredths of that mark. Anchors are broadcast block by block; a task multiplies
    its candidates with one block, batch by batch, and returns its own top lists, so that a pass
    shuffles ``k`` rows per list and task.
    """
    spark = rows.sparkSession
    total = anchors.agg(F.count("*").alias("n"), F.coalesce(F.max("dims"), F.lit(1)).alias("dims")).first()
    size = max(1, min(PASS_ANCHORS, PASS_BYTES // (8 * total["dims"])))
    blocks = -(-total["n"] // size)
    # Written in order of blocks, so that a pass reads the files of its own alone.
    dealt = scratch.save(anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(max(1, blocks))).cast("int")).repartitionByRange(max(1, blocks), "block"))
    found = []
    for block in range(blocks):
        held = [tuple(r) for r in dealt.where(F.col("block") == block).select("anchor", "label", "dims", "vector", "marks").toLocalIterator()]
        if held:
            sent = spark.sparkContext.broadcast(held)
            lists = rows.mapInArrow(_lists(sent, k, scale, share), "anchor long, mark long, score long, vec_id long")
            order = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), "vec_id")
            found.append(scratch.save(lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)))
            sent.unpersist()
    scratch.drop(dealt)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "anchor long, mark long, score long, vec_id long, place int")


def _lists(sent, k: int, scale: float, share: tuple[int, int] | None):
    """Task that multiplies a broadcast block of anchors with its candidates."""
    least, most = NONE + 1, np.iinfo(np.int64).max

    def window(mark: int) -> tuple[int, int]:
        lo, hi = (least, most) if share is None else (-(-mark * share[0] // 100), mark * share[1] // 100)
        return max(lo, least), min(hi, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = []
        for d in sorted({a[2] for a in sent.value}):
            own = [a for a in sent.value if a[2] == d]
            for part in (own[at : at + TILE] for at in range(0, len(own), TILE)):
                names, labels = np.array([a[0] for a in part]), np.array([a[1] for a in part])
                x = np.frombuffer(b"".join(a[3] for a in part)).reshape(-1, d)
                lists = []
                for slot in range(max(len(a[4]) for a in part)):
                    some = np.array([i for i, a in enumerate(part) if len(a[4]) > slot])
                    marks = [part[i][4][slot] for i in some]
                    lists.append((some, np.array(marks), np.array([window(m) for m in marks], np.int64), Best(len(some), k)))
                tiles.append((names, labels, x, lists))
        for batch in batches:
            for ids, labels, y in dense(batch, scale):
                for _, own, x, lists in tiles:
                    if x.shape[1] == y.shape[1]:
                        s = products(x, y)
                        s[(own[:, None] == labels[None, :]) != (share is None)] = NONE
                        for some, _, bounds, best in lists:
                            part = s if len(some) == len(s) else s[some]
                            best.offer(np.where((part >= bounds[:, :1]) & (part <= bounds[:, 1:]), part, NONE), ids)
        for names, _, _, lists in tiles:
            for some, marks, _, best in lists:
                n, score, ids = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (names[some[n]], marks[n], score, ids)], ["anchor", "mark", "score", "vec_id"])

    return run


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10, scale: float = 256.0, share: tuple[int, int] = (30, 90)
) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, label, embedding) that ``is_anchor`` picks.

    A row's score is its inner product with the anchor over ``floor(scale * x)``, in whole
    numbers. An anchor's positives are its first ``positives`` other rows of the same label,
    higher scores first and ties by smaller vec_id. Returns for each anchor and positive the
    first ``negatives`` rows of another label that score from the first to the second of
    ``share`` hundredths of the positive's score: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Two passes over the rows for each block of anchors: one for the positives, one for the
    windows that their scores give. Blocks are bounded in bytes and number, so a broadcast does
    not grow with the data; what grows with the number of anchors is the number of passes.

    Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component
    take no part. Vectors of different lengths have no score. Repeated rows are rows of their
    own: an anchor's copy is one of its positives, and each copy of an anchor gets its own rows.
    Of rows with equal vec_id and score any one may be named. An empty table gives no rows. Extra
    columns are ignored. A score beyond 64 bits is an error.
    """
    scratch = Scratch(vectors.sparkSession, "negatives")
    known = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = known.select("vec_id", "label", "embedding")
    with arrow_batches(vectors.sparkSession, ROWS):
        anchors = scratch.save(anchors_of(known.where(is_anchor).select("vec_id", "label", "embedding"), scale))
        # One more than asked: the anchor's own row is among its first ones, or behind them all.
        first = top_lists(rows, anchors.withColumn("marks", F.array(F.lit(0).cast("long"))), positives + 1, scale, scratch)
        own = (F.col("vec_id") == F.col("anchor_id")) & (F.col("score") == F.col("norm"))
        order = F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", own.alias("own"))))
        lists = first.join(anchors.select("anchor", "anchor_id", "norm"), "anchor").groupBy("anchor").agg(order.alias("all"))
        self_at = F.array_position(F.transform("all", lambda r: r["own"]), True)  # 0: not there
        others = F.filter("all", lambda r, i: i + 1 != F.col("self_at"))
        found = scratch.save(lists.withColumn("self_at", self_at).select("anchor", F.slice(others, 1, positives).alias("positives")))
        marks = found.select("anchor", F.array_sort(F.array_distinct(F.transform("positives", lambda r: r["score"]))).alias("marks"))
        second = top_lists(rows, anchors.join(marks, "anchor"), negatives, scale, scratch, share)
    pairs = found.join(anchors, "anchor").select("anchor", "anchor_id", "copies", F.posexplode("positives").alias("nth", "p"))
    pairs = pairs.select("anchor", "anchor_id", "copies", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("mark"))
    mined = pairs.join(second, ["anchor", "mark"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return mined.select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("mark").alias("positive_score"), F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, among all vectors.

    Ids divisible by 7 get the next of ten labels first: these are the mislabelled rows of the contract.
    """
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", shifted)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH sound AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r AS r, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM sound a JOIN sound c ON a.r <> c.r AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 10
"""
