"""N-gram Jaccard join: exact links between documents by blocked sparse products."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.operators.components import connected_components

from .common import SPACE, Scratch, arrow_batches, by_bytes, grams, hash_words, mix, texts_of, tune

#: Shingles are counted in blocks of this many; those repeated inside a block add up.
COUNTED = 4_000_000
#: A shingle with such a count or more is frequent; so are at most FREQUENT shingles.
LEAST, FREQUENT = 8, 1_000_000
#: Documents that share a prefix shingle are paired up to this many, and multiplied in blocks beyond.
PAIRED = 16
#: Pairs whose tallies are compared at once.
THINNED = 4096
#: Sets of a block, about.
ROWS = 2048


def shingle_sets(batch: pa.RecordBatch, n: int, *keys: str) -> Iterator[tuple]:
    """Rows (keys..., sorted distinct shingle hashes) of a batch of texts."""
    for rows in by_bytes(texts_of(batch, *keys)):
        h, of, _, _ = hash_words([r[-1] for r in rows], SPACE)
        cuts = np.searchsorted(of, np.arange(len(rows) + 1))
        for i, row in enumerate(rows):
            yield (*row[:-1], np.unique(grams(h[cuts[i] : cuts[i + 1]], n)))


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set in one order for all sets: frequent ones last, by their ``counts``, else by hash.

    Two sets that reach Jaccard ``percent`` / 100 share at least that part of each, so with
    one order for all they share one of their first ``n - ceil(percent n / 100) + 1`` shingles.
    """
    size = len(s) - -(-percent * len(s) // 100) + 1
    s = s[np.argsort(mix(s), kind="stable")]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        common = frequent[at] == s
        last = s[common] if counts is None else s[common][np.argsort(counts[at[common]], kind="stable")]
        s = np.concatenate([s[~common], last])
    return s[:size]


def tally(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall to each of some hash buckets; a power of two, 4 to 8 a bucket."""
    buckets = 1 << max(2, len(s).bit_length() - 3)
    return np.minimum(np.bincount((mix(s) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8)


def may_link(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """False if the tallies show that two sets of sizes n and m differ in too many shingles."""
    return bool(pairs_reach([a], [b], np.array([n]), np.array([m]), percent)[0])


def pairs_reach(a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (a[i], b[i]) of sets may reach the bound; as tallies_reach, pair by pair.

    Pairs whose tallies have the same two lengths are compared at once.
    """
    out = np.zeros(len(a), bool)
    x_size, y_size = (np.fromiter(map(len, v), np.int64, len(v)) for v in (a, b))
    fits = percent * np.maximum(n, m) <= 100 * np.minimum(n, m)
    for p, q in set(zip(x_size[fits].tolist(), y_size[fits].tolist())):
        i = np.flatnonzero(fits & (x_size == p) & (y_size == q))
        x, y = (np.frombuffer(b"".join([v[k] for k in i]), np.uint8).reshape(len(i), -1) for v in (a, b))
        cut = (x >= 255).any(1) | (y >= 255).any(1)
        u, w = (v.astype(np.int32) for v in (x, y))
        least = min(p, q)
        u, w = (v.reshape(len(i), -1, least).sum(1) for v in (u, w))
        out[i] = (np.abs(u - w).sum(1) * (100 + percent) <= (n[i] + m[i]) * (100 - percent)) | cut
    return out


def tallies_reach(a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets of sizes n and m may reach the bound, by their tallies.

    Tallies differ by no more than the sets do, and sets that reach the bound differ in at
    most ``(n + m) (100 - percent) / (100 + percent)`` shingles. Of two tallies the longer one
    folds: its buckets are told apart by more bits. A full bucket was cut and rules out nothing.
    """
    out = np.zeros((len(a), len(b)), bool)
    of = lambda v: {k: np.flatnonzero([len(x) == k for x in v]) for k in {len(x) for x in v}}
    stack = lambda v, i: np.stack([np.frombuffer(v[k], np.uint8) for k in i]).astype(np.int32)
    for i in of(a).values():
        x = stack(a, i)
        for j in of(b).values():
            y = stack(b, j)
            u, w = x, y
            while u.shape[1] != w.shape[1]:
                u, w = (u.reshape(len(u), 2, -1).sum(1), w) if u.shape[1] > w.shape[1] else (u, w.reshape(len(w), 2, -1).sum(1))
            cut_u, cut_w = (x >= 255).any(1), (y >= 255).any(1)
            for row, k in enumerate(i.tolist()):
                at = np.flatnonzero(percent * np.maximum(n[k], m[j]) <= 100 * np.minimum(n[k], m[j]))
                if len(at):
                    gap = np.abs(w[at] - u[row]).sum(1)
                    out[k, j[at]] = (gap * (100 + percent) <= (n[k] + m[j[at]]) * (100 - percent)) | cut_u[row] | cut_w[at]
    return out


def sets_reach(a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets reach the bound, exactly; the sets' own sizes count."""
    x, y = ([np.frombuffer(v, np.uint64) for v in side] for side in (a, b))
    sizes = np.array([len(v) for v in y])
    out = np.zeros((len(x), len(y)), bool)
    for i, counts in enumerate(overlaps(x, y)):
        out[i] = counts * (100 + percent) >= percent * (len(x[i]) + sizes)
    return out


def frequent_shingles(docs: DataFrame, shingle: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that occur often, at most FREQUENT of them, and their counts.

    Counts add up inside blocks of a task first, and only what a block repeats leaves the
    task. The result orders shingles and decides no link, so what blocks miss costs time only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, s in shingle_sets(batch, shingle, "doc_id"):
                held.append(s)
                size += len(s)
                if size > COUNTED:
                    yield _repeated(held)
                    held, size = [], 0
        yield _repeated(held)

    counts = docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    counts = scratch.save(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(LEAST, total // FREQUENT)).toArrow()
    scratch.drop(counts)
    tokens, n = (found.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
    order = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[order], n[order]


def _repeated(held: list[np.ndarray]) -> pa.RecordBatch:
    tokens, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["token", "n"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows of the product of two incidence matrices: shared elements of a row of a with every row of b.

    b is held by columns (the rows that hold each element); a row of the product is the sum of
    the columns that the row of a names, counted by row.
    """
    elements = np.concatenate([*b, np.zeros(0, np.uint64)])
    order = np.argsort(elements, kind="stable")
    holders = np.repeat(np.arange(len(b)), [len(v) for v in b])[order]
    columns, first = np.unique(elements[order], return_index=True)
    until = np.append(first[1:], len(elements))
    for row in a:
        k = np.searchsorted(columns, row)
        k[k == len(columns)] = 0
        k = k[columns[k] == row] if len(columns) else k[:0]
        size = until[k] - first[k]
        at = np.arange(size.sum()) + np.repeat(first[k] - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[: len(k)], size)
        yield np.bincount(holders[at], minlength=len(b))


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of ``pairs`` over nodes 0 to n - 1."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in pairs.tolist():
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((u, v))
    return out


def set_links(sized: DataFrame, attach: Callable[[DataFrame], DataFrame], scratch: Scratch, *, percent: int, block: int, reach: Callable = sets_reach) -> DataFrame:
    """Links (u, v) that connect what reaches Jaccard ``percent`` / 100 inside each cluster.

    ``sized`` has id, cluster and n (size of the set), and bucket where n is no exact size. ``attach`` gets (id, cluster, bucket,
    salt) and adds n and ``set``, what ``reach`` compares, as bytes. Clusters are cut into blocks
    by size bucket and salt, each of about ``block`` elements and ROWS sets; each pair of blocks whose sizes
    allow a link is one product in one task, which returns a spanning forest of its links.
    """
    if "bucket" not in sized.columns:
        sized = sized.withColumn("bucket", F.floor(F.log("n") / math.log(100 / percent)).cast("int"))
    sized = scratch.save(sized)
    weight = sized.groupBy("cluster", "bucket").agg(F.ceil(F.greatest(F.sum("n") / block, F.count("*") / ROWS)).cast("int").alias("salts"))
    blocked = sized.join(weight, ["cluster", "bucket"]).select(
        "id", "cluster", "bucket", F.pmod(F.xxhash64("id"), F.col("salts").cast("long")).cast("int").alias("salt")
    )
    a, b = weight.alias("a"), weight.alias("b")
    pairs = (
        a.join(b, F.expr("a.cluster = b.cluster AND b.bucket BETWEEN a.bucket AND a.bucket + 2"))
        .select(F.col("a.cluster").alias("cluster"), F.col("a.bucket").alias("b1"), F.col("b.bucket").alias("b2"),
                F.explode(F.sequence(F.lit(0), F.col("a.salts") - 1)).alias("s1"), F.col("b.salts").alias("t"))
        .select("cluster", "b1", "b2", "s1", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("s2"))
        .where("b1 < b2 OR s1 <= s2")
    )
    sides = pairs.select("cluster", F.col("b1").alias("bucket"), F.col("s1").alias("salt"), F.lit(0).alias("side"), F.struct("cluster", "b1", "s1", "b2", "s2").alias("pair")).union(
        pairs.where("b1 < b2 OR s1 < s2").select("cluster", F.col("b2").alias("bucket"), F.col("s2").alias("salt"), F.lit(1).alias("side"), F.struct("cluster", "b1", "s1", "b2", "s2").alias("pair"))
    )

    def product(table: pa.Table) -> pa.Table:
        side, ids, n = (table.column(c).to_numpy() for c in ("side", "id", "n"))
        data = table.column("set").to_pylist()
        i = np.flatnonzero(side == 0)
        j = np.flatnonzero(side == 1) if side.any() else i
        if not len(i) or not len(j):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        x, y = np.nonzero(reach([data[k] for k in i], [data[k] for k in j], n[i], n[j], percent))
        links = np.stack([i[x], j[y]], 1)
        found = _forest(links[ids[links[:, 0]] != ids[links[:, 1]]], len(ids))
        return pa.table({"u": pa.array(ids[[f[0] for f in found]] if found else [], pa.int64()), "v": pa.array(ids[[f[1] for f in found]] if found else [], pa.int64())})

    # Products take time rather than bytes, so their partitions are not merged by size.
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = attach(blocked).join(sides, ["cluster", "bucket", "salt"]).select("pair", "side", "id", "n", "set").repartition(parts, "pair")
    out = scratch.save(links.groupBy("pair").applyInArrow(product, "u long, v long"))
    scratch.drop(sized)
    return out


def jaccard_classes(docs: DataFrame, *, shingle: int = 3, percent: int = 90, block: int = 100_000) -> DataFrame:
    """Link documents whose shingle sets reach Jaccard ``percent`` / 100, exactly.

    Returns per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, where
    component_id is the smallest doc_id reachable by links.

    1. Frequent shingles are found, a bounded list. A second pass makes each text's set of
       ``shingle``-word hashes, a 128-bit fingerprint of the set, its prefix in an order that
       puts frequent shingles last, and a tally. Rows with equal fingerprints form a class.
    2. Class representatives that share a prefix shingle are candidates: small groups as pairs
       that the tallies' size-derived bound thins out exactly, large groups by a blocked
       product of their members' tallies, group by group, with the same bound. Groups are never
       joined before: chained by shared members they would hold most documents. Components of
       what may link are clusters.
    3. Clusters are cut into blocks by size bucket and salt, each of about ``block`` shingles,
       so one huge cluster is spread over tasks. Each pair of blocks with compatible sizes is
       one sparse product that accumulates overlap counts; pairs below the size-derived bound
       are discarded, and a spanning forest of the rest is emitted.
    4. Components of those links, joined back to classes and rows.

    Null or blank text: empty set, linked with nothing. Null doc_id: the row is returned with
    a null component_id, linked with nothing. Rows that share a doc_id count as one document.
    Extra columns are ignored. An empty table gives no rows.
    """
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text")

    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, shingle, scratch))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(shingle_sets(batch, shingle, "doc_id"))
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for _, s in rows]
            firsts = [prefix(s, frequent.value[0], percent, frequent.value[1]) if len(s) and doc is not None else s[:0] for doc, s in rows]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in firsts])])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()), pa.array(prints, pa.binary()),
                 pa.array([tally(s).tobytes() for _, s in rows], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*firsts, np.zeros(0, np.uint64)]).view(np.int64)))],
                ["doc_id", "n_shingles", "print", "tally", "prefix"],
            )

    rows = scratch.save(docs.mapInArrow(sets, "doc_id long, n_shingles long, print binary, tally binary, prefix array<long>"))
    classes = scratch.save(
        rows.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    )
    # Prefixes of representatives only: copies add no candidates. The joins with texts and
    # prefixes are merge joins at every size, so their cost is the same share of the input.
    reps = rows.join(classes.select("print", F.col("rep").alias("doc_id")).hint("merge"), ["print", "doc_id"], "left_semi")
    signed = reps.select("doc_id", "n_shingles", F.explode("prefix").alias("sig"))
    tops = signed.groupBy("sig").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("top"), F.count("*").alias("c")).where("u < top").select("sig", "u", "c")
    shared = scratch.save(signed.join(tops, "sig").select("sig", "u", "c", F.col("doc_id").alias("v"), F.col("n_shingles").alias("n")))
    long, rows = rows, scratch.save(rows.drop("prefix"))
    scratch.drop(long)
    groups = shared.where(F.col("c") <= PAIRED).groupBy("sig").agg(F.array_sort(F.collect_set(F.struct("v", "n"))).alias("g"))  # PAIRED rows at most
    pairs = (
        groups.select(F.explode(F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, PAIRED), lambda y: F.struct(x["v"].alias("u"), y["v"].alias("v"), x["n"].alias("n"), y["n"].alias("m")))))).alias("p"))
        .select("p.*").where((percent * F.greatest("n", "m") <= 100 * F.least("n", "m")) & (F.col("u") < F.col("v"))).distinct()
    )
    tallies = rows.where("doc_id IS NOT NULL").select("doc_id", "n_shingles", "tally")
    facing = pairs.join(tallies.select(F.col("doc_id").alias("u"), F.col("n_shingles").alias("n"), F.col("tally").alias("a")), ["u", "n"])
    facing = facing.join(tallies.select(F.col("doc_id").alias("v"), F.col("n_shingles").alias("m"), F.col("tally").alias("b")), ["v", "m"])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            yield batch.select(["u", "v"]).filter(pa.array(pairs_reach(a, b, n, m, percent), pa.bool_()))

    near = facing.select("u", "v", "n", "m", "a", "b").mapInArrow(thin, "u long, v long")
    sizes = classes.select(F.col("rep").alias("u"), "n")
    # A group of up to ROWS is one product, a larger one is cut by sizes.
    bucket = F.when(F.col("c") > ROWS, F.floor(F.log("n") / math.log(100 / percent))).otherwise(0).cast("int")
    hot = shared.where(F.col("c") > PAIRED).select(F.col("v").alias("id"), F.col("sig").alias("cluster"), "n", bucket.alias("bucket"))

    def tallied(blocked: DataFrame) -> DataFrame:
        own = tallies.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("tally").alias("set"))
        return own.join(blocked, "id")

    maybe = set_links(hot, tallied, scratch, percent=percent, block=16 * block, reach=tallies_reach)
    with arrow_batches(spark, THINNED):
        clusters = scratch.save(connected_components(near.union(maybe), scratch))
    scratch.drop(shared, maybe)
    sized = clusters.join(sizes, "u").select(F.col("u").alias("id"), F.col("component_id").alias("cluster"), "n")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(shingle_sets(batch, shingle, "id", "cluster", "bucket", "salt"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))] + [pa.array([len(r[4]) for r in out], pa.int64()), pa.array([r[4].tobytes() for r in out], pa.binary())],
                ["id", "cluster", "bucket", "salt", "n", "set"],
            )

    def attach(blocked: DataFrame) -> DataFrame:
        named = docs.withColumnRenamed("doc_id", "id").join(blocked.hint("merge"), "id")
        return named.select("id", "cluster", "bucket", "salt", "text").mapInArrow(members, "id long, cluster long, bucket int, salt int, n long, set binary")

    links = set_links(sized, attach, scratch, percent=percent, block=block)
    found = scratch.save(connected_components(links, scratch))
    scratch.drop(clusters, links)
    named = classes.join(found.withColumnRenamed("u", "rep"), "rep", "left").select("print", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(named, "print", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each linked group, the one with the smallest doc_id.

    Of rows that share this doc_id one stays. Rows with a null doc_id all stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    first = jaccard_classes(named, **settings).where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    place = "_row"
    while place in map(str.lower, docs.columns):
        place += "_"
    kept = named.join(first.hint("merge"), "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return kept.select(docs.columns).union(docs.where("doc_id IS NULL"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard of 0.9 or more, over all documents."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM words),
sizes AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM sets),
elements AS (SELECT doc_id, unnest(g) AS g FROM sets),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM elements a JOIN elements b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * c >= 90 * (x.n_shingles + y.n_shingles - c)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, b.v FROM reach r JOIN edges b ON r.other = b.u)
SELECT doc_id, n_shingles, min(other) AS component_id FROM sizes JOIN reach USING (doc_id) GROUP BY 1, 2
"""
