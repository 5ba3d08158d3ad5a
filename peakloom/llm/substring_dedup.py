"""Substring dedup: MinHash banding of paragraphs, exact Jaccard, removal by components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.operators.components import connected_components

from .common import NON_WORD, Scratch, by_bytes, grams, hash_words, mix, powers, texts_of, tune
from .jaccard_join import set_links

#: Words of an anchor.
ANCHOR = 10
#: Words of a cell in which intervals of one text meet.
CELL = 4096


def tune_bands(threshold: float, recall: float, most: int = 4) -> tuple[int, int]:
    """(bands, rows): the most rows for which ``most`` bands reach ``recall`` at ``threshold``.

    One row a band with as many bands as the recall asks for, where ``most`` do not reach it.
    """
    if not (0 < threshold < 1 and 0 < recall < 1):
        raise ValueError("threshold and recall lie between 0 and 1")
    need = lambda rows: math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
    rows = max((r for r in range(1, 9) if need(r) <= most), default=1)
    return need(rows), rows


class Words:
    """Hashes and places of the words of a group of texts."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.h, self.of, self.start, self.end = hash_words(texts, NON_WORD)
        self.first = np.searchsorted(self.of, np.arange(len(texts)))
        p, self.inverse = powers(len(self.h) + 1)
        self.sums = np.zeros(len(self.h) + 1, np.uint64)
        np.cumsum(self.h * p[:-1], out=self.sums[1:])

    def holds(self, text: int, at: np.ndarray, size: int) -> np.ndarray:
        """Whether ``size`` words from ``at`` on lie in one text."""
        return at + size <= (self.first[text + 1] if text + 1 < len(self.first) else len(self.h))

    def names(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64-bit names of the word sequences that begin at ``at``."""
        return mix((self.sums[at + size] - self.sums[at]) * self.inverse[at] + size.astype(np.uint64))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each line."""
        lengths = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        begins = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
        seen = np.concatenate([[0], np.cumsum(np.frombuffer(b" ".join(self.texts), np.uint8) == 10)])
        gap = seen[begins[self.of[1:]] + self.start[1:]] - seen[begins[self.of[:-1]] + self.end[:-1]]
        at = np.flatnonzero(np.concatenate([[True], (gap > 0) | (self.of[1:] != self.of[:-1])]))
        return at, np.diff(np.append(at, len(self.h)))

    def bands(self, at: np.ndarray, size: np.ndarray, shingle: int, bands: int, rows: int) -> np.ndarray:
        """Band hashes of the lines' shingle sets, a row per line."""
        n = size - shingle + 1
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        own = grams(self.h, shingle)[np.arange(n.sum()) + np.repeat(at - first, n)]
        out = np.zeros((len(at), bands), np.uint64)
        for b in range(bands):
            for r in range(rows):
                seed = mix(np.array([b * 97 + r + 1], np.uint64))
                out[:, b] = mix(out[:, b] + np.minimum.reduceat(mix(own ^ seed), first) + np.uint64(b))
        return out

    def anchors(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all runs of ``n`` words inside one text, and the anchor of each.

        A run's anchor is the smallest hash of its ``ANCHOR``-word shingles: equal runs have
        equal anchors, and neighbouring runs mostly share theirs.
        """
        if len(self.h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        k = min(ANCHOR, n)
        low, size, wide = grams(self.h, k), 1, n - k + 1
        while size * 2 <= wide:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        if size < wide:
            low = np.minimum(low[: size - wide], low[wide - size :])
        at = np.flatnonzero(self.of[: len(low)] == self.of[n - 1 :])
        return at, low[at]


_PARTS = pa.schema([("doc_id", pa.int64()), ("word", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("id", pa.int64()), ("before", pa.int64()), ("bands", pa.list_(pa.int64()))])


def parts_of(docs: DataFrame, scratch: Scratch, *, shingle: int, least: int, n_bands: int, n_rows: int, min_words: int) -> DataFrame:
    """Lines of at least ``least`` words with their bands, and (bands null) stretches by anchor.

    A line has its place in words and bytes, its name (id), and the name of what stands between
    it and the line before (before). A stretch lists ``words`` runs of ``min_words`` words that
    follow each other from ``word`` on and have one anchor (id). One pass over the texts.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in by_bytes(texts_of(batch, "doc_id"), 1 << 19):
                w = Words([r[-1] for r in rows])
                if not len(w.h):
                    continue
                ids = np.array([r[0] for r in rows], np.int64)
                at, size = w.lines()
                ok = size >= max(least, shingle)
                at, size = at[ok], size[ok]
                if len(at):
                    end, text = at + size, w.of[at]
                    behind = np.where(np.concatenate([[False], text[1:] == text[:-1]]), np.concatenate([[0], end[:-1]]), w.first[text])
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * n_bands, pa.int32()), pa.array(w.bands(at, size, shingle, n_bands, n_rows).ravel().view(np.int64)))
                    cols = (at - w.first[text], size, w.start[at], w.end[end - 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[text]), *(pa.array(c.astype(np.int32)) for c in cols), pa.array(w.names(at, size).view(np.int64)), pa.array(w.names(behind, at - behind).view(np.int64)), bands], schema=_PARTS
                    )
                at, low = w.anchors(min_words)
                if len(at):
                    text = w.of[at]
                    new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])]))
                    none = pa.nulls(len(new), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[text[new]]), pa.array((at - w.first[text])[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(at))).astype(np.int32)), none, none,
                         pa.array(low[new].view(np.int64)), pa.nulls(len(new), pa.int64()), pa.nulls(len(new), _PARTS.field("bands").type)], schema=_PARTS
                    )

    return scratch.save(docs.mapInArrow(locate, "doc_id long, word int, words int, start int, end int, id long, before long, bands array<long>"))


def exact_passages(docs: DataFrame, stretches: DataFrame, copied: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """Every stretch of ``n`` or more words that stands in two documents word for word.

    ``stretches`` has doc_id, word, words and id (the anchor) of the runs of ``n`` words. Runs
    inside ``copied`` (doc_id, begin, until, in words) are left out: the smallest document that
    holds such a stretch is outside of it, and it stands for the others. Equal runs have equal
    anchors, so only runs whose anchor is left in two documents are named and counted. Runs that
    follow each other both here and in their first document are one passage.
    """
    cell = lambda c: F.floor(F.col(c) / CELL)
    holes = copied.select("doc_id", "begin", "until", F.explode(F.sequence(cell("begin"), F.floor((F.col("until") - 1) / CELL))).alias("cell"))
    inside = F.expr(f"s.doc_id = c.doc_id AND s.cell = c.cell AND c.begin <= s.word AND s.word + s.words - 1 + {n} <= c.until")
    left = scratch.save(stretches.withColumn("cell", cell("word")).alias("s").join(holes.alias("c"), inside, "left_anti").drop("cell"))
    twice = left.groupBy("id").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("id")
    wanted = left.join(twice, "id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("word", "words")).alias("wanted"))  # runs of one text

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            for rows in by_bytes(((i, *r) for i, r in enumerate(texts_of(batch, "doc_id"))), 1 << 19):
                w = Words([r[-1] for r in rows])
                for t, (i, doc, _) in enumerate(rows):
                    own = wanted[i].values
                    begin, count = own.field("word").to_numpy().astype(np.int64), own.field("words").to_numpy().astype(np.int64)
                    word = np.arange(count.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                    at = word + w.first[t]
                    ok = w.holds(t, at, n)  # a place may be that of another row of this doc_id
                    word, at = word[ok], at[ok]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), doc, np.int64))] + [pa.array(c.astype(np.int32)) for c in (word, w.start[at], w.end[at + n - 1])] + [pa.array(w.names(at, np.full(len(at), n)).view(np.int64))],
                        ["doc_id", "word", "start", "end", "id"],
                    )

    units = scratch.save(docs.join(wanted.hint("merge"), "doc_id").mapInArrow(runs, "doc_id long, word int, start int, end int, id long"))
    scratch.drop(left)
    first = units.groupBy("id").agg(F.min(F.struct("doc_id", "word")).alias("at"), F.max("doc_id").alias("hi")).where("at.doc_id < hi")
    first = first.select("id", F.col("at.doc_id").alias("first_doc"), F.col("at.word").alias("place"))
    order = Window.partitionBy("first_doc").orderBy("place")
    new = F.when(F.col("place") - F.lag("place").over(order) <= 1, 0).otherwise(1)
    named = first.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    named = scratch.save(named.select("id", "first_doc", F.min("id").over(Window.partitionBy("first_doc", "run")).alias("cluster_id")))
    own = Window.partitionBy("doc_id", "cluster_id").orderBy("word")
    found = units.join(named.hint("merge"), "id").withColumn("island", F.col("word") - F.dense_rank().over(own))
    passages = found.groupBy("doc_id", "cluster_id", "first_doc", "island").agg(
        F.min("word").alias("start_word"), (F.max("word") - F.min("word") + n).alias("n_words"), F.min("start").alias("start_byte"), F.max("end").alias("end_byte")
    )
    return passages.select("doc_id", "start_word", "n_words", "start_byte", "end_byte", "cluster_id", "first_doc", (F.col("doc_id") > F.col("first_doc")).alias("removed"))


def copied_lines(lines: DataFrame, items: DataFrame, slack: int, n: int) -> DataFrame:
    """Intervals (doc_id, begin, until) of ``n`` words or more that copy lines of an earlier document.

    Lines follow each other in an interval if they do in the same first document too, with the
    same words, ``slack`` at most, between them.
    """
    at = items.where("lo < hi").select("id", F.col("at.doc_id").alias("first_doc"), F.col("at.word").alias("place"), F.col("at.before").alias("first_before"))
    copies = lines.join(at, "id").where("doc_id > first_doc")
    order = Window.partitionBy("doc_id").orderBy("word")
    ago = lambda c: F.lag(c).over(order)
    shift = F.col("word") - F.col("place")
    gap = F.col("word") - ago(F.col("word") + F.col("words"))
    joined = (F.col("first_doc") == ago("first_doc")) & (shift == ago(shift)) & (F.col("before") == F.col("first_before")) & (gap <= slack)
    numbered = copies.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    spans = numbered.groupBy("doc_id", "run").agg(F.min("word").alias("begin"), F.max(F.col("word") + F.col("words")).alias("until"))
    return spans.where(F.col("until") - F.col("begin") >= n).select("doc_id", "begin", "until")


def repeated_passages(docs: DataFrame, *, shingle: int = 5, percent: int = 80, recall: float = 0.98, least: int = 8,
                      min_words: int = 30, slack: int = 24, block: int = 100_000) -> DataFrame:
    """Paragraphs of ``docs`` (doc_id, text) that recur in other documents.

    Returns doc_id, start_word, n_words, start_byte, end_byte (of the UTF-8 text), cluster_id,
    first_doc and removed (true unless the document is the smallest doc_id of the cluster).

    1. Paragraphs (lines) of at least ``least`` words get a name by content; equal ones are one
       item, so a line in thousands of documents is one row per partition after partial sums.
    2. Bands of items are tuned for ``recall`` at the threshold; items that collide in a band
       form candidate clusters (links to the smallest item of a band, then components).
    3. Items of a cluster are compared exactly, in blocks: Jaccard of their ``shingle``-word
       sets of at least ``percent`` / 100.
    4. Components of those links are the clusters of removals. A cluster counts if it spans
       two documents, and an item is reported if its run of such items (gaps of up to
       ``slack`` words) spans ``min_words`` words.
    5. Stretches of ``min_words`` or more words that two documents share word for word are
       reported whole, wherever their lines end and however short these are, unless lines
       reported above (and the gaps of up to ``slack`` words between them) hold them.

    Null and empty texts, and an empty table, have no paragraphs; rows with a null doc_id are
    left out. Repeated rows (equal doc_id) are one document. Ties between equal lines go to the
    smallest doc_id. A very long text is hashed on its own. Extra columns are ignored.
    """
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark, "passages")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    n_bands, n_rows = tune_bands(percent / 100, recall)
    parts = parts_of(docs, scratch, shingle=shingle, least=least, n_bands=n_bands, n_rows=n_rows, min_words=min_words)
    lines, stretches = parts.where("bands IS NOT NULL"), parts.where("bands IS NULL").select("doc_id", "word", "words", "id")
    items = scratch.save(
        lines.groupBy("id").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "word", "words", "before")).alias("at"), F.min("bands").alias("bands"))
    )
    banded = items.select("id", F.explode("bands").alias("sig"))
    tops = banded.groupBy("sig").agg(F.min("id").alias("u"), F.max("id").alias("last")).where("u < last").select("sig", "u")
    stars = banded.join(tops, "sig").where("u < id").select("u", F.col("id").alias("v"))
    clusters = scratch.save(connected_components(stars, scratch))
    facts = items.drop("bands").join(clusters.select(F.col("u").alias("id"), F.col("component_id").alias("cluster")).hint("merge"), "id", "left")
    facts = scratch.save(facts.where("lo < hi OR cluster IS NOT NULL"))
    scratch.drop(items, clusters)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            for rows in by_bytes(((i, *r) for i, r in enumerate(texts_of(batch))), 1 << 19):
                w = Words([r[-1] for r in rows])
                out = []
                for t, (i, _) in enumerate(rows):
                    for x in wanted[i]:
                        at, size = w.first[t] + x["word"], x["words"]
                        if not w.holds(t, at, size) or w.names(np.array([at]), np.array([size])).view(np.int64)[0] != x["id"]:
                            continue  # the place is that of another row of this doc_id
                        own = np.unique(grams(w.h[at : at + size], shingle))
                        out.append((x["id"], x["cluster"], x["bucket"], x["salt"], len(own), own.tobytes()))
                cols = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                    ["id", "cluster", "bucket", "salt", "n", "set"],
                )

    def attach(blocked: DataFrame) -> DataFrame:
        where = blocked.join(facts.select("id", "at.doc_id", "at.word", "at.words"), "id")
        wanted = where.groupBy("doc_id").agg(F.collect_list(F.struct("word", "words", "id", "cluster", "bucket", "salt")).alias("wanted"))  # paragraphs of one text
        return docs.join(wanted.hint("merge"), "doc_id").mapInArrow(members, "id long, cluster long, bucket int, salt int, n long, set binary")

    sized = facts.where("cluster IS NOT NULL").select("id", "cluster", F.col("at.words").cast("long").alias("n"), F.lit(0).alias("bucket"))
    links = set_links(sized, attach, scratch, percent=percent, block=block)
    near = scratch.save(connected_components(links, scratch))
    named = facts.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", "lo", "hi", F.coalesce("component_id", "id").alias("cluster_id"))
    spans = named.groupBy("cluster_id").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("last")).where("first_doc < last").select("cluster_id", "first_doc")
    shared = scratch.save(named.select("id", "cluster_id").join(spans, "cluster_id"))
    scratch.drop(links, near)
    found = lines.select("doc_id", "word", "words", "start", "end", "id").join(shared.hint("merge"), "id")
    order = Window.partitionBy("doc_id").orderBy("word", "words", "id")
    until = F.col("word") + F.col("words")
    reach = F.max(until).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(F.col("word") - reach <= slack, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    run = Window.partitionBy("doc_id", "run")
    kept = runs.withColumn("total", F.max(until).over(run) - F.min("word").over(run)).where(F.col("total") >= min_words)
    kept = kept.select(
        "doc_id", F.col("word").alias("start_word"), F.col("words").alias("n_words"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"),
        "cluster_id", "first_doc", (F.col("doc_id") > F.col("first_doc")).alias("removed"),
    ).distinct()
    kept = scratch.save(kept)
    copied = scratch.save(copied_lines(lines.select("doc_id", "word", "words", "id", "before"), facts, slack, min_words))
    scratch.drop(shared, facts)
    exact, inside = exact_passages(docs, stretches, copied, scratch, min_words).alias("e"), kept.alias("k")
    held = F.expr("e.doc_id = k.doc_id AND k.start_byte <= e.start_byte AND k.end_byte >= e.end_byte AND (k.removed OR NOT e.removed)")
    return kept.unionByName(exact.join(inside, held, "left_anti"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
