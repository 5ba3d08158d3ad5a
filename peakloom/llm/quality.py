"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, by_bytes, hash_words, mix, texts_of, tune

#: Most labelled rows that training gathers on the driver; more are sampled by hash.
TRAIN_ROWS = 20_000

# Frequent short words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be this by from or an at not have",
    "le la les de des du et un une que qui en est dans pour sur au par pas ne se ce avec",
    "der die das und ist von den mit zu im auf nicht ein eine des dem sich als auch es",
    "el los las y del se por con una su para es al lo como no más o pero sus",
)

FEATURES = (
    "log_chars", "log_words", "word_len", "word_len_sd", "word_max", "upper", "digit", "space", "punct", "symbol",
    "high", "bang", "pipe", "hash_like", "stops", "stops_all", "unique_words", "top_word", "unique_pairs", "unique_triples",
    "lines", "line_words", "unique_lines", "byte_entropy", "squeezed", "end_symbol", "upper_words", "period", "comma", "one_char",
)

_KINDS = ("upper", "lower", "digit", "space", "punct", "symbol", "high")


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros((256, 7))
    for c in range(256):
        x = chr(c)
        k = 6 if c >= 128 else 0 if x.isupper() else 1 if x.islower() else 2 if x.isdigit() else 3 if x in " \t\n\r\v\f" else 4 if x in ".,;:!?'\"()-" else 5
        kinds[c, k] = 1
    return kinds


_BYTES = _byte_kinds()
_STOPS = [np.sort(hash_words([w.encode() for w in s.split()], SPACE)[0]) for s in STOP_WORDS]
_ALL_STOPS = np.unique(np.concatenate(_STOPS))


def _distinct(x: np.ndarray) -> float:
    return len(np.unique(x)) / len(x) if len(x) else 1.0


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    h, of, start, end = hash_words(texts, SPACE)
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    stop = [np.isin(h, s) for s in (*_STOPS, _ALL_STOPS)]
    out = np.zeros((len(texts), len(FEATURES)))
    for i, t in enumerate(texts):
        own = slice(cuts[i], cuts[i + 1])
        w, n, size = h[own], cuts[i + 1] - cuts[i], max(len(t), 1)
        a = np.frombuffer(t, np.uint8)
        counts = np.bincount(a, minlength=256)
        upper, _, digit, space, punct, symbol, high = counts @ _BYTES / size
        lengths = (end[own] - start[own]) if n else np.zeros(1)
        lines = [x for x in t.split(b"\n") if x.strip()]
        last, first = (a[end[own] - 1], a[start[own]]) if n else (np.zeros(0, np.uint8),) * 2
        _, times = np.unique(w, return_counts=True)
        p = counts[counts > 0] / size
        share = [s[own].mean() if n else 0.0 for s in stop]
        out[i] = (
            np.log1p(len(t)), np.log1p(n), lengths.mean(), lengths.std(), lengths.max(), upper, digit, space, punct, symbol,
            high, counts[33] / max(n, 1), counts[124] / max(n, 1), counts[[35, 36, 37, 38, 42]].sum() / max(n, 1), max(share[:4]), share[4], _distinct(w), times.max() / n if n else 0,
            _distinct(mix(w[:-1]) + w[1:]), _distinct(mix(mix(w[:-2]) + w[1:-1]) + w[2:]),
            np.log1p(len(lines)), n / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), -(p * np.log2(p)).sum(), len(zlib.compress(t, 1)) / size,
            (_BYTES[last, 5] > 0).mean() if n else 0, (_BYTES[first, 0] > 0).mean() if n else 0, counts[46] / max(n, 1), counts[44] / max(n, 1), (lengths == 1).mean() if n else 0,
        )
    return out


@dataclass
class Forest:
    """Boosted trees in flat arrays (trees x nodes): leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all rows and trees step down together."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = x[rows, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(go, self.left[tree, node], self.right[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node].sum(1))))


def train(x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, penalty: float = 1.0, least: float = 5.0) -> Forest:
    """Fit logistic boosting: each tree grows level by level from gradient histograms."""
    size = 2 ** (depth + 1) - 1
    empty = np.zeros((0, size), np.int64)
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else min(max(float(y[0]), 0.01), 0.99)
        return Forest(empty, empty.astype(float), empty, empty, empty.astype(float), float(np.log(p / (1 - p))), 0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    n, f = x.shape
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(size, np.int64), np.full(size, np.inf)
        left = np.arange(size)
        right, value = left.copy(), np.zeros(size)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            live = (node >= first) & (node < first + width)
            key = ((node[live] - first)[:, None] * f + np.arange(f)) * bins + binned[live]
            shape = (width, f, bins)
            gs = np.bincount(key.ravel(), np.repeat(g[live], f), width * f * bins).reshape(shape).cumsum(2)
            hs = np.bincount(key.ravel(), np.repeat(h[live], f), width * f * bins).reshape(shape).cumsum(2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
            gain[(hs < least / 4) | (ht - hs < least / 4)] = -1
            best = gain.reshape(width, -1).argmax(1)
            split = np.full(size, -1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k], split[first + k] = j, edges[j][b], b
                    left[first + k], right[first + k] = 2 * (first + k) + 1, 2 * (first + k) + 2
            goes = live & (split[node] >= 0)
            at = node[goes]
            node[goes] = np.where(binned[goes, feature[at]] <= split[at], left[at], right[at])
        gsum, hsum = np.bincount(node, g, size), np.bincount(node, h, size)
        value = -rate * gsum / (hsum + penalty)
        margin += value[node]
        made.append((feature, threshold, left, right, value))
    return Forest(*(np.stack(c) for c in zip(*made)), base, depth)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents whose labels are never learnt."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, **settings) -> Forest:
    """Train on labelled documents outside the held-out fifth.

    At most ``train_rows`` labelled documents are used, chosen by a hash of doc_id over the
    whole table; their statistics (not their texts) go to the driver. A document labelled more
    than once takes its smallest label; null labels and ids are left out.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in by_bytes(texts_of(batch, "doc_id", "quality")):
                x = statistics([r[-1] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))],
                    ["doc_id", "quality", "x"],
                )

    table = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(describe, "doc_id long, quality int, x array<double>").toArrow()
    table = table.sort_by([("doc_id", "ascending")])
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return train(x, table.column("quality").to_numpy().astype(float), **settings)


def score(docs: DataFrame, model: Forest, *, threshold: float = 0.3) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts are scored as empty ones; a null doc_id is kept, with held_out
    false. Rows are scored one by one, so repeated rows and extra columns change nothing.
    """
    spark = tune(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in by_bytes(texts_of(batch, "doc_id")):
                s = sent.value.score(statistics([r[-1] for r in rows]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(s)], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Forest, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model predicts to have label 1, all columns as they are."""
    spark = tune(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [np.zeros(0)]
            for rows in by_bytes(texts_of(batch)):
                good.append(sent.value.score(statistics([r[-1] for r in rows])) >= threshold)
            yield batch.filter(pa.array(np.concatenate(good).astype(bool)))

    return docs.mapInArrow(apply, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents with a model of labels.quality."""
    tune(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
