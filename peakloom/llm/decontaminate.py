"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_WORD, by_bytes, grams, hash_words, texts_of, tune

#: Scores of the alignment, in words.
MATCH, MISMATCH, GAP = 2, -1, -1


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and its end in ``window`` (exclusive).

    Rows run over ``item``; gaps along a row are one running maximum, so each row is a few
    vector operations.
    """
    n = len(window)
    steps = np.arange(1, n + 1) * -GAP
    above = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.maximum(above[:-1] + np.where(window == w, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps
        if n and (top := int(row.max())) > best:
            best, end = top, int(row.argmax()) + 1
        above = np.concatenate([[0], row])
    return best, end


class SeedIndex:
    """Word n-grams of a block of test items, with the items and places that hold each.

    An item of fewer words than a seed is known by the hash of all of its words.
    """

    def __init__(self, items: list[tuple], gram: int):
        self.ids = [i for i, _ in items]
        h, of, _, _ = hash_words([(t or "").lower().encode("utf-8", "replace") for _, t in items], NON_WORD)
        cuts = np.searchsorted(of, np.arange(len(items) + 1))
        self.flat, self.cuts = h, cuts
        self.words = [h[cuts[i] : cuts[i + 1]] for i in range(len(items))]
        at = np.flatnonzero(of[: max(len(h) - gram + 1, 0)] == of[gram - 1 :]) if len(h) >= gram else np.zeros(0, np.int64)
        seeds = grams(h, gram)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, first = np.unique(seeds[order], return_index=True)
        self.first = np.append(first, len(at))
        self.item = of[at][order]
        self.place = (at - cuts[of[at]])[order]
        self.gram = gram
        self.distinct = [np.unique(w) for w in self.words]
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.seeds & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(self.words):
            if 0 < len(w) < gram:
                self.short.setdefault(len(w), {}).setdefault(int(grams(w, len(w))[0]), []).append(i)

    def verbatim(self, h: np.ndarray, of: np.ndarray) -> list[tuple]:
        """(text, item_id, 1.0, start_word, end_word) of the first place of each short item in a text."""
        out = []
        for n, items in self.short.items():
            g = grams(h, n) if len(h) >= n else h[:0]
            at = np.flatnonzero(np.isin(g, np.array(list(items), np.uint64)) & (of[: len(g)] == of[n - 1 : n - 1 + len(g)]))
            _, once = np.unique(np.stack([of[at].astype(np.uint64), g[at]]), axis=1, return_index=True)
            for p in at[once].tolist():
                begin = p - int(np.searchsorted(of, of[p]))
                out += [(int(of[p]), self.ids[i], 1.0, begin, begin + n) for i in items[int(g[p])]]
        return out

    def hits(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions at which a seed begins within one text, and the seeds' numbers."""
        if len(h) < self.gram or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = grams(h, self.gram)
        at = np.flatnonzero(self.table[(g & np.uint64(0xFFFFF)).astype(np.int64)] & (of[: len(g)] == of[self.gram - 1 :]))
        k = np.minimum(np.searchsorted(self.seeds, g[at]), len(self.seeds) - 1)
        ok = self.seeds[k] == g[at]
        return at[ok], k[ok]

    def aligned(self, h: np.ndarray, of: np.ndarray, min_score: float, min_words: int) -> list[tuple]:
        """(text, item_id, score, start_word, end_word) of items that seeds lead to and that align."""
        out = self.verbatim(h, of) if self.short else []
        at, k = self.hits(h, of)
        for d in np.unique(of[at]).tolist():
            lo, hi = np.searchsorted(of, [d, d + 1])
            mine = slice(*np.searchsorted(of[at], [d, d + 1]))
            for item, begins, need in self._likely(h[lo:hi], at[mine] - lo, k[mine], min_score, min_words):
                words = self.words[item]
                score, start, end = _best(words, self.distinct[item], h[lo:hi], begins, need)
                if score >= need:
                    out.append((d, self.ids[item], score / (MATCH * len(words)), start, end))
        return out

    def _likely(self, text: np.ndarray, at: np.ndarray, k: np.ndarray, min_score: float, min_words: int) -> Iterator[tuple[int, np.ndarray, float]]:
        """(item, begins, least score) of the items that a text's seeds lead to.

        An item of whose words too few stand anywhere in the text is left before any place is
        listed, so a seed that many items and places share costs their sum, not their product.
        """
        order = np.argsort(k, kind="stable")
        seeds, first, times = np.unique(k[order], return_index=True, return_counts=True)
        held = self.first[seeds + 1] - self.first[seeds]
        entries = np.repeat(self.first[seeds] - np.cumsum(held) + held, held) + np.arange(held.sum())
        items, of_seed = self.item[entries], np.repeat(np.arange(len(seeds)), held)
        some = np.unique(items)
        lengths = self.cuts[some + 1] - self.cuts[some]
        words = self.flat[np.repeat(self.cuts[some] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        known = np.unique(text)
        shared = known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words
        reach = MATCH * np.add.reduceat(shared.astype(np.int64), np.cumsum(lengths) - lengths)
        need = MATCH * np.maximum(min_score * lengths, np.minimum(min_words, lengths))
        by_item = np.argsort(items, kind="stable")
        sorted_items = items[by_item]
        for item, least in zip(some[reach >= need].tolist(), need[reach >= need].tolist()):
            own = by_item[slice(*np.searchsorted(sorted_items, [item, item + 1]))]
            begins = [at[order[first[s] : first[s] + times[s]]] - self.place[e] for e, s in zip(entries[own], of_seed[own])]
            yield item, np.unique(np.concatenate(begins)), least


def _chunks(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    for rows in by_bytes(texts_of(batch, *keys, lower=True)):
        h, of, _, _ = hash_words([r[-1] for r in rows], NON_WORD)
        yield rows, h, of


def contaminated(docs: DataFrame, benchmark: DataFrame, *, gram: int = 4, min_score: float = 0.5, min_words: int = 8,
                 item_bytes: int = 32 << 20) -> DataFrame:
    """Documents that hold an exact, edited or paraphrased copy of a test item.

    Returns (doc_id, item_id, score, start_word, end_word): the best alignment of each such
    pair; score is its Smith-Waterman score over that of a perfect copy, at least ``min_score``
    and worth ``min_words`` matching words (all words of a shorter item).

    The items are taken in blocks of at most ``item_bytes`` of text (an index takes about seven
    times as much), so what is broadcast is bounded however large the benchmark is. Per block, one pass finds every ``gram``-word seed
    and aligns the words around it at once, where the text is. No text is shuffled, no number
    of hits is capped, and no seed is left out for being frequent: a window is skipped only if
    the words it shares with the item cannot reach the score.

    Items of fewer than ``gram`` words match where all their words stand in a row (score 1).
    Null or empty texts and items, and items without a word, match nothing; empty tables give no
    rows. A null doc_id or item_id is kept as such in the pairs. Repeated rows give one pair; of
    alignments with equal scores the one that starts last is given. Time follows a text's length
    and the words near its seeds. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    found = None
    for index in _indexes(docs, benchmark, gram, item_bytes):
        pairs = _pairs(docs, index, min_score, min_words)
        found = pairs if found is None else found.union(pairs)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "start_word", "end_word")).alias("m"))
    return best.select("doc_id", "item_id", "m.score", "m.start_word", "m.end_word")


def clean(docs: DataFrame, benchmark: DataFrame, *, gram: int = 4, min_score: float = 0.5, min_words: int = 8,
          item_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` without the rows that ``contaminated`` finds; the filter runs where the text is.

    Rows with null or empty texts stay, and so do null ids, repeated rows and extra columns; an
    empty table or benchmark changes nothing.
    """
    whole = docs
    for index in _indexes(docs, benchmark, gram, item_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, at = np.ones(batch.num_rows, bool), 0
                for rows, h, of in _chunks(batch):
                    good[[at + m[0] for m in sent.value.aligned(h, of, min_score, min_words)]] = False
                    at += len(rows)
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, whole.schema)
    return docs


def _indexes(docs: DataFrame, benchmark: DataFrame, gram: int, item_bytes: int) -> Iterator[SeedIndex]:
    """An index per block of items."""
    tune(docs.sparkSession)
    benchmark = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size * 1.5 / item_bytes) or 1
    for b in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield SeedIndex([tuple(r) for r in part.distinct().collect()], gram)


def _pairs(docs: DataFrame, index: SeedIndex, min_score: float, min_words: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (rows[m[0]][0], *m[1:])
                for rows, h, of in _chunks(batch, "doc_id")
                for m in sent.value.aligned(h, of, min_score, min_words)
            ]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                ["doc_id", "item_id", "score", "start_word", "end_word"],
            )

    return docs.mapInArrow(align, "doc_id long, item_id long, score double, start_word long, end_word long")


def _bound(distinct: np.ndarray, window: np.ndarray) -> int:
    """No alignment in ``window`` scores more: words of the item count as matches, others as edits."""
    at = np.minimum(np.searchsorted(distinct, window), len(distinct) - 1)
    sums = np.concatenate([[0], np.cumsum(np.where(distinct[at] == window, MATCH, max(MISMATCH, GAP)))])
    return int((sums - np.minimum.accumulate(sums)).max())


def _best(item: np.ndarray, distinct: np.ndarray, text: np.ndarray, begins: np.ndarray, need: float) -> tuple[int, int, int]:
    """Best alignment over the windows around likely ``begins``, in order; overlapping windows merge.

    Windows that cannot reach ``need`` are left out.
    """
    slack = len(item) // 4 + 2
    best = (0, 0, 0)
    cuts = np.flatnonzero(np.diff(begins) > len(item) + 2 * slack) + 1
    spans = [(int(b[0]) - slack, int(b[-1]) + len(item) + slack) for b in np.split(begins, cuts)]
    for lo, hi in spans:
        lo, hi = max(lo, 0), min(hi, len(text))
        if _bound(distinct, text[lo:hi]) < need:
            continue
        score, end = smith_waterman(item, text[lo:hi])
        if score > best[0]:
            _, back = smith_waterman(item[::-1], text[lo : lo + end][::-1])
            best = (score, lo + end - back, lo + end)
    return best


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
