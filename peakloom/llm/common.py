"""Shared helpers: session settings, word hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from peakloom.sources.shared import Scratch

__all__ = ["Scratch", "tune", "arrow_batches", "mix", "hash_words", "powers", "grams", "by_bytes", "texts_of", "SPACE", "NON_WORD"]


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a few very long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside; the setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# --- word hashing ---------------------------------------------------------------------------

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Separators: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte that is no letter or digit.
NON_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base, and their inverses."""
    if "p" not in _pow or len(_pow["p"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("p", _P), ("i", _P_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _pow[key] = np.multiply.accumulate(x)
    p, i = _pow["p"][:n], _pow["i"][:n]
    if len(_pow["p"]) > 1 << 23:  # one huge text must not keep its tables
        _pow.clear()
    return p, i


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hash_words(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` (A-Z lowered), their text's index, and byte spans.

    A word's hash is a polynomial of its bytes, taken from prefix sums, so that the whole
    batch is hashed without a loop over words. Spans count from the start of the joined texts.
    """
    buf = b" ".join(texts).translate(_LOWER)
    a = np.frombuffer(buf, np.uint8)
    if not len(a):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    word = np.zeros(len(a) + 2, np.int8)
    word[1:-1] = ~separators[a]
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    p, inv = powers(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inv[starts])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    of = np.searchsorted(begins, starts, "right") - 1
    return h, of, starts - begins[of], ends - begins[of]


_K = [np.uint64(k) for k in (0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-word shingles of one text; fewer words make one shingle, none make none."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k * 0x632BE59BD9B4E019 & (1 << 64) - 1, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _K[i % 8] + (np.uint64(i) << np.uint64(7))
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
    return mix(out)


def by_bytes(rows: Iterable[tuple], size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Groups of rows whose last field (bytes) sum to about ``size``; one long text makes its own group."""
    out, total = [], 0
    for row in rows:
        if out and total + len(row[-1]) > size:
            yield out
            out, total = [], 0
        out.append(row)
        total += len(row[-1])
    if out:
        yield out


def texts_of(batch: pa.RecordBatch, *keys: str, text: str = "text", lower: bool = False) -> Iterator[tuple]:
    """Rows (keys..., text as UTF-8 bytes); a null text is empty."""
    cols = [batch.column(k).to_pylist() for k in keys]
    texts = batch.column(text).to_pylist()
    for i, t in enumerate(texts):
        yield (*(c[i] for c in cols), (t.lower() if lower else t).encode("utf-8", "replace") if t else b"")
