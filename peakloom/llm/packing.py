"""Packing: token pieces placed by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, tune

#: Words, and parts of words, in each of the two generations of a worker's caches.
WORDS, PARTS = 500_000, 300_000


def default_vocabulary() -> str:
    """Path of the public word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Recent(dict):
    """Cache of ``make(key)`` in two generations: what is used again outlives what is not."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        value = self[key] = self.make(key) if value is None else value
        return value


class CachedTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never merges across it, nor across its own pattern of
    letters, single digits and signs, so a text's ids are those of these parts in order. Words
    repeat, and words share parts, so the ids of both are cached. Words with characters beyond
    Latin letters go through the tokenizer itself, and so does a whole text with one of the
    special tokens' strings or a control that Python alone counts as white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.words = _Recent(self._word, WORDS)
        self.parts = _Recent(self._part, PARTS)
        # Byte-level alphabet: printable bytes stand for themselves, others for later letters.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in kept)}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        if max(word) > "\u024f":
            return self._whole(word)
        return b"".join(map(self.parts.__getitem__, self.split(word.lower())))

    def encode(self, text: str) -> bytes:
        if any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", *self.special)):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def token_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """Pieces of at most ``size`` ids: (doc_id, start, length, ids_crc32, doc_tokens)."""
    end = array("I", [end_id]).tobytes()
    held: dict[str, CachedTokenizer] = {}  # one per worker, kept between partitions

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in held:
            held[vocabulary] = CachedTokenizer(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            encode = held[vocabulary].encode
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                x = encode(text or "") + end
                n = len(x) // 4
                out += [(doc, s, min(size, n - s), zlib.crc32(x[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, count), by placing lengths longest first.

    Packs with the same content are one entry with a count. Each length goes to the entry
    with the most room; an entry with more packs than pieces left is split in two. Work and
    result depend on the number of distinct lengths, not on the number of pieces.
    """
    room: list[tuple[int, int]] = []  # heap of (-room, entry)
    entries: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int) -> None:
        entries.append((pattern, count))
        heapq.heappush(room, (sum(pattern) - size, len(entries) - 1))

    done = set()
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if room and -room[0][0] >= length:
                _, i = heapq.heappop(room)
                pattern, count = entries[i]
                done.add(i)
                used = min(left, count)
                put((*pattern, length), used)
                if count > used:
                    put(pattern, count - used)
                left -= used
            else:
                put((length,), left)
                left = 0
    return [e for i, e in enumerate(entries) if i not in done]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), in order of length and rank.

    Pieces of a length are ranked from 0; those from a slot's first rank on, up to the next
    slot's, go to consecutive sequences at the slot's offset.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, *, vocabulary: str | None = None, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``size`` tokens.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    document's ids are those of its text and then ``end_id``; it is cut every ``size`` ids.
    The histogram of lengths (at most ``size`` rows) goes to the driver, which computes the
    patterns; pieces get a rank within their length from salted counts, so a length that many
    documents have is ranked by many tasks, and find their slot by rank in a table whose size
    depends on ``size`` alone.

    Null or empty text: one piece that holds ``end_id``. A null doc_id is kept. Repeated rows
    are packed as often as they occur. Extra columns are ignored; no rows give no pieces.
    """
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(token_pieces(docs, vocabulary or default_vocabulary(), size, end_id))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = slots(shortest_pack_first(histogram, size))
    salts = max(64, sum(histogram.values()) // 10_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        salted.withColumn("rank", F.row_number().over(order) - 1)
        .join(before, ["length", "salt"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank")).alias("rank"))
    )
    sent = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        keys = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (batch.column("length").to_numpy() << 48) + rank, "right") - 1
            own = t[k]
            cols = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
