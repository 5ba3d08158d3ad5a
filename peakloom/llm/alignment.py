"""Cross-tokenizer alignment: groups of tokens between common ends, counted through a dictionary of groups."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tune

#: Segments a worker keeps; longer ones than so many characters aren't kept.
SEGMENTS, KEPT_CHARS = 300_000, 64
#: Groups whose figures are broadcast: the most frequent ones, of keys up to so many characters.
HOT_GROUPS, HOT_CHARS = 100_000, 40
#: Entries of the counts that a task gathers before it hands them on.
GATHERED = 500_000
_NO_CUT = re.compile(r"\s ")  # a space that follows white space


def default_vocabularies() -> tuple[str, str]:
    """Paths of the public byte-level and piece vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """The two tokenizers, with the bytes of each of their tokens.

    A's own vocabulary, whose ids stand in the order of its merges, also makes a faster encoder
    of the same tokens; it takes the segments of Latin text, many at once.
    """

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # Byte-level alphabet: printable bytes stand for themselves, others for later letters.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {**{chr(b): b for b in kept}, **{chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}}
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t in (self.a.id_to_token(i) or "" for i in range(size))]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.space = self.b.piece_to_id("▁")
        special = self.a.get_added_tokens_decoder()
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if i not in special}, special_tokens={})
        self.lengths = [np.array([len(x) for x in known], np.int64) for known in (self.a_bytes, self.b_bytes)]

    def encode(self, segments: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and B for all segments, one after the other, their numbers per segment, and which are spelled.

        A segment starts with the space that B adds. The tokens of one that A's or B's tokens
        don't spell are left out.
        """
        whole = [s.encode() for s in segments]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        # Where a segment ends in white space or holds letters beyond Latin ones it is encoded alone.
        apart = np.array([s[-1].isspace() or not (s.isascii() or max(s) < "\u0250") for s in segments])
        alone = iter(self.a.encode_batch_fast([s for s, x in zip(segments, apart) if x], add_special_tokens=False))
        joined = self.fast.encode_ordinary("".join([s for s, x in zip(segments, apart) if not x]))
        one = np.array(joined, np.int64)
        ends = np.concatenate([[0], np.cumsum(self.lengths[0][one])])
        cuts = np.searchsorted(ends, np.concatenate([[0], np.cumsum(sizes[~apart])]))
        a_counts = np.zeros(len(whole), np.int64)
        a_counts[~apart] = np.diff(cuts)
        if apart.any():
            lists = [e.ids for e in alone]
            a_counts[apart] = [len(x) for x in lists]
            both = np.zeros(a_counts.sum(), np.int64)
            of = np.repeat(apart, a_counts)
            both[of], both[~of] = np.fromiter(chain.from_iterable(lists), np.int64), one
            one = both
        two = [y or [self.space] for y in self.b.encode([s[1:] for s in segments], num_threads=1)]
        b_counts = np.fromiter(map(len, two), np.int64, len(two))
        flat, counts = [one, np.fromiter(chain.from_iterable(two), np.int64, int(b_counts.sum()))], [a_counts, b_counts]
        ok, text = np.ones(len(whole), bool), b"".join(whole)
        for x, n, known, length in zip(flat, counts, (self.a_bytes, self.b_bytes), self.lengths):
            ends = np.concatenate([[0], np.cumsum(length[x])])[np.cumsum(n)]
            if not np.array_equal(ends, np.cumsum(sizes)) or b"".join([known[i] for i in x.tolist()]) != text:
                cuts = np.concatenate([[0], np.cumsum(n)])
                ok &= [b"".join([known[i] for i in x[i:j].tolist()]) == w for i, j, w in zip(cuts[:-1], cuts[1:], whole)]
        if not ok.all():
            flat = [x[np.repeat(ok, n)] for x, n in zip(flat, counts)]
            counts = [np.where(ok, n, 0) for n in counts]
        return flat, counts, ok


def segments_of(text: str) -> list[str]:
    """Parts of space+text that both tokenizers encode apart, each with the space it starts with.

    A cut stands before a space that follows a character other than white space: A's pattern
    never carries such a character on to a later space, and no piece of B holds a space after
    another character.
    """
    words = text.split(" ")
    if not _NO_CUT.search(f" {text}"):
        return words
    out, held = [], None
    for w in words:
        held = w if held is None else f"{held} {w}"
        if w and not w[-1].isspace():
            out.append(held)
            held = None
    return out if held is None else [*out, held]


class _Lists:
    """Lists of integers by number, in one array that grows."""

    def __init__(self) -> None:
        self.data, self.ends, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 10, np.int64), 0

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.ends[self.n - 1]) if self.n else 0
        for name, more, at in (("data", flat, used), ("ends", np.cumsum(lengths) + used, self.n)):
            own = getattr(self, name)
            if at + len(more) > len(own):
                larger = np.zeros(max(2 * len(own), at + len(more)), np.int64)
                larger[:at] = own[:at]
                setattr(self, name, own := larger)
            own[at : at + len(more)] = more
        self.n += len(lengths)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``rows`` one after the other, and their lengths."""
        ends = self.ends[rows]
        starts = np.where(rows > 0, self.ends[rows - 1], 0)
        lengths = ends - starts
        total = np.cumsum(lengths)
        if not len(total):
            return self.data[:0], lengths
        return self.data[np.arange(total[-1]) + np.repeat(starts - total + lengths, lengths)], lengths


class Interned:
    """Segments and groups that a worker has seen, by number.

    Of a segment: its groups in order. Of a group: its key (``a1,a2|b1``), the tokens on either
    side, and its distinct pairs as 64-bit numbers.
    """

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.n = 0
        self.bad: set[int] = set()
        self.groups = _Lists()
        self.group_numbers: dict = {}
        self.keys: list[str] = []
        self.sides = np.zeros((1 << 12, 2), np.int64)
        self.pairs = _Lists()

    def add(self, segments: Iterable[str]) -> None:
        """Take up new segments."""
        new = [s for s in segments if s not in self.numbers]
        if not new:
            return
        (a, b), (a_counts, _), ok = self.pair.encode([" " + s for s in new])
        self.numbers.update(zip(new, range(self.n, self.n + len(new))))
        self.bad.update((self.n + np.flatnonzero(~ok)).tolist())
        self.n += len(new)
        a_ends, b_ends = (np.cumsum(length[x]) for length, x in zip(self.pair.lengths, (a, b)))
        # Tokens that end where one of the other side ends close a group; segments end so, too.
        a_last = np.flatnonzero(np.isin(a_ends, b_ends, assume_unique=True))
        b_last = np.flatnonzero(np.isin(b_ends, a_ends, assume_unique=True))
        closes = np.zeros(len(a) + 1, np.int64)
        closes[a_last + 1] = 1
        lengths = np.diff(np.cumsum(closes)[np.concatenate([[0], np.cumsum(a_counts)])])
        self.groups.extend(self._numbered(a, b, a_last, b_last), lengths)

    def _numbered(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> np.ndarray:
        """Numbers of the groups that close at these tokens."""
        a_first, b_first = (np.concatenate([[0], x[:-1] + 1]) for x in (a_last, b_last))
        out = np.zeros(len(a_last), np.int64)
        single = (a_first == a_last) & (b_first == b_last)
        codes, at = np.unique(a[a_last[single]] << 32 | b[b_last[single]], return_inverse=True)
        first = len(self.keys)
        new: list[tuple[tuple[int, ...], tuple[int, ...]]] = []
        known = self.group_numbers

        def number(key, one: tuple[int, ...], two: tuple[int, ...]) -> int:
            known[key] = n = first + len(new)
            new.append((one, two))
            return n

        out[single] = np.array([known[c] if c in known else number(c, (c >> 32,), (c & 0xFFFFFFFF,)) for c in codes.tolist()], np.int64)[at]
        x, y = a.tolist(), b.tolist()
        rest = np.flatnonzero(~single)
        places = zip(*(v[rest].tolist() for v in (a_first, a_last + 1, b_first, b_last + 1)))
        pairs = [(tuple(x[i:j]), tuple(y[k:m])) for i, j, k, m in places]
        out[rest] = [known[g] if g in known else number(g, *g) for g in pairs]
        if new:
            distinct = [[p << 32 | q for p in set(one) for q in set(two)] for one, two in new]
            self.pairs.extend(np.fromiter(chain.from_iterable(distinct), np.int64), np.array([len(d) for d in distinct]))
            self.keys += [f"{','.join(map(str, one))}|{','.join(map(str, two))}" for one, two in new]
            if len(self.keys) > len(self.sides):
                self.sides = np.resize(self.sides, (2 * len(self.keys), 2))
            self.sides[first : len(self.keys)] = [(len(one), len(two)) for one, two in new]
        return out


_workers: dict[tuple[str, str], Interned] = {}


class _Counts:
    """Counts by number that a task gathers: arrays are merged when many have come."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.n += len(keys)
        if self.n > 2 * GATHERED:
            self.held = [self.merged()]
            self.n = len(self.held[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([c for _, c in self.held]), len(keys)).astype(np.int64)


_DOC = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: Rows of documents (with row), of groups (keys and the documents that hold them) and of pairs
#: that a document holds in several groups (with how many groups too many).
_ALIGNED = f"{_DOC}, keys array<string>, times array<long>, pairs array<long>"


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every document's groups, and its part of the dictionary's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _workers:
            _workers[a_path, b_path] = Interned(Pair(a_path, b_path))
        own = _workers[a_path, b_path]
        row = TaskContext.get().partitionId() << 33
        docs_of, extra = _Counts(), _Counts()
        types = {"keys": pa.list_(pa.string()), "times": pa.list_(pa.int64()), "pairs": pa.list_(pa.int64()), "groups_sha256": pa.string()}
        names = [f.split()[0] for f in _ALIGNED.split(", ")]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.int64())) for n in names], names)

        def counts() -> Iterator[pa.RecordBatch]:
            groups, n = docs_of.merged()
            codes, more = extra.merged()
            for at in range(0, len(groups), 10_000):
                yield batch_of([{"keys": [own.keys[g] for g in groups[at : at + 10_000]], "times": n[at : at + 10_000]}])
            for at in range(0, len(codes), 10_000):
                yield batch_of([{"pairs": codes[at : at + 10_000], "times": more[at : at + 10_000]}])

        for batch in batches:
            if max(own.n, len(own.keys)) > SEGMENTS:
                yield from counts()
                docs_of, extra = _Counts(), _Counts()
                own.clear()
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            parts = [segments_of(t) if t else [] for t in texts]
            own.add(set(chain.from_iterable(parts)))
            numbers = np.fromiter(map(own.numbers.__getitem__, chain.from_iterable(parts)), np.int64)
            spelled = np.ones(len(parts), bool)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            if own.bad:
                spelled[np.repeat(np.arange(len(parts)), lengths)[np.isin(numbers, list(own.bad))]] = False
            every, held = own.groups.take(numbers)
            cuts = np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], np.cumsum(lengths)])]
            rows = []
            for d, doc in enumerate(ids):
                out = {"row": row, "doc_id": doc, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "keys": [], "times": []}
                rows.append(out)
                row += 1
                ordered = every[cuts[d] : cuts[d + 1]]
                if not len(ordered) or not spelled[d]:
                    continue
                group, times = np.unique(ordered, return_counts=True)
                times = times.astype(np.int64)
                a, b = own.sides[group, 0], own.sides[group, 1]
                codes, of = np.unique(own.pairs.take(group)[0], return_counts=True)
                docs_of.add(group, np.ones(len(group), np.int64))
                extra.add(codes[of > 1], of[of > 1] - 1)
                digest = hashlib.sha256(";".join(map(own.keys.__getitem__, ordered.tolist())).encode()).hexdigest()
                out |= {"n_a": int(times @ a), "n_b": int(times @ b), "n_groups": int(times.sum()), "n_links": int(times @ (a * b)), "groups_sha256": digest}
                out |= {"keys": list(map(own.keys.__getitem__, group.tolist())), "times": times}
            yield batch_of(rows)
            for s in {s for p in parts for s in p if len(s) > KEPT_CHARS}:
                del own.numbers[s]
        yield from counts()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ALIGNED)


def _links(groups: DataFrame) -> DataFrame:
    """The distinct pairs (key, docs, a, b, links) of each distinct group, with how often it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, one, two, links = [], [], [], [], []
            for key, n in zip(batch.column("key").to_pylist(), batch.column("docs").to_pylist()):
                left, _, right = key.partition("|")
                if "," in key:
                    b = Counter(right.split(",")).items()
                    some = [(x, y, k * m) for x, k in Counter(left.split(",")).items() for y, m in b]
                else:
                    some = [(left, right, 1)]
                for x, y, k in some:
                    keys.append(key)
                    docs.append(n)
                    one.append(int(x))
                    two.append(int(y))
                    links.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(c, pa.int64()) for c in (docs, one, two, links))], ["key", "docs", "a", "b", "links"])

    return groups.select("key", "docs").mapInArrow(run, "key string, docs long, a long, b long, links long")


def align(docs: DataFrame, *, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Align the tokens of two tokenizers in every document (doc_id, text).

    Both encode space+text; byte offsets where a token of A and one of B end cut the tokens into
    groups, and every A and B token of a group are linked. The count of a pair of ids is the
    number of documents that hold it linked. Returns per document: doc_id, n_a, n_b, n_groups,
    n_links, n_best (links whose count is the highest of their A id), count_sum (of the counts
    of its links) and groups_sha256 (of the groups in order, ``a1,a2|b1;a3|b2``).

    1. Tasks encode segments, once while they are kept, and return each document's distinct
       groups with their number. Per task, not per document, they return how many documents hold
       a group, and for pairs that a document holds in several groups how many are too many.
    2. The dictionary has every distinct group once. Its links are expanded once, times its
       documents, less what was counted too often: the count of each pair.
    3. The same links give each group its best links and the sum of its counts; documents get
       them by group key. The most frequent groups, of bounded number and length, are broadcast;
       the others are joined by a shuffle, in which no key is frequent.

    A text that is null or empty, or that the tokens of A or B don't spell byte by byte, has no
    tokens: zeros, and an empty digest. A null doc_id is kept. Repeated rows are documents of
    their own. Texts of any length are encoded whole. An empty table gives no rows; extra columns
    are ignored.
    """
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark, "align")
    every = scratch.save(_aligned(docs, *(vocabularies or default_vocabularies())))
    aligned = every.where("row IS NOT NULL")
    listed = every.where("row IS NULL AND keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "times")).alias("g"))
    groups = scratch.save(listed.groupBy(F.col("g.keys").alias("key")).agg(F.sum("g.times").alias("docs")))
    links = scratch.save(_links(groups))
    held = every.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    twice = held.select(F.shiftrightunsigned(F.col("p.pairs"), 32).alias("a"), F.col("p.pairs").bitwiseAND(0xFFFFFFFF).alias("b"), (-F.col("p.times")).alias("docs"))
    counts = scratch.save(links.select("a", "b", "docs").unionByName(twice).groupBy("a", "b").agg(F.sum("docs").alias("count")))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    known = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    figures = links.join(known, ["a", "b"]).groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best"), F.sum(F.col("links") * F.col("count")).alias("total"), F.max("docs").alias("docs")
    )
    figures = scratch.save(figures)
    short = figures.where(F.length("key") <= HOT_CHARS).orderBy(F.desc("docs"), "key").limit(HOT_GROUPS).drop("docs")
    hot = scratch.save(short)
    own = aligned.select("row", F.explode(F.arrays_zip("keys", "times")).alias("g")).select("row", F.col("g.keys").alias("key"), F.col("g.times").alias("times"))
    met = own.join(F.broadcast(hot), "key", "left")
    sums = [F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum")]
    often = met.where("total IS NOT NULL").groupBy("row").agg(*sums)
    rare = scratch.save(met.where("total IS NULL").select("row", "key", "times"))
    seldom = rare.join(figures, "key").groupBy("row").agg(*sums)
    both = often.unionByName(seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.select(*(f.split()[0] for f in _DOC.split(", "))).join(both, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between the byte-level and the piece vocabulary."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
