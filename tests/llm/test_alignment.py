"""Alignment of two tokenizers against whole encodings and plain counting."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from peakloom.llm import alignment

from ..conftest import DATA

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def encoders():
    a_path, b_path = alignment.default_vocabularies()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    back = {}
    later = 256
    for byte in range(256):  # the byte-level alphabet, as published
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte:
            back[chr(byte)] = byte
        else:
            back[chr(later)] = byte
            later += 1
    return a, b, back


def plain(text, encoders):
    """Groups of one whole text, from the offsets of whole encodings."""
    a, b, back = encoders
    if not text:
        return []
    whole = (" " + text).encode()
    one = a.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in one.ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if b"".join(x for _, x in one) != whole or b"".join(x for _, x in two) != whole:
        return []
    ends_a, ends_b = (np.cumsum([len(x) for _, x in s]) for s in (one, two))
    common = np.intersect1d(ends_a, ends_b)
    groups = [([], []) for _ in common]
    for k, (tokens, ends) in enumerate(((one, ends_a), (two, ends_b))):
        for (i, _), e in zip(tokens, ends):
            groups[np.searchsorted(common, e)][k].append(i)
    return groups


def truth(rows, encoders):
    grouped = [plain(t, encoders) for _, t in rows]
    counts = Counter()
    for groups in grouped:
        counts.update({(x, y) for a, b in groups for x in a for y in b})
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc, _), groups in zip(rows, grouped):
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=repr)


def odd_texts(n=400):
    rng = np.random.default_rng(7)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "a", "The", "word", "don't", "123", "45", ".", ",,", "é", "ﬁ", "日本語", "🙂", "👩‍👩‍👧", "é", "<|endoftext|>", "<s>", "<0x41>", "</s>", "\x00", "aaaa", "==", "'s", "'S", "Ñ", " "]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 25)))) for _ in range(n)]
    return [*texts, "▁", "a ▁b", " ", "   ", "", None, "x" * 5000, "日本" * 3000, "word " * 3000, "a\n b", "a\n  b ", " lead", "trail "]


@pytest.mark.parametrize("kept", [400_000, 20])
def test_against_whole_encodings(spark, encoders, monkeypatch, kept):
    rows = list(enumerate(odd_texts())) + [(None, "The word."), (3, "The word."), (3, "The word.")]
    monkeypatch.setattr(alignment, "SEGMENTS", kept)
    monkeypatch.setattr(alignment, "HOT_GROUPS", 20)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in alignment.align(df.withColumns({c: F.lit("x") for c in ("row", "keys", "key", "times", "a", "docs")})).collect()), key=repr)
    want = truth(rows, encoders)
    assert len(got) == len(want)
    assert not [(g, w) for g, w in zip(got, want) if g != w]


def test_whole_table(spark, encoders):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted((tuple(r) for r in alignment.op12_alignment(spark, DATA).collect()), key=repr)
    assert got == truth(rows, encoders) and sum(g[4] for g in got) > 10_000


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segments_join_to_the_text():
    for t in odd_texts():
        if t:
            parts = alignment.segments_of(t)
            assert "".join(" " + p for p in parts) == " " + t
            assert all(p and not p[-1].isspace() for p in parts[:-1])
