"""Archives: exact round trips with payloads that hold records, at splits of every size."""

import base64
import hashlib
import re

import numpy as np
import pytest

from peakloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    """Rows of the contract, by a plain loop."""
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for html, pages in groups.items():
        n = len(html.encode())
        pages = sorted(pages, key=lambda p: (p is None, p))
        for i, p in enumerate(pages):
            revisit = i > 0 and n >= least
            out.append((p, n, digest(html), "revisit" if revisit else "response", pages[0] if revisit else None))
    return sorted(out, key=repr)


def tricky():
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:fake>\r\nX-Page-ID: 999\r\nContent-Length: 5\r\n\r\nfalse\r\n\r\n"
    rng = np.random.default_rng(3)
    bits = ["\r\n", "\n", "\r", "WARC/1.", "WARC/1.0\r\n", record, "\r\n" + record, "Content-Length: 12\r\n\r\n", "\r\n\r\n", "é", "日本", "x" * 50, " "]
    rows = [(i, f"http://h/{i} \r\n{'WARC/1.1' if i % 3 else ''}", "".join(rng.choice(bits, int(rng.integers(0, 12))))) for i in range(200)]
    rows += [(500, None, None), (501, "u", ""), (None, None, "text"), (None, "v", "text"), (7, "again", rows[7][2]), (7, "again", rows[7][2]), (-4, "n", "text"), (502, "u", record * 40), (503, "u", "\r\n" + record * 3)]
    return rows


@pytest.mark.parametrize(("split", "least"), [(1 << 12, 0), (1 << 27, 30)])
def test_round_trip(spark, tmp_path, split, least):
    rows = tricky()
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "w"), least_bytes=least, per_file=40)
    spark.conf.set(key, str(split))
    try:
        got = warc.resolved(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    finally:
        spark.conf.set(key, before)
    assert not [r for r in got if not (r["whole"] and r["declared"] == r["payload_digest"])]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == expected(rows, least)
    assert len({r["record_id"] for r in got}) == len(rows)


def test_chains_of_foreign_files(spark, tmp_path):
    """Other versions and fields, payloads without an HTTP head, and a file that ends too early."""
    head = lambda n, more="": f"WARC/1.0\r\nWARC-Type:  resource \r\n{more}content-length: {n}\r\n\r\n"
    inner = head(3) + "abc\r\n\r\n"
    parts = [head(len(inner)) + inner + "\r\n\r\n", head(0) + "\r\n\r\n", head(4, "WARC-Target-URI: WARC/1.x\r\n") + "WARC\r\n\r\n", head(100) + "cut"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc").write_text("".join(parts), newline="")
    (tmp_path / "f" / "b.warc").write_text("no record\r\n" + parts[1], newline="")
    got = sorted(warc.read_warc(spark, str(tmp_path / "f")).collect(), key=lambda r: r["offset"])
    assert [(r["offset"], r["payload_bytes"], r["whole"]) for r in got] == [(0, len(inner), True), (len(parts[0]), 0, True), (len("".join(parts[:2])), 4, True), (len("".join(parts[:3])), 3, False)]
    assert got[0]["payload_digest"] == digest(inner) and got[0]["record_type"] == "resource" and got[2]["target"] == "WARC/1.x"


def test_pointers_reach_what_a_walk_reaches(spark):
    from peakloom.sources.shared import Scratch

    rng = np.random.default_rng(5)
    rows, truth = [], set()
    for file in range(6):
        offsets = sorted({0, *rng.integers(1, 4000, 300).tolist()} if file else set(rng.integers(1, 4000, 300).tolist()))
        following = {}
        for i, o in enumerate(offsets):
            following[o] = int(offsets[min(len(offsets) - 1, i + int(rng.choice([1, 1, 1, 2, 5])))]) if rng.random() < 0.98 and i + 1 < len(offsets) else 9000
            rows.append((str(file), o // 500, o, following[o]))
        at = 0
        while at in following:
            truth.add((str(file), at))
            at = following[at]
    df = spark.createDataFrame(rows, "file string, block long, offset long, next long")
    got = {(r["file"], r["offset"]) for r in warc.reachable(df, Scratch(spark, "t")).collect()}
    assert got == truth and len(truth) > 100


def test_empty_and_clashing(spark, tmp_path):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], SCHEMA)
    warc.write_warc(empty, str(tmp_path / "e"))
    assert warc.resolved(warc.read_warc(spark, str(tmp_path / "e"))).count() == 0
    long = "long é " * 300_000
    clash = spark.createDataFrame([(1, "u", long), (2, "u", long)], SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "payload", "word", "key", "maybe", "copy", "value", "file", "block", "record_type")})
    warc.write_warc(clash, str(tmp_path / "c"))
    got = warc.resolved(warc.read_warc(spark, str(tmp_path / "c"))).collect()
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in got) == [(1, "response", 2_400_000), (2, "revisit", 2_400_000)]


def test_bitmap_never_misses(spark):
    from pyspark.sql import functions as F

    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    seen = warc.marked(spark.range(6000), F.xxhash64("id"), warc.bits_of(keys))
    assert seen.where("maybe AND id < 3000").count() == 3000 and seen.where("maybe AND id >= 3000").count() < 100
    assert re.fullmatch("[A-Z2-7]{32}", spark.range(1).select(warc.base32(F.sha1(F.lit("a")))).first()[0])
