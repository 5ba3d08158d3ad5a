"""Web archives: records written as text of any store, and read back by verified boundary chains.

Writing and reading are DataFrame expressions; files go through Spark's text source, so they are
split, retried and committed like any other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: What separates chunks: the end of a record's last line, and the first characters of the next.
#: It has no border, so that a reader that falls back inside a half match cannot miss it.
MAGIC, BREAK = "WARC/1.", "\r\nWARC/1."
#: Rows of a bitmap of 64-bit words: it is broadcast, and this many rows are its bound.
WORDS = 1 << 16
#: Bytes of a cell that chunks and records of several chunks meet in.
CELL = 1 << 20
# Fixed value: the profile of records that repeat a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hex: five hex digits are four digits of it."""
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# --- bitmaps of keys ------------------------------------------------------------------------


def bits_of(keys: DataFrame) -> DataFrame:
    """Bitmap (word, bits) of a column ``key`` of 64-bit hashes; at most WORDS rows."""
    word, bit = F.pmod("key", F.lit(WORDS)).alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(key, 20), 64) as int))")
    return keys.groupBy(word).agg(F.bit_or(bit).alias("bits"))


def marked(df: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """``df`` with a column ``maybe``: false if the bitmap cannot hold the row's key."""
    hashed = df.withColumn("key", key).withColumn("word", F.pmod("key", F.lit(WORDS)))
    joined = hashed.join(F.broadcast(bits), "word", "left")
    held = F.expr("shiftrightunsigned(bits, cast(pmod(shiftrightunsigned(key, 20), 64) as int)) & 1L")
    return joined.withColumn("maybe", F.coalesce(held == 1, F.lit(False))).drop("word", "bits", "key")


# --- writing --------------------------------------------------------------------------------


def _uri(url: Column) -> Column:
    """The address with spaces and controls in percent form: it must stay on its line."""
    out = url
    for c in [*range(33), 127]:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url)


def _record(date: str) -> Column:
    """Text of a record, without the blank line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    optional = lambda name, value: F.when(value.isNull(), "").otherwise(line(name, value))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("record_id"))), line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", _uri(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
        optional("X-Page-ID", F.col("page_id").cast("string")), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )


def _name(page: str, url: str, copy: Column) -> Column:
    """Record name of a row, in the form of a UUID."""
    h = F.md5(F.concat_ws("\x00", F.coalesce(F.col(page).cast("string"), F.lit("")), F.coalesce(url, F.lit("\x01")), "digest", copy.cast("string")))
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def write_warc(pages: DataFrame, folder: str, *, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", per_file: int = 100_000) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to a new ``folder``.

    Of rows with equal payloads of ``least_bytes`` or more, the one with the smallest page_id is
    a response and the others revisit it, without its payload. Payloads are told apart by length
    and SHA-1. No payload is shuffled unless another row may have the same: a bitmap of the
    repeated digests, of bounded size, lets the others through as responses at once; of those
    it holds, each task sends one payload per digest.

    A null html is an empty payload. A null url gives no target; spaces and controls in it are
    written in percent form. A null page_id is written without one and counts as the largest;
    of rows with the same page_id and payload one is the response. A file holds ``per_file``
    records at most. No rows give no records. Extra columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"), F.octet_length(html).cast("long").alias("n_bytes"))
    named = named.withColumn("digest", F.sha1("payload")).withColumn("digest", base32(F.col("digest")))
    same, large = ["digest", "n_bytes"], F.col("n_bytes") >= least_bytes
    repeated = named.where(large).groupBy(*same).agg(F.count("*").alias("n")).where("n > 1")
    bits = scratch.save(bits_of(repeated.select(F.xxhash64(*same).alias("key"))))
    told = marked(named, F.xxhash64(*same), bits).withColumn("maybe", F.col("maybe") & large)
    lone = told.where("NOT maybe")
    small = F.col("n_bytes") < least_bytes
    shared = told.where("maybe")
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    classes = scratch.save(shared.groupBy(*same, "page_id", "url").agg(F.count("*").alias("copies")))
    firsts = scratch.save(classes.groupBy(*same).agg(F.min(order).alias("first")))
    typed = (
        classes.join(firsts, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .withColumn("record_type", F.when((order == F.col("first")) & (F.col("copy") == 1), "response").otherwise("revisit"))
        .withColumns({"first_id": F.col("first.page_id"), "first_url": F.col("first.url")})
        .withColumns({"record_id": _name("page_id", "url", F.col("copy")), "refers_to": _name("first_id", "first_url", F.lit(1))})
    )
    payloads = shared.groupBy(*same).agg(F.first("payload").alias("payload"))
    columns = ["page_id", "url", *same, "record_type", "record_id", "refers_to", "payload"]
    # Small payloads may repeat in rows that are equal throughout: their names need no order, only to differ.
    copy = F.when(small, F.monotonically_increasing_id()).otherwise(F.lit(1).cast("long"))
    alone = lone.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("string"), "record_id": _name("page_id", "url", copy)})
    responses = typed.where("record_type = 'response'").join(payloads, same)
    revisits = typed.where("record_type = 'revisit'").withColumn("payload", F.lit(""))
    records = alone.select(*columns).unionByName(responses.select(*columns)).unionByName(revisits.select(*columns))
    records.select(_record(date).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(folder)
    scratch.drop(bits, classes, firsts)


# --- reading --------------------------------------------------------------------------------


def _facts(df: DataFrame) -> DataFrame:
    """What a record's text ``body`` (after the magic) says, as columns.

    A head without its blank line, or without a length, is none: its ``length`` is null.
    """
    field = lambda name, value=r"(\S[^\r\n]*?)": F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*{value}[ \t]*\r?$", 1), F.lit(""))
    df = df.withColumn("text", F.concat("body", F.lit("\r\n"))).withColumn("head", F.substring_index("text", "\r\n\r\n", 1))
    df = df.withColumn("head_bytes", F.octet_length("head").cast("long"))
    df = df.withColumn("head", F.when(F.col("head_bytes") + 4 <= F.octet_length("text"), F.col("head"))).drop("text")
    df = df.withColumns({
        "length": field("Content-Length", "([0-9]{1,18})").cast("long"), "record_type": F.lower(field("WARC-Type")), "record_id": field("WARC-Record-ID"), "target": field("WARC-Target-URI"),
        "declared": field("WARC-Payload-Digest", "(?:sha1:)?([A-Z2-7]{32})"), "refers": field("WARC-Refers-To"), "page_id": field("X-Page-ID", "(-?[0-9]+)").cast("long"), "content": field("Content-Type"),
    }).drop("head")
    df = df.withColumn("whole", F.col("length").isNotNull() & (F.col("head_bytes") + 4 + F.col("length") <= F.octet_length("body")))
    inside = F.expr("substring(cast(body as binary), cast(head_bytes + 5 as int), cast(length as int))")
    df = df.withColumn("inside", F.when(F.col("length").isNotNull(), inside))
    http = F.lower("content").startswith("application/http")
    df = df.withColumn("payload", F.when(http, F.substr("inside", F.octet_length(F.substring_index(F.col("inside").cast("string"), "\r\n\r\n", 1)) + 5)).otherwise(F.col("inside"))).withColumn("sha1", F.sha1("payload"))
    return df.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32(F.col("sha1"))}).drop("inside", "content", "payload", "sha1")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the files between breaks: (file, block, id, size, value)."""
    return spark.read.option("lineSep", BREAK).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.octet_length("value").cast("long").alias("size"), "value"
    )


def _body(opens: Column) -> Column:
    """A chunk after its magic, which only a file's first chunk still holds."""
    return F.when(opens, F.substr("value", F.lit(len(MAGIC) + 1))).otherwise(F.col("value"))


def _placed(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """Chunks with the offset of the magic before them; sums run per split, and splits' totals per file."""
    ends = chunks.groupBy("file", "block").agg(F.sum(F.col("size") + len(BREAK)).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    within = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    inside = chunks.withColumn("inside", F.coalesce(F.sum(F.col("size") + len(BREAK)).over(within), F.lit(0)))
    start = F.col("base") + F.col("inside")
    placed = inside.join(base, ["file", "block"]).withColumn("offset", F.when(start == 0, start).otherwise(start - len(MAGIC)))
    candidate = F.col("length").isNotNull() & (F.col("opens") == (F.col("offset") == 0))
    following = F.col("offset") + len(MAGIC) + F.col("head_bytes") + 4 + F.col("length") + 4
    return scratch.save(placed.withColumn("next", F.when(candidate, following)).drop("base", "inside"))


def reachable(candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``candidates`` (file, block, offset, next), those on the chain from offset 0 of their file.

    Candidates of a split that follow one upon the other are one run, so that a file of sound
    records is as many runs as splits. A run is left by one pointer, to a place in another run;
    pointers are doubled until nothing new is reached: rounds grow with the logarithm of a
    file's runs, and a round shuffles runs alone. What starts inside a payload has no record that
    points to it from the file's start, and is left out.
    """
    order = Window.partitionBy("file", "block").orderBy("offset")
    parted = candidates.withColumn("parted", F.coalesce(F.lag("next").over(order) != F.col("offset"), F.lit(True)))
    placed = scratch.save(parted.withColumn("run", F.max(F.when(F.col("parted"), F.col("offset"))).over(order)).drop("parted"))
    exits = placed.groupBy("file", "run").agg(F.max("next").alias("exit"))  # offsets, and so successors, ascend in a run
    doors = placed.select("file", F.col("offset").alias("exit"), F.col("run").alias("to"))
    jump = scratch.save(exits.join(doors, ["file", "exit"]).select("file", "run", "to", F.col("exit").alias("entry")))
    reach = scratch.save(placed.where("offset = 0").select("file", "run", F.col("offset").alias("entry")))
    while True:
        new = scratch.save(reach.drop("entry").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry"))
        if new.isEmpty():
            break
        reach = reach.unionByName(new)
        a, b = jump.select("file", "run", F.col("to").alias("via")), jump.select("file", F.col("run").alias("via"), "to", "entry")
        jump = scratch.save(a.join(b, ["file", "via"]).select("file", "run", "to", "entry"))
    return placed.join(reach, ["file", "run"]).where("offset >= entry").drop("run", "entry")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives in ``folder``, found by their chains.

    Returns file, offset, record_type, record_id, page_id, target, refers (the record that a
    revisit names), length (of the block), declared (SHA-1 that the head gives), payload_bytes
    and payload_digest (of the bytes that are there), and whole (false if the file ends before
    the block does; its payload is then the part that is there).

    Any text that looks like the start of a record gives a candidate with its successor's
    offset; only candidates on the chain from a file's start are records, so a whole record
    inside a payload is none. Sums run in the JVM as the splits are read. Payloads aren't shuffled,
    but for records that hold a break themselves: their chunks are looked up by content, after a
    bounded bitmap has sorted out the rest, and joined in order.

    A file that doesn't start with a record has none; a chain ends where no record follows. An
    empty or missing head field is null. An empty folder gives no rows.
    """
    scratch = Scratch(spark, "records")
    keep = ["file", "block", "id", "size", "opens", "head_bytes", "length", "record_type", "record_id", "target", "declared", "refers", "page_id", "whole", "payload_bytes", "payload_digest"]
    same = {"h1": F.xxhash64("value"), "h2": F.xxhash64(F.lit(1), "value")}
    raw = _chunks(spark, folder).withColumns(same)
    opens = (F.col("block") == 0) & F.col("value").startswith(MAGIC)  # another chunk that does is no record
    chunks = scratch.save(_facts(raw.withColumn("opens", opens).withColumn("body", _body(F.col("opens")))).select(*keep, "h1", "h2"))
    placed = _placed(chunks, scratch)
    chain = reachable(placed.where("next IS NOT NULL").select("file", "block", "offset", "next"), scratch)
    out = ["file", "offset", "record_type", "record_id", "page_id", "target", "refers", "length", "declared", "payload_bytes", "payload_digest", "whole"]
    records = scratch.save(placed.join(chain.select("file", "offset"), ["file", "offset"]).select(*out, "next"))
    scratch.drop(chunks)
    long = records.where("NOT whole").select("file", "offset", "next")
    if long.isEmpty():
        return records.select(*out)
    cells = long.select("file", F.col("offset").alias("record"), "next", F.explode(F.sequence(F.floor(F.col("offset") / CELL), F.floor((F.col("next") - 1) / CELL))).alias("cell"))
    parts = placed.select("file", F.col("offset").alias("at"), F.floor(F.col("offset") / CELL).alias("cell"), "h1", "h2")
    parts = scratch.save(parts.join(cells, ["file", "cell"]).where("at >= record AND at < next").select("file", "record", "at", "h1", "h2"))
    bits = scratch.save(bits_of(parts.select(F.xxhash64("h1", "h2").alias("key"))))
    held = marked(raw.select("h1", "h2", "value"), F.xxhash64("h1", "h2"), bits).where("maybe")
    values = held.groupBy("h1", "h2").agg(F.first("value").alias("value"))
    pieces = parts.join(values, ["h1", "h2"]).select("file", "record", "at", _body(F.col("at") == 0).alias("body"))
    pieces = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("all"))
    joined = pieces.select("file", F.col("record").alias("offset"), F.array_join(F.transform("all", lambda p: p["body"]), BREAK).alias("body"))
    return records.where("whole").select(*out).unionByName(_facts(joined).select(*out))


def resolved(records: DataFrame) -> DataFrame:
    """Records with what their payload says: a revisit has the bytes and digest of the record it names.

    Adds refers_to (that record's page_id). A revisit whose record isn't there has nulls.
    """
    scratch = Scratch(records.sparkSession, "resolved")
    saved = scratch.save(records)
    known = saved.where("record_type = 'response'").select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("own_bytes"), F.col("payload_digest").alias("own_digest")
    )
    revisit = F.col("record_type") == "revisit"
    others = saved.where(revisit).drop("payload_bytes", "payload_digest").join(known, "refers", "left")
    others = others.withColumnsRenamed({"own_bytes": "payload_bytes", "own_digest": "payload_digest"})
    return saved.where(~revisit).withColumn("refers_to", F.lit(None).cast("long")).unionByName(others)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    folder = f"{Scratch(spark, 'archive').root}/warc"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return resolved(read_warc(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
n AS (SELECT page_id, html, sha1(html) AS h, row_number() OVER (PARTITION BY html ORDER BY page_id) AS nth, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN first END AS refers_to
FROM n
"""
