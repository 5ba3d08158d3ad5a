"""PII: identifiers in the text as it stands and in its deobfuscated form, with source offsets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tune

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")
# A match never begins inside a run of digits or local characters, since the same match from
# the run's start is further left; the lookbehind keeps long runs from being tried at each place.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Check-digit test of card numbers."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the identifiers written plainly, by kind and then start."""
    out = [(0, *span) for span in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# Characters that look like ASCII ones, and characters that show nothing.
_LOOKALIKES = (
    ("АВЕЅІЈКМНОРСТХУ", "ABESIJKMHOPCTXY"),  # Cyrillic capitals
    ("аеѕіјорсухһԁкмтвԛԝѵ", "aesijopcyxhdkmtbqwv"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("αονικρτυω", "aovikptuw"),  # Greek small letters
    ("ɡıɑ", "gia"),  # other Latin letters
    ("﹫", "@"),
    ("。․﹒", "..."),
    ("‐‑‒–—−", "------"),
    ("﹢", "+"),
    ("\u00a0\u2002\u2003\u2007\u2009\u202f\u3000", " " * 7),
)
_HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
# Spelled digits.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

#: Full-width forms, circled letters, and mathematical letters and digits fold to what they stand for.
_STYLED = (range(0xFF01, 0xFF5F), range(0x24B6, 0x24EA), range(0x1D400, 0x1D800))
#: Blocks of ten digits in other scripts, by their zero.
_ZEROS = (0x0660, 0x06F0, 0x0966)
_FOLD = {a: b for k, v in _LOOKALIKES for a, b in zip(k, v, strict=True)} | dict.fromkeys(_HIDDEN, "")
_FOLD |= {chr(z + d): str(d) for z in _ZEROS for d in range(10)}
_FOLD |= {chr(c): n for r in _STYLED for c in r if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}
_ODD = re.compile("[^\\x00-\\x7f]")
_FOLDED = frozenset(_FOLD)

_WORD = "(?:" + "|".join(_SPELLED) + ")"
_GAP = r"(?:[\s,.()-]{1,3}|\s{1,3}(?:dot|point)\s{1,3})"
_RUN = re.compile(rf"(?<![A-Za-z])(?:plus[\s,-]{{1,3}})?(?:{_WORD}|(?<![0-9])[0-9]+)(?:{_GAP}(?:{_WORD}|[0-9]+)(?![A-Za-z]))+", re.I)
_PART = re.compile(rf"{_WORD}|[0-9]+|plus|dot|point", re.I)
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_BARE = r"(?:\s{1,3}|[_*-]{1,2})"
#: Rewrites of disguised separators, in order; a lookahead or group keeps prose as it is.
_RULES = (
    (re.compile(rf"(?<=[A-Za-z0-9]){_OPEN}(?:at|@|arroba){_CLOSE}(?=[A-Za-z0-9])", re.I), "@"),
    (re.compile(rf"(?<=[A-Za-z0-9]){_OPEN}(?:dot|\.|punkt|point|punto){_CLOSE}(?=[A-Za-z0-9])", re.I), "."),
    (re.compile(r"&#0*64;|&#x0*40;|&commat;", re.I), "@"),
    (re.compile(r"&#0*46;|&#x0*2e;|&period;", re.I), "."),
    (re.compile(r"(?<=[0-9])\s{1,3}(?:dot|point)\s{1,3}(?=[0-9])", re.I), "."),
    (re.compile(rf"(?<=[A-Za-z0-9]){_BARE}at{_BARE}(?=[A-Za-z0-9-]+(?:{_BARE}dot{_BARE}|\.)[A-Za-z]{{2,}})", re.I), "@"),
    (re.compile(rf"(?<=[A-Za-z0-9])\s{{0,2}}@\s{{0,2}}(?=[A-Za-z0-9-]+\s{{0,2}}\.\s{{0,2}}[A-Za-z]{{2,}}|[A-Za-z0-9-]+{_BARE}dot)", re.I), "@"),
    (re.compile(r"(@[A-Za-z0-9-]+)\s{1,2}\.\s{1,2}(?=[A-Za-z]{2,})"), r"\1."),
)
_DOT = re.compile(rf"{_BARE}dot{_BARE}(?=[A-Za-z0-9._%+-])", re.I)
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-.")
_SIGNS = re.compile(r"[\[({<]\s{0,3}(?:at|@|arroba|dot|\.|punkt|point|punto)\s{0,3}[\])}>]|&#0*(?:64|46);|&#x0*(?:40|2e);|&(?:commat|period);|\s@|@\s|[\s_*-](?:dot|point)[\s_*-]|[\s_*-]at[\s_*-]{1,3}[a-z0-9-]+(?:\.|[\s_*-]{1,3}dot)|@[a-z0-9-]+\s{1,2}\.", re.I)

#: In every run that is rewritten, a spelled digit stands beside another digit.
_NUMBER = re.compile(rf"{_WORD}{_GAP}(?:{_WORD}|[0-9])|[0-9]{_GAP}{_WORD}", re.I)
_PLUS, _POINT = re.compile(r"plus[\s,-]{1,3}", re.I), re.compile(r"\s{1,3}(?:dot|point)\s{1,3}", re.I)


class Tracked:
    """A text under rewriting, with each character's span in the source (8 bytes a character)."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int32)
        self.end = self.start + 1

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str]) -> bool:
        """Replace every match; what replaces it stands for the whole span of the match."""
        parts: list[str] = []
        start: list[np.ndarray] = []
        end: list[np.ndarray] = []
        last = 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new == m[0]:
                continue
            a, b = m.span()
            parts += (self.text[last:a], new)
            one = len(new) == b - a
            start += (self.start[last:a], self.start[a:b] if one else np.full(len(new), self.start[a], np.int32))
            end += (self.end[last:a], self.end[a:b] if one else np.full(len(new), self.end[b - 1], np.int32))
            last = b
        if not parts:
            return False
        self.text = "".join([*parts, self.text[last:]])
        self.start, self.end = np.concatenate([*start, self.start[last:]]), np.concatenate([*end, self.end[last:]])
        return True


def _dots(text: str) -> set[int]:
    """Places of disguised dots that stand in the name or the domain of an address.

    A dot belongs to a domain if only domain characters and such dots lie between it and an @
    before it, and to a name likewise with an @ after it. Each character is looked at once a side.
    """
    found = [m for m in _DOT.finditer(text)]
    out = set()
    before = (0, False)
    for m in found:
        at = m.start()
        while at > before[0] and text[at - 1] in _NAME_CHARS:
            at -= 1
        ok = (at > 0 and text[at - 1] == "@" and at < m.start()) if at > before[0] else before[1]
        if ok and text[m.end()].isalnum():
            out.add(m.start())
        before = (m.end(), m.start() in out)
    after = (len(text), False)
    for m in reversed(found):
        at = m.end()
        while at < after[0] and text[at] in _LOCAL_CHARS:
            at += 1
        ok = (at < len(text) and text[at] == "@") if at < after[0] or at == len(text) else after[1]
        if ok and m.start() and text[m.start() - 1].isalnum():
            out.add(m.start())
        after = (m.start(), ok)
    return out


def _digits(m: re.Match) -> str:
    """Digits of a run that spells some of them.

    Runs of fewer than three spelled digits stay unless an identifier needs one of these; the
    separators stay where it needs them.
    """
    parts = [p.lower() for p in _PART.findall(m[0])]
    spelled = sum(p in _SPELLED for p in parts)
    if not spelled:
        return m[0]
    signs = {"plus": "+", "dot": ".", "point": "."}
    joined = "".join(signs.get(p) or _SPELLED.get(p, p) for p in parts)
    before = "+" if m.start() and m.string[m.start() - 1] == "+" else ""
    spaced = _POINT.sub(".", _PLUS.sub("+", m[0]))
    for pieces in ([signs.get(p, p) for p in parts], re.split(rf"({_WORD})", spaced, flags=re.I)):
        out, at = before, []
        for p in pieces:
            if p.lower() in _SPELLED:
                at.append(len(out))
            out += _SPELLED.get(p.lower(), p)
        if any(a <= x < b for _, a, b in identifiers(out) for x in at):
            return out[len(before) :]
    return joined if spelled >= 3 else m[0]


def disguised(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the source of identifiers that only the normal form shows.

    Homoglyphs and hidden characters, spelled digits, and at/dot disguises are rewritten one
    after the other, each rewrite carrying the source span of every character along.
    """
    t = Tracked(text)
    changed = not text.isascii() and not _FOLDED.isdisjoint(text) and t.rewrite(_ODD, lambda m: _FOLD.get(m[0], m[0]))
    if _NUMBER.search(t.text):
        changed |= t.rewrite(_RUN, _digits)
    if not (changed or _SIGNS.search(t.text)):
        return []
    for rule, to in _RULES:
        changed |= t.rewrite(rule, lambda m, to=to: m.expand(to))
    if dots := _dots(t.text):
        changed |= t.rewrite(_DOT, lambda m: "." if m.start() in dots else m[0])
    if not changed:
        return []
    return [(k, int(t.start[a]), int(t.end[b - 1])) for k, a, b in identifiers(t.text)]


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """All spans as (kind, start, end, plain), by kind and start; a plain span wins an overlap."""
    plain = identifiers(text)
    out = [(*s, True) for s in plain]
    if more := sorted(disguised(text)):
        at, last = 0, (-1, 0)
        for k, a, b in more:  # both are in order of kind and start
            while at < len(plain) and (plain[at][0] < k or (plain[at][0] == k and plain[at][2] <= a)):
                at += 1
            free = at == len(plain) or plain[at][0] > k or plain[at][1] >= b
            if free and not (last[0] == k and a < last[1]):
                out.append((k, a, b, False))
                last = (k, b)
    return sorted(out)


_SPANS = "array<struct<kind:int,start:long,end:long,plain:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data of every whole text: (doc_id, spans).

    A span has kind (index in KINDS), start and end in code points of the source (end
    exclusive), and plain (found in the text as it stands). Null and empty texts have none; a
    null doc_id is kept; repeated rows give repeated rows; an empty table gives no rows; extra
    columns are ignored. Time and memory follow a text's length. On ties between a plain and a
    disguised reading of a place the plain one stays.
    """
    tune(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "plain"), s)) for s in spans(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPAN_TYPE)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"doc_id long, spans {_SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; n_chars follows the text.

    Of overlapping spans of two kinds the one that starts first is replaced, and the other's rest
    is left out with it. Null and empty texts, null ids, repeated rows and extra columns stay as
    they are; an empty table stays empty.
    """
    tune(docs.sparkSession)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, last = [], 0
        for a, b, k in sorted((s[1], s[2], s[0]) for s in spans(t)):
            if a >= last:
                out += (t[last:a], f"<{KINDS[k].upper()}>")
            last = max(last, b)
        return "".join([*out, t[last:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(n, batch.schema.field(n), pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(scan, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of all documents."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    plain = F.filter("spans", lambda s: s["plain"])
    of_kind = lambda i: F.size(F.filter(plain, lambda s: s["kind"] == i))
    count = [of_kind(i).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(joined(plain).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
