"""Secret scans: known shapes by pattern, and random-looking tokens by a battery of tests.

Only DataFrame and SQL functions are used: everything runs inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

# Patterns of known shapes, in the order in which spans of one start are listed.
# A run of at least so many characters is the same as a longest run that is then measured.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: Kind of the spans that the battery adds.
RANDOM = "random"
#: Tokens that the battery tests, if they hold a digit and a letter.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
# Shapes and alphabets of the encodings that are inferred, most narrow first.
ALPHABETS = (
    ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="),
)
# Letters of English text per thousand, and the shares of digits and of capitals
# among the characters of ordinary names.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)))
DIGITS, CAPITALS = 0.1, 0.1
#: Steps of -log10(p) by which p-values are counted.
STEP = 0.1
#: A token is no random string of its encoding if the battery finds less than this p.
LEAST_P = 0.01


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under ``join``, by doubling: time n log n, with no loop over rows."""
    for k in range(31):
        values = _bound(values, _doubled(1 << k, join))
    return values


def _doubled(step: int, join: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """Joins every element of an array with the one ``step`` places before it."""

    def use(a: Column) -> Column:
        return F.when(F.size(a) <= step, a).otherwise(F.transform(a, lambda x, i: F.when(i >= step, join(x, F.get(a, i - step))).otherwise(x)))

    return use


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, value) of a pattern's matches, leftmost and not overlapping.

    Spark has no function for the places of all matches; they follow from the lengths of the
    matches and of the pieces between them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), F.transform(found, lambda x: F.length(x)), lambda g, m: g + m)
    spans = F.zip_with(_running(steps, lambda x, y: x + y), found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), m.alias("value")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))


def _apart(tokens: Column, known: Column) -> Column:
    """Those of ``tokens`` that touch none of ``known``, in order of start.

    Both are sorted as one; the farthest end of known spans before a token and the next start
    of one after it tell, so time follows the number of spans.
    """
    none = 1 << 30
    every = F.array_sort(F.concat(
        F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("until"), F.lit(none).alias("next"), s["value"].alias("value"))),
        F.transform(known, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["end"].alias("until"), s["start"].alias("next"), F.lit(None).cast("string").alias("value"))),
    ))

    def clear(a: Column) -> Column:
        before = _running(F.transform(a, lambda s: s["until"]), F.greatest)
        behind = F.reverse(_running(F.reverse(F.transform(a, lambda s: s["next"])), F.least))
        marked = F.transform(F.arrays_zip(a.alias("s"), before.alias("before"), behind.alias("behind")), lambda z: z)
        free = F.filter(marked, lambda z: z["s"]["value"].isNotNull() & (z["before"] <= z["s"]["start"]) & (z["behind"] >= z["s"]["end"]))
        return F.transform(free, lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["end"].alias("end"), z["s"]["value"].alias("value")))

    return _bound(every, clear)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic approximation."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _inferred(token: Column, use: Callable[[Column, str], Column]) -> Column:
    """``use`` of the token and the alphabet of its encoding."""
    case = None
    for shape, alphabet in ALPHABETS:
        value = use(F.lower(token) if len(alphabet) in (16, 36) else token, alphabet)
        case = F.when(token.rlike(shape), value) if case is None else (case.when(token.rlike(shape), value) if shape else case.otherwise(value))
    return case


def _tested(token: Column) -> Column:
    """Smallest p, times three, of the battery on a token under "random in its encoding".

    Chi-squared for uniform use of the alphabet, runs of codes above and below the middle, and
    lag-one serial correlation of the codes; each takes time in proportion to the length.
    """
    return F.least(F.lit(1.0), 3 * _inferred(token, _battery))


def _evidence(token: Column) -> Column:
    """-log10 of a p-value under "ordinary string", at least 0.

    The likelihood ratio of an ordinary string against a random one of the encoding has mean 1
    among random draws of ordinary strings when turned over, so it bounds their p-value (Markov).
    """

    def ratio(value: Column, alphabet: str) -> Column:
        letters = {c: LETTERS[c.lower()] * (1.0 if c.islower() or len(alphabet) == 32 else CAPITALS) for c in alphabet if c.isalpha()}
        digits = [c for c in alphabet if c.isdigit()]
        signs = [c for c in alphabet if not c.isalnum()]
        total = sum(letters.values())
        share = {c: v / total * (1 - DIGITS - 0.05 * bool(signs)) for c, v in letters.items()} | dict.fromkeys(digits, DIGITS / max(len(digits), 1)) | dict.fromkeys(signs, 0.05 / max(len(signs), 1))
        weights = F.array(*(F.lit(-math.log10(share[c] * len(alphabet))) for c in alphabet))
        codes = F.filter(F.split(value, ""), lambda c: c != "")
        return F.aggregate(codes, F.lit(0.0), lambda s, c: s + F.coalesce(F.get(weights, F.instr(F.lit(alphabet), c) - 1), F.lit(0.0)))

    return F.greatest(_inferred(token, ratio), F.lit(0.0))


def _battery(value: Column, alphabet: str) -> Column:
    """Smallest p of the three tests for one alphabet."""
    k, n = len(alphabet), F.length(value).cast("double")
    used = F.transform(F.split(F.lit(alphabet), ""), lambda c: n - F.length(F.replace(value, c, F.lit(""))))
    chi = k / n * F.aggregate(used, F.lit(0.0), lambda s, x: s + x * x) - n
    p = _tail(F.least((chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n), F.lit(9.0)))
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c) - (k + 1) / 2)
    return F.least(p, _order(codes, n))


def _order(codes: Column, n: Column) -> Column:
    """Smaller p of the runs test and of the serial correlation."""

    def both(c: Column) -> Column:
        after = F.slice(c, 2, F.size(c))
        pairs = F.zip_with(F.slice(c, 1, F.size(c) - 1), after, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        high = F.aggregate(c, F.lit(0.0), lambda s, x: s + F.when(x > 0, 1.0).otherwise(0.0))
        low = n - high
        runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when((p["x"] > 0) != (p["y"] > 0), 1.0).otherwise(0.0))
        mean = 1 + 2 * high * low / n
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        centre = F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / n
        power = F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - centre) * (x - centre))
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["x"] - centre) * (p["y"] - centre)) / F.greatest(power, F.lit(1e-9))
        z = F.greatest(F.abs(runs - mean) / spread, F.abs(serial) * F.sqrt(n))
        return F.when(power < 1e-6, 0.0).otherwise(2 * _tail(F.least(z, F.lit(9.0))))

    return _bound(codes, both)


def scan_secrets(docs: DataFrame, *, fdr: float = 0.01) -> DataFrame:
    """Secrets of every whole text of ``docs`` (doc_id, text): (doc_id, spans).

    A span is (start, end, kind) in code points, end exclusive, in order of start and kind.
    Kinds assign, access and hex have known shapes. Kind random is a token of a letter and a
    digit at least that no known span touches, that the battery does not tell from a random
    string of its encoding (p of LEAST_P or more), and that is no ordinary string: of the tokens
    called, a share of ``fdr`` at most is expected to be ordinary. Long tokens give stronger
    evidence than short ones, so Benjamini-Hochberg runs within classes of length (powers of
    two) over the p-values under "ordinary string", where a token that the battery tells from a
    random one has p = 1: it is never called and never counts as called, but counts as tested.
    Thresholds come from counts of p-values in steps of STEP, a small table however many tokens
    there are, so nothing is sorted as a whole.

    Null and empty texts have no spans; a null doc_id is kept; repeated rows give repeated
    rows, and count as such; an empty table gives no rows; extra columns are ignored. Tokens of
    equal p-values share their fate. Time follows a text's length, and n log n its spans.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce("text", F.lit(""))
    names = list(PATTERNS)
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id", *(_matches(F.col("text"), p, k).alias(k) for k, p in PATTERNS.items()), _matches(F.col("text"), TOKEN, RANDOM).alias("token")
    )
    long = F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], PATTERNS["assign"], 1)) >= 6)
    found = found.select("doc_id", F.concat(long, "access", "hex").alias("known"), F.filter("token", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")).alias("token"))
    plain = F.transform("token", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    free = F.when((F.size("token") > 0) & (F.size("known") > 0), _apart(F.col("token"), F.col("known"))).otherwise(plain)
    found = found.select("doc_id", F.transform("known", lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("known"), free.alias("token"))
    tested = F.transform(
        "token",
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.floor(F.log2(F.length(s["value"]))).cast("int").alias("size"),
            F.floor(_evidence(s["value"]) / STEP).cast("int").alias("bin"), (_tested(s["value"]) >= LEAST_P).alias("random"),
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int,size:int,bin:int,random:boolean>>")
    scanned = scratch.save(found.select("doc_id", "known", F.when(F.size("token") > 0, tested).otherwise(empty).alias("token")))
    counts = scanned.where(F.size("token") > 0).select(F.explode("token").alias("t")).groupBy("t.size", "t.bin").agg(F.count("*").alias("n"), F.count_if("t.random").alias("called"))
    beyond = Window.partitionBy("size").orderBy(F.desc("bin"))
    limits = (
        counts.select("size", "bin", F.sum("called").over(beyond).alias("above"), F.sum("n").over(Window.partitionBy("size")).alias("all"))
        .where(F.pow(F.lit(10.0), -F.col("bin") * STEP) <= fdr * F.col("above") / F.col("all"))
        .groupBy("size").agg(F.min("bin").alias("limit"))
    )
    limits = dict(tuple(r) for r in limits.collect())  # one row per power of two
    limit = F.create_map(*(F.lit(x) for kv in (limits or {-1: 0}).items() for x in kv))
    order = {k: i for i, k in enumerate([*names, RANDOM])}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    random = F.filter("token", lambda t: t["random"] & (t["bin"] >= F.coalesce(F.element_at(limit, t["size"]), F.lit(1 << 30))))
    every = F.concat("known", F.transform(random, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(RANDOM).alias("kind"))))
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return scanned.select(
        "doc_id", F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans")
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of all documents."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k))
    count = [of_kind(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *count, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
