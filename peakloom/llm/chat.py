"""Chat formatting: logged snapshots of growing conversations collapse to the longest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Turn numbers per chunk of running sums, and per row of rendered text.
CHUNK = 1024


def _mark(which: int):
    """Hash of one turn, its number included, as a decimal that sums without overflow."""
    return F.xxhash64(F.lit(which), "turn", F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00"))).cast("decimal(38,0)")


def maximal_conversations(turns: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Conversations of ``turns`` (conv_id, turn, role, text) that no other one continues.

    Returns conv_id, n_turns (rows), last_turn and n_copies (conversations with the same
    turns, this one included). A prefix hash of a conversation is the sum of the hashes of its
    turns so far, each with its turn number, so it rolls forward with a running sum and needs
    no conversation gathered in one place: sums run inside chunks of ``chunk`` turn numbers,
    and chunk totals run over the conversation. A conversation whose full hash is a proper
    prefix hash of another is dropped by an anti-join on distinct hashes; of equal ones the
    smallest conv_id stays.

    Turn numbers belong to the content: a snapshot has the numbers of the conversation it is
    part of. Rows that share conv_id and turn are one turn of several parts, in any order;
    exact repeats of a row count once. A null role or text equals another null. Rows with a
    null conv_id or turn are left out. Extra columns are ignored.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    marks = (
        turns.where("conv_id IS NOT NULL AND turn IS NOT NULL")
        .select("conv_id", "turn", F.floor(F.col("turn") / chunk).alias("chunk"), _mark(1).alias("a"), _mark(2).alias("b")).distinct()
        .groupBy("conv_id", "chunk", "turn").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n"))
    )
    marks = scratch.save(marks)
    totals = marks.groupBy("conv_id", "chunk").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"), F.max("turn").alias("last"))
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "chunk", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}0") for c in "ab"))
    within = Window.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rolled = marks.select("conv_id", "chunk", "turn", F.sum("a").over(within).alias("a"), F.sum("b").over(within).alias("b")).join(before, ["conv_id", "chunk"])
    name = lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string")).alias("prefix")
    prefixes = rolled.select("conv_id", "turn", name(F.col("a") + F.col("a0"), F.col("b") + F.col("b0")))
    whole = totals.groupBy("conv_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n_turns"), F.max("last").alias("last_turn"))
    whole = whole.select("conv_id", "n_turns", "last_turn", name(F.col("a"), F.col("b")))
    classes = whole.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.first("last_turn").alias("last_turn"), F.count("*").alias("n_copies")
    )
    proper = prefixes.join(whole.select("conv_id", "last_turn"), "conv_id").where("turn < last_turn").select("prefix").distinct()
    return classes.join(proper, "prefix", "left_anti").select("conv_id", "n_turns", "last_turn", "n_copies")


def render(turns: DataFrame, kept: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Rendered text of the conversations of ``kept``: (conv_id, part, n_turns, n_copies, rendered).

    A turn reads ``<|role|>``, a line feed, its trimmed text and ``<|end|>``; turns are joined
    by line feeds in order of turn, role and text. One row holds ``chunk`` turn numbers (part
    0, 1, ...), so a conversation of any length is rendered in bounded pieces. A null role
    reads ``unknown``; a null text is empty.
    """
    rows = turns.where("turn IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.trim(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce("role", F.lit("\x00")).alias("r"), F.coalesce("text", F.lit("\x00")).alias("t"),
    )
    held = kept.select("conv_id", "n_turns", "n_copies")
    piece = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>"))
    return (
        rows.join(held, "conv_id")
        .groupBy("conv_id", F.floor(F.col("turn") / chunk).alias("part"), "n_turns", "n_copies")
        .agg(F.array_sort(F.collect_set(F.struct("turn", "r", "t", piece.alias("piece")))).alias("turns"))
        .select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: t["piece"]), "\n").alias("rendered"))
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations of the whole log, rendered."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return render(turns, maximal_conversations(turns))


# Prefixes are compared as texts here; the engine compares their rolling hashes.
OP6_SQL = """
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, chr(0)) AS r, coalesce(text, chr(0)) AS t,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || trim(coalesce(text, ''), ' ') || '<|end|>' AS piece
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
marks AS (
  SELECT conv_id, turn, count(*) AS n, string_agg(md5(turn::VARCHAR || chr(1) || r || chr(1) || t), ',' ORDER BY r, t) AS mark
  FROM rows GROUP BY conv_id, turn),
prefixes AS (
  SELECT conv_id, turn, string_agg(mark, ';') OVER (PARTITION BY conv_id ORDER BY turn) AS prefix,
         sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS n_turns,
         max(turn) OVER (PARTITION BY conv_id) AS last_turn
  FROM marks),
classes AS (
  SELECT prefix, min(conv_id) AS conv_id, min(n_turns) AS n_turns, count(*) AS n_copies
  FROM prefixes WHERE turn = last_turn GROUP BY prefix),
kept AS (
  SELECT * FROM classes WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE turn < last_turn))
SELECT conv_id, CAST(floor(turn / 1024.0) AS BIGINT) AS part, CAST(n_turns AS BIGINT) AS n_turns, n_copies,
       string_agg(piece, chr(10) ORDER BY turn, r, t) AS rendered
FROM rows JOIN kept USING (conv_id)
GROUP BY conv_id, part, n_turns, n_copies
"""
