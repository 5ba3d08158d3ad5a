"""Result and library tables: formats by suffix, run folders, partitioned sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {".parquet": "parquet", ".tsv": "tsv", ".csv": "csv", ".jsonl": "json"}


def format_of(path: str) -> str:
    """Format of a path by its suffix."""
    for suffix, kind in SUFFIXES.items():
        if path.rstrip("/").endswith(suffix):
            return kind
    raise ValueError(f"unknown format: {path}")


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """Read Parquet, TSV, CSV or JSON lines; give a schema for text in production."""
    kind = kind or format_of(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("tsv", "csv"):
        return reader.csv(path, sep="\t" if kind == "tsv" else ",", header=True, inferSchema=schema is None)
    if kind in ("parquet", "json"):
        return getattr(reader, kind)(path)
    raise ValueError(f"unknown format: {kind}")


def write_table(df: DataFrame, path: str, kind: str | None = None, *, digits: int = 6, partition_by: list[str] | None = None) -> None:
    """Write Parquet, TSV (numbers with fixed digits), CSV or JSON lines."""
    kind = kind or format_of(path)
    if kind in ("tsv", "csv"):
        numbers = {c: F.format_string(f"%.{digits}f", F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
        df.withColumns(numbers).write.mode("overwrite").csv(path, sep="\t" if kind == "tsv" else ",", header=True)
    elif kind in ("parquet", "json"):
        writer = df.write.mode("overwrite")
        getattr(writer.partitionBy(*partition_by) if partition_by else writer, kind)(path)
    else:
        raise ValueError(f"unknown format: {kind}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_runs(spark: SparkSession, folders: dict[str, str], name: str) -> DataFrame:
    """Tables ``name`` of the run folders that have one, with the run's name; missing ones are skipped."""
    found = {run: f"{path}/{name}" for run, path in folders.items() if exists(spark, f"{path}/{name}")}
    if not found:
        raise FileNotFoundError(f"no run has {name}")
    parts = [spark.read.option("ignoreCorruptFiles", "true").parquet(p).withColumn("run", F.lit(run)) for run, p in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_runs(df: DataFrame, path: str, run: str = "run") -> None:
    """One partition folder per run; only runs present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def missing_runs(spark: SparkSession, path: str, runs: list[str]) -> list[str]:
    """Runs without a finished partition, which still have to be processed."""
    return [r for r in runs if not exists(spark, f"{path}/run={r}")]


def conform(df: DataFrame, schema: dict[str, str], *, optional: tuple[str, ...] = ()) -> DataFrame:
    """Cast to a schema and drop other columns; a missing required column is an error."""
    if absent := [c for c in schema if c not in df.columns and c not in optional]:
        raise ValueError(f"missing columns: {absent}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in schema.items() if c in df.columns))


def first_named(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Rename the first synonym that is there to each name."""
    for name, others in synonyms.items():
        if name not in df.columns and (hit := next((o for o in others if o in df.columns), None)):
            df = df.withColumnRenamed(hit, name)
    return df
