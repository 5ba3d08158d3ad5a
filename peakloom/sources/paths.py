"""Which raw files a search takes."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

KINDS = (".parquet", ".d", ".raw", ".mzml", ".wiff", ".hdf")


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """Paths in a folder of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(s.getPath().toString() for s in found)


def raw_paths(spark: SparkSession, files: list[str], folders: list[str], pattern: str = ".*") -> list[str]:
    """Named files and those of folders with a known suffix whose base name matches, each once."""
    inside = [p for f in folders for p in list_folder(spark, f) if p.lower().endswith(KINDS)]
    named = dict.fromkeys([*files, *inside])
    return [p for p in named if re.search(pattern, p.rstrip("/").rsplit("/", 1)[-1])]


def chunks(paths: list[str], parts: int) -> list[list[str]]:
    """Paths dealt in order to at most ``parts`` lists of equal length but the last."""
    size = -(-len(paths) // parts) if paths else 1
    return [paths[i : i + size] for i in range(0, len(paths), size)]
