"""State that a later run reads again: settings with a version, and classifiers by their columns."""

from __future__ import annotations

import hashlib
import json
import warnings

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from .tables import exists


def save_state(spark: SparkSession, path: str, state: dict, version: int) -> None:
    """Write a state that JSON can hold, with its version."""
    spark.createDataFrame([(version, json.dumps(state))], "version int, state string").coalesce(1).write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str, version: int) -> dict | None:
    """A saved state; None, with a warning, where there is none or it has another version."""
    if not exists(spark, path):
        warnings.warn(f"no state at {path}", stacklevel=2)
        return None
    row = spark.read.schema("version int, state string").json(path).first()
    if row is None or row["version"] != version:
        warnings.warn(f"state at {path} has another version than {version}", stacklevel=2)
        return None
    return json.loads(row["state"])


def model_folder(root: str, features: list[str]) -> str:
    """Folder of the classifiers that read these columns, in any order."""
    return f"{root}/{hashlib.sha256(json.dumps(sorted(features)).encode()).hexdigest()[:16]}"


def model_versions(spark: SparkSession, root: str, features: list[str]) -> int:
    """Number of saved classifiers of these columns."""
    n = 0
    while exists(spark, f"{model_folder(root, features)}/{n}"):
        n += 1
    return n


def save_model(spark: SparkSession, root: str, features: list[str], model: PipelineModel) -> int:
    """Save a classifier as the next version of its columns; returns the version."""
    version = model_versions(spark, root, features)
    model.write().save(f"{model_folder(root, features)}/{version}")
    return version


def load_model(spark: SparkSession, root: str, features: list[str], version: int = -1) -> PipelineModel | None:
    """A saved classifier of these columns, the latest by default; None if there is none."""
    n = model_versions(spark, root, features)
    wanted = n + version if version < 0 else version
    return PipelineModel.load(f"{model_folder(root, features)}/{wanted}") if 0 <= wanted < n else None
