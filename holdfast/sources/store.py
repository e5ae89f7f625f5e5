"""Trained models on shared storage: pipeline, preparation and parameters side by side, in numbered versions.

Each industry is a folder with versions (see `versions`): a save writes the model and its description to new folders and then
switches to them, so an interrupted save leaves the model before it ready, and earlier versions can be loaded.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import Preparation
from . import versions

REGISTRY_SCHEMA = "industry string, name string, algorithm string, feature_count int, features array<string>, params string, preparation string"


def save_model(spark: SparkSession, root: str, industry: str, name: str, model: PipelineModel, prep: Preparation, params: dict) -> int:
    """The number of the new version."""
    home = f"{root}/{industry}"
    known = versions.versions(spark, home)
    path = f"model/{uuid.uuid4().hex}"
    model.write().save(f"{home}/{path}")
    if prep.index:
        levels = f"{home}/levels/{uuid.uuid4().hex}"
        spark.read.parquet(prep.index).write.parquet(levels)
        prep = replace(prep, index=levels)
    row = (industry, name, type(model.stages[-1]).__name__, len(prep.features), prep.features, json.dumps(params, sort_keys=True), prep.to_json())
    meta = f"meta/{uuid.uuid4().hex}"
    spark.createDataFrame([row], REGISTRY_SCHEMA).coalesce(1).write.json(f"{home}/{meta}")
    number = (known[-1] if known else 0) + 1
    versions.publish(spark, home, {"model": {"path": path}, "meta": {"path": meta}}, number)
    return number


def load_model(spark: SparkSession, root: str, industry: str, version: int | None = None) -> tuple[PipelineModel, Preparation, dict]:
    home = f"{root}/{industry}"
    try:
        entries = versions.manifest(spark, home, version)
        row = spark.read.schema(REGISTRY_SCHEMA).json(f"{home}/{entries['meta']['path']}").first()
        model = PipelineModel.load(f"{home}/{entries['model']['path']}")
    except Exception as error:
        raise FileNotFoundError(f"no trained model for {industry} below {root}") from error
    return model, Preparation.from_json(row["preparation"]), json.loads(row["params"])


def model_registry(spark: SparkSession, root: str, industries: list[str]) -> DataFrame:
    """One row per known industry, trained or not; `version` is the number of the current model."""
    current = [(i, (versions.versions(spark, f"{root}/{i}") or [None])[-1]) for i in industries]
    known = spark.createDataFrame(current, "industry string, version int")
    parts = [f"{root}/{i}/{versions.manifest(spark, f'{root}/{i}')['meta']['path']}" for i, number in current if number is not None]
    meta = spark.read.schema(REGISTRY_SCHEMA).json(parts) if parts else spark.createDataFrame([], REGISTRY_SCHEMA)
    status = F.when(F.col("feature_count").isNotNull(), "ready").otherwise("not trained").alias("status")
    return known.join(meta, "industry", "left").select("industry", "name", status, "algorithm", "feature_count", "features", "params", "version")
