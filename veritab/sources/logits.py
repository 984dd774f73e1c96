"""Stored scores: parquet with a digest, read back only if it still holds."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.errors import EvidenceError
from veritab.functions.scores import valid_scores
from veritab.operators.digests import array_digest
from veritab.sources.files import exists, guarded

LOGITS = "pos bigint, z array<float>"


def _digest(logits: DataFrame) -> tuple[str, int]:
    row = array_digest(logits.select(F.lit(0).alias("one"), "pos", "z"), ["one"]).first()
    if row is None:
        raise EvidenceError("there are no scores")
    return row["array_sha256"], row["rows"]


def save_logits(logits: DataFrame, root: str | Path, reference: str) -> dict:
    """Write (pos, z) under ``root`` and return path, digest and shape.

    ``logits`` is evaluated once; what was written is checked and digested.
    """
    place, spark = str(guarded(reference, root, ".parquet")), logits.sparkSession
    logits.select("pos", logits["z"].cast("array<float>").alias("z")).write.mode("overwrite").parquet(place)
    stored = spark.read.schema(LOGITS).parquet(place)
    if not stored.where(~valid_scores(stored["z"])).isEmpty():
        raise EvidenceError("scores must be four finite numbers")
    digest, rows = _digest(stored)
    return {"path": reference, "sha256": digest, "shape": [rows, 4]}


def load_logits(spark: SparkSession, stored: dict, root: str | Path) -> DataFrame:
    """The scores of a stored reference; another shape or digest is refused."""
    place = str(guarded(stored.get("path"), root, ".parquet"))
    if not exists(spark, place):
        raise EvidenceError(f"{place} does not exist")
    logits = spark.read.schema(LOGITS).parquet(place)
    digest, rows = _digest(logits)
    if stored.get("shape") != [rows, 4]:
        raise EvidenceError(f"{stored.get('path')} has another shape")
    if stored.get("sha256") != digest:
        raise EvidenceError(f"{stored.get('path')} has another digest")
    return logits
