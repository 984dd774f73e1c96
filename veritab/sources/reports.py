"""JSON reports: read, written, created once."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.errors import EvidenceError


def read_json(path: str | Path) -> Any:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as error:
        raise EvidenceError(f"{path} does not exist") from error


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, report) of any number of JSON files, each a VARIANT; null where malformed."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("report"))


def write_json(value: Any, path: str | Path) -> None:
    """Two blanks of indentation and a final line feed; replaced in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(json.dumps(value, indent=2) + "\n", encoding="utf-8")
    os.replace(part, target)


def create_json(value: Any, path: str | Path) -> None:
    """Like write_json(), but never over what is there: creation is atomic."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    try:
        with target.open("x", encoding="utf-8") as f:
            f.write(json.dumps(value, indent=2) + "\n")
    except FileExistsError as error:
        raise EvidenceError(f"{path} exists already") from error


def utc_now() -> str:
    return datetime.now(UTC).isoformat().removesuffix("+00:00") + "Z"


def is_utc(stamp: Any) -> bool:
    """Whether this is an ISO timestamp that ends in Z."""
    if not isinstance(stamp, str) or not stamp.endswith("Z"):
        return False
    try:
        datetime.fromisoformat(stamp[:-1] + "+00:00")
    except ValueError:
        return False
    return True
