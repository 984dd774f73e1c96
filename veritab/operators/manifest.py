"""Directory manifests: scan, combined digest, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritab.errors import EvidenceError


def combined(manifest: DataFrame) -> DataFrame:
    """One row (files, combined_sha256, total_bytes) of (path, sha256, length).

    Each file enters as path, NUL, digest, line feed, ordered by the components of
    its path; an empty directory has no row.
    """
    line = F.concat(F.col("path"), F.lit("\0"), F.col("sha256"), F.lit("\n"))
    rows = manifest.withColumn("_line", line).withColumn("_parts", F.split("path", "/"))
    listed = F.array_sort(F.collect_list(F.struct("_parts", "_line")))
    out = rows.agg(F.count(F.lit(1)).alias("files"), listed.alias("l"), F.sum("length").cast("bigint").alias("total_bytes")).where("files > 0")
    return out.select("files", F.sha2(F.array_join(F.transform("l", lambda x: x["_line"]), ""), 256).alias("combined_sha256"), "total_bytes")


def manifest_diff(recorded: DataFrame, present: DataFrame, mutable: tuple[str, ...] = ()) -> DataFrame:
    """(path, reason): files missing, added or changed; ``mutable`` ones are left out."""
    joined = recorded.select("path", F.col("sha256").alias("a")).join(present.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    reason = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed")
    kept = joined.where(~F.col("path").isin(*mutable)) if mutable else joined
    return kept.select("path", reason.alias("reason")).where("reason is not null")


def require_unchanged(recorded: DataFrame, present: DataFrame, mutable: tuple[str, ...] = ()) -> None:
    if found := manifest_diff(recorded, present, mutable).orderBy("path").limit(10).collect():
        raise EvidenceError("directory differs from its manifest: " + ", ".join(f"{p} {r}" for p, r in found))
