"""Rows that appear both where a model is trained and where it is judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritab.errors import LeakError


def shared_keys(trained: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """The distinct keys of ``judged`` that ``trained`` has too; nulls match nothing."""
    return judged.select(key).distinct().join(trained.select(key), key, "left_semi")


def leak_report(trained: DataFrame, judged: DataFrame) -> DataFrame:
    """One row (shared_rows, shared_contents, leaks, judged_rows).

    Both inputs have row_id and content_id.  Ids count once however often they
    occur; contents count as leaks only where no row is shared.
    """
    spark = trained.sparkSession
    both = [shared_keys(trained, judged, key).agg(F.count(F.lit(1)).alias(name)) for key, name in (("row_id", "shared_rows"), ("content_id", "shared_contents"))]
    total = judged.agg(F.count(F.lit(1)).alias("judged_rows"))
    out = spark.range(1).select().join(both[0]).join(both[1]).join(total)
    return out.select("shared_rows", "shared_contents", F.coalesce(F.nullif("shared_rows", F.lit(0)), "shared_contents").alias("leaks"), "judged_rows")


def leak_matrix(members: DataFrame, key: str = "content_id") -> DataFrame:
    """(split_a, split_b, shared): distinct keys that each two splits share, zeros left out.

    One pass: the splits of each key are gathered, a set no larger than the number
    of splits, and its pairs are counted.
    """
    sets = members.where(F.col(key).isNotNull() & F.col("split").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    a = sets.select("s", F.posexplode("s").alias("i", "split_a"))
    pairs = a.select("split_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("split_b"))
    return pairs.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


def require_disjoint(trained: DataFrame, judged: DataFrame, names: tuple[str, str] = ("train", "validation")) -> None:
    """Refuse any overlap of rows, or else of model-visible content."""
    found = leak_report(trained, judged).first()
    if found["leaks"]:
        kind = "also appear in" if found["shared_rows"] else "have the same normalised text as rows of"
        raise LeakError(f"{found['leaks']} of {found['judged_rows']} {names[1]} rows {kind} {names[0]}")


def require_no_leaks(splits: dict[str, DataFrame]) -> None:
    """Check every two of the splits, in the order given."""
    names = list(splits)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            require_disjoint(splits[a], splits[b], (a, b))
