"""Choosing a checkpoint by rule, and agreement with a baseline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from veritab.errors import EvidenceError

AGREEMENT = 0.005


def select_checkpoint(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, epoch, macro_f1): the highest macro_f1, of equal ones the earliest epoch.

    A repeated epoch is an error when the result is read; no record gives no row.
    """
    by = by or []
    best = F.max_by(F.struct("epoch", "macro_f1"), F.struct("macro_f1", -F.col("epoch"))).alias("r")
    out = records.groupBy(*by).agg(best, F.count("epoch").alias("n"), F.count_distinct("epoch").alias("d")).where("n > 0")
    epoch = F.when(F.col("n") > F.col("d"), F.raise_error(F.lit("an epoch occurs twice")).cast("int")).otherwise(F.col("r.epoch"))
    return out.select(*by, epoch.alias("epoch"), F.col("r.macro_f1").alias("macro_f1"))


def chosen(records: list[dict]) -> dict:
    """The rule of select_checkpoint() for the records of one report."""
    if not records:
        raise ValueError("there is no checkpoint to select")
    if len({r["epoch"] for r in records}) < len(records):
        raise ValueError("an epoch occurs twice")
    return max(records, key=lambda r: (r["validation"]["macro_f1"], -r["epoch"]))


def baseline_agreement(values: DataFrame, tolerance: float = AGREEMENT) -> DataFrame:
    """``values`` (expected, actual) with absolute_difference and agrees; null doesn't agree."""
    gap = F.abs(F.col("expected") - F.col("actual"))
    return values.withColumn("absolute_difference", gap).withColumn("agrees", F.coalesce(gap <= tolerance, F.lit(False)))


def require_agreement(expected: float, actual: float, tolerance: float = AGREEMENT) -> dict:
    gap = abs(expected - actual)
    if not gap <= tolerance:
        raise EvidenceError(f"macro-F1 {actual} is not within {tolerance} of the recorded {expected}")
    return {"expected": expected, "actual": actual, "absolute_difference": gap, "tolerance": tolerance, "agrees": True}


def optimizer_steps(rows: int, per_device: int, accumulation: int, epochs: int) -> int:
    return math.ceil(rows / (per_device * accumulation)) * epochs


def warmup_steps(ratio: float, steps: int) -> int:
    """At least one; halves round to even."""
    return max(1, round(ratio * steps))


def steps_of(rows: Column, per_device: int, accumulation: int, epochs: int) -> Column:
    """optimizer_steps() of a column of row counts."""
    return (F.ceil(rows.cast("double") / (per_device * accumulation)) * epochs).cast("bigint")


def warmup_of(ratio: float, steps: Column) -> Column:
    """warmup_steps() of a column of steps."""
    return F.greatest(F.lit(1).cast("bigint"), F.bround(F.lit(ratio) * steps).cast("bigint"))


#: Arguments that don't change what is learned.
COSMETIC = frozenset({"logging_steps", "report_to", "save_strategy", "remove_unused_columns"})


def training_arguments(requested: dict, supported: set[str], ratio: float, steps: int) -> dict:
    """The arguments a trainer accepts; one that matters and isn't accepted is refused.

    Warm-up is given as a ratio where that is supported, else as steps.
    """
    warmup = {"warmup_ratio": ratio} if "warmup_ratio" in supported else {"warmup_steps": warmup_steps(ratio, steps)}
    if not supported & set(warmup):
        raise EvidenceError("the trainer accepts no warm-up")
    wanted = requested | warmup
    if lost := sorted(set(wanted) - supported - COSMETIC):
        raise EvidenceError(f"the trainer doesn't accept {lost}")
    return {k: v for k, v in wanted.items() if k in supported}
