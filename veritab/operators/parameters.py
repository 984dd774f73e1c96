"""Counting trainable and stored parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ADAPTER = "lora_"


def parameter_report(parameters: DataFrame) -> DataFrame:
    """One row (total, trainable, trainable_percent, stored) from a table of tensors.

    ``parameters`` has name, numel, requires_grad, is_4bit, element_size.  A packed
    tensor holds two values in each byte.  A trainable tensor outside the adapter,
    and a model without total or trainable parameters, are errors on reading.
    """
    count = F.col("numel") * F.when(F.col("is_4bit"), F.coalesce("element_size", F.lit(1)) * 2).otherwise(1)
    odd = F.count_if(F.col("requires_grad") & ~F.contains("name", F.lit(ADAPTER)))
    sums = parameters.agg(F.sum(count).alias("total"), F.coalesce(F.sum(F.when(F.col("requires_grad"), count)), F.lit(0)).alias("trainable"), F.sum("numel").alias("stored"), odd.alias("odd"))
    checked = F.when(F.col("odd") > 0, F.raise_error(F.lit("a parameter outside the adapter is trainable")).cast("bigint"))
    checked = checked.when((F.coalesce("total", F.lit(0)) == 0) | (F.col("trainable") == 0), F.raise_error(F.lit("there are no total or no trainable parameters")).cast("bigint"))
    total = checked.otherwise(F.col("total"))
    return sums.select(total.cast("bigint").alias("total"), F.col("trainable").cast("bigint").alias("trainable"), (F.lit(100.0) * F.col("trainable") / F.nullif("total", F.lit(0))).alias("trainable_percent"), F.col("stored").cast("bigint").alias("stored"))
