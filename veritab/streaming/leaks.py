"""Leak detection on arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritab.functions.text import content_id, is_blank


def leaking(arriving: DataFrame, judged: DataFrame) -> DataFrame:
    """The arriving rows whose normalised text the judged rows have: a stream-static semi join.

    ``arriving`` is a stream or table with text, ``judged`` a table with content_id.
    Stateless, so any number of rows may arrive; blank texts never leak.
    """
    rows = arriving.where(~is_blank(F.col("text"))).withColumn("content_id", content_id(F.col("text")))
    return rows.join(judged.select("content_id").distinct(), "content_id", "left_semi")


def leak_counts(arriving: DataFrame, judged: DataFrame, time: str, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """(window_start, rows) of leaking rows by event time; later rows than ``late`` are dropped."""
    rows = leaking(arriving.withWatermark(time, late) if arriving.isStreaming else arriving, judged)
    return rows.groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("window_start"), "rows")
