"""Token lengths of prompts and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritab.errors import EvidenceError

#: Tokens behind a prompt: the answer and the end of the sequence.
ANSWER_TOKENS = 2


def whitespace_length(text: Column) -> Column:
    """Tokens of the plainest tokenizer: runs of anything but white space in normal form."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def nearest_rank(rows: DataFrame, by: list[str], value: str, percent: int, name: str) -> DataFrame:
    """(*by, name): the value of rank max(1, ceil(percent * n / 100)) in each group.

    Values are counted first, so a group is ranked over its distinct values, not
    over its rows; no library's interpolation enters.  Nulls don't count; a group
    of nulls only is left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy(value) if by else Window.orderBy(value)
    whole = Window.partitionBy(*by)
    rank = F.greatest(F.lit(1), F.expr("(p * _all + 99) div 100"))
    placed = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(whole)).withColumn("p", F.lit(percent))
    return placed.where(F.col("_upto") >= rank).groupBy(*by).agg(F.min(value).alias(name))


def length_summary(lengths: DataFrame, longest: int) -> DataFrame:
    """(split, rows, minimum, median, p95_nearest_rank, maximum, rows_over) of ``n_tokens``."""
    return _summary(lengths.groupBy("split", "n_tokens").agg(F.count(F.lit(1)).alias("n")), longest)


def _summary(counts: DataFrame, longest: int) -> DataFrame:
    """All numbers from (split, n_tokens, n), the counts of each length: rows are read once.

    The median is the mean of the lengths of the two middle ranks, which are one
    where the number of rows is odd.
    """
    upto, whole = Window.partitionBy("split").orderBy("n_tokens"), Window.partitionBy("split")
    counts = counts.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(whole))

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("_upto") >= F.expr(rank), F.col("n_tokens")))

    return counts.groupBy("split").agg(
        F.sum("n").alias("rows"), F.min("n_tokens").cast("bigint").alias("minimum"), ((at("(_all + 1) div 2") + at("_all div 2 + 1")) / 2).cast("double").alias("median"),
        at("greatest(1, (95 * _all + 99) div 100)").cast("bigint").alias("p95_nearest_rank"), F.max("n_tokens").cast("bigint").alias("maximum"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > longest, F.col("n"))), F.lit(0)).cast("bigint").alias("rows_over"),
    )


def token_audit(lengths: DataFrame, longest: int) -> DataFrame:
    """The summaries of the splits and, as split `all rows`, of all; ``safe`` if none is too long."""
    counts = lengths.groupBy("split", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array("split", F.lit("all rows"))).alias("split")
    both = counts.select(each, "n_tokens", "n").groupBy("split", "n_tokens").agg(F.sum("n").alias("n"))
    return _summary(both, longest).withColumn("safe", F.col("rows_over") == 0)


def median_value(median: float) -> int | float:
    """A median as it is stored: an integer where it is one by parity or value."""
    return int(median) if float(median).is_integer() else median


def require_safe(audit: DataFrame) -> None:
    over = audit.where("not safe").agg(F.max("rows_over")).first()[0]
    if over:
        raise EvidenceError(f"{over} rows are longer than the model reads")
