"""Row by row comparison of two systems, and the exact McNemar test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from veritab.functions.text import scientific


def pair_systems(scores: DataFrame, key: str = "pos") -> DataFrame:
    """(pos, label, base, tuned) of rows scored by both systems, from (system, pos, label, pred).

    One aggregation instead of a self-join; a row that a system lacks is left out.
    """
    def of(system: str) -> Column:
        return F.max(F.when(F.col("system") == system, F.col("pred"))).alias(system)

    return scores.groupBy(key).agg(F.max("label").alias("label"), of("base"), of("tuned")).where("base is not null and tuned is not null").select(key, "label", "base", "tuned")


def unpaired(scores: DataFrame, key: str = "pos") -> DataFrame:
    """(key, system): rows that the named one of the two systems has and the other lacks."""
    return scores.where(F.col("system").isin("base", "tuned")).groupBy(key).agg(F.min("system").alias("system"), F.count_distinct("system").alias("n")).where("n = 1").select(key, "system")


def paired_counts(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, rows, disagreements, fixed, broken, both_right, both_wrong).

    Disagreements are rows with different predictions, even if both are wrong.
    Rows with a null among label, base and tuned don't count.
    """
    base, tuned = F.col("base") == F.col("label"), F.col("tuned") == F.col("label")
    return pairs.dropna(subset=["label", "base", "tuned"]).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("base") != F.col("tuned")).alias("disagreements"), F.count_if(~base & tuned).alias("fixed"),
        F.count_if(base & ~tuned).alias("broken"), F.count_if(base & tuned).alias("both_right"), F.count_if(~base & ~tuned).alias("both_wrong"),
    )


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series at x + 8."""
    x = x.cast("double")
    y = x + 8
    square = F.lit(1.0) / (y * y)
    #: The coefficients B(2k) / (2k (2k - 1)).
    series = F.lit(-691.0 / 360360)
    for c in (1.0 / 1188, -1.0 / 1680, 1.0 / 1260, -1.0 / 360, 1.0 / 12):
        series = series * square + c
    shift = F.ln(x * (x + 1) * (x + 2) * (x + 3)) + F.ln((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series / y - shift


def mcnemar(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, discordant, chi_square, log10_p, p, p_text) from columns fixed and broken.

    The exact two-sided tail of Binomial(n, 1/2) is summed in logarithms: the
    largest term is that of k = min(fixed, broken), and the sum relative to it
    grows from the far end, S(k) = 1 + S(k - 1) * k / (n - k + 1).  Terms more than
    12 sqrt(n) below the largest are under exp(-288) of it and left out, so the
    work grows with the root of n.  No discordant row gives nulls; p is null where
    it is below the smallest double.  Negative counts are an error.
    """
    by = by or []
    least = F.least("fixed", "broken")
    n = F.col("fixed") + F.col("broken")
    checked = F.when(least < 0, F.raise_error(F.lit("counts can't be negative")).cast("bigint")).otherwise(least)
    rows = counts.select(*by, "fixed", "broken", n.cast("bigint").alias("n"), checked.cast("bigint").alias("m"))
    n, m = F.col("n"), F.col("m")
    choose = log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1)
    first = F.greatest(F.lit(1).cast("bigint"), m - F.ceil(12 * F.sqrt(n.cast("double"))) - 64)
    tail = F.aggregate(F.sequence(first, F.greatest(m, F.lit(1))), F.lit(0.0), lambda a, k: F.when(m > 0, (a + 1.0) * k / (n - k + 1)).otherwise(0.0))
    ln_p = choose + F.log1p(tail) - n * F.ln(F.lit(2.0)) + F.ln(F.lit(2.0))
    log10 = F.when(n > 0, F.least(F.lit(0.0), ln_p / F.ln(F.lit(10.0))))
    gap = F.abs(F.col("fixed") - F.col("broken")) - 1
    out = rows.withColumn("log10_p", log10)
    p = F.pow(F.lit(10.0), F.col("log10_p"))
    return out.select(
        *by, F.col("n").alias("discordant"), F.when(F.col("n") > 0, (gap * gap).cast("double") / F.nullif("n", F.lit(0))).alias("chi_square"), "log10_p",
        F.when(p > 0, p).alias("p"), scientific(F.col("log10_p")).alias("p_text"),
    )


def system_delta(blocks: DataFrame, measures: tuple[str, ...] = ("macro_f1", "accuracy", "ece")) -> DataFrame:
    """One row: tuned minus base of each measure, from (system, measures)."""
    def of(system: str, name: str) -> Column:
        return F.max(F.when(F.col("system") == system, F.col(name)))

    return blocks.agg(*[(of("tuned", m) - of("base", m)).alias(m) for m in measures])
