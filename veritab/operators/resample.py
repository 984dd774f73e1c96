"""Paired bootstrap of the macro-F1 of two systems.

Three ways to draw.  ``cells``: both systems depend on a row only through its cell
(label, base, tuned), and drawing n of n rows with replacement draws multinomial
cell counts, so resamples come from 64 counts however many rows there are.
``hash``: each draw is a hash of seed, resample and place, portable to any engine.
``exact``: the one sequential stream of numpy's generator, for published numbers;
it reads n labels into one task and is meant for test sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from veritab.functions.scores import CLASSES
from veritab.operators.metrics import macro_f1_of_cells
from veritab.session import written

CELLS = CLASSES**3


def positions(rows: DataFrame, order: str, name: str = "j") -> DataFrame:
    """``rows`` with their place from 0 in the order of a unique column.

    Rows are range partitioned and sorted; places within partitions are shifted by
    the counts of those before, a table of one row for each partition.
    """
    sorted_ = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = written(sorted_, "positions")
    part = F.shiftright("_at", 33)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    joined = sorted_.withColumn("_part", part).join(F.broadcast(shifts), "_part")
    return joined.withColumn(name, F.col("_shift") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_shift")


def hash_draws(spark, rows: int, resamples: int, seed: int = 73) -> DataFrame:
    """(resample, j, drawn): for each place j of each resample the place drawn.

    Drawn is the first 60 bits of SHA-256(seed, resample, j; NUL between) modulo
    the number of rows.  One range makes all places; there is no cross join.
    """
    if rows < 1 or resamples < 1:
        raise ValueError("rows and resamples must be positive")
    every = spark.range(rows * resamples).select(F.expr(f"id div {rows}").alias("resample"), F.expr(f"id % {rows}").alias("j"))
    digest = F.sha2(F.concat_ws("\0", F.lit(str(seed)), F.col("resample").cast("string"), F.col("j").cast("string")), 256)
    return every.withColumn("drawn", F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(rows)))


def hash_resamples(predictions: DataFrame, rows: int, resamples: int, seed: int = 73) -> DataFrame:
    """(resample, base, tuned, delta) from hash draws; ``predictions`` has j, label, base, tuned.

    Draws are counted for each (resample, place) first; the predictions are joined
    by place and are broadcast only where the optimiser knows them to be small.
    """
    draws = hash_draws(predictions.sparkSession, rows, resamples, seed)
    placed = predictions.select(F.col("j").alias("drawn"), "label", "base", "tuned")
    cells = draws.join(placed, "drawn").groupBy("resample", "label", "base", "tuned").agg(F.count(F.lit(1)).alias("n"))
    base = macro_f1_of_cells(cells, ["resample"], "label", "base", "n", "base")
    tuned = macro_f1_of_cells(cells, ["resample"], "label", "tuned", "n", "tuned")
    return base.join(tuned, "resample").withColumn("delta", F.col("tuned") - F.col("base"))


def summary(resamples: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(system, ci_lower, ci_upper, ci_width, no_improvement): linear percentiles.

    ``no_improvement`` counts the resamples with delta <= 0, null for single systems.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be in (0, 1)")
    long_ = resamples.select(F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("value")) for s in ("base", "tuned", "delta")])).alias("x")).select("x.*")
    ends = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = long_.groupBy("system").agg(ends.alias("e"), F.count_if(F.col("value") <= 0).alias("n"))
    return out.select(
        "system", F.col("e")[0].alias("ci_lower"), F.col("e")[1].alias("ci_upper"), (F.col("e")[1] - F.col("e")[0]).alias("ci_width"),
        F.when(F.col("system") == "delta", F.col("n")).alias("no_improvement"),
    )


def cell_counts(predictions: DataFrame) -> np.ndarray:
    """Rows of each (label, base, tuned), at most 64 numbers."""
    out = np.zeros(CELLS, np.int64)
    for label, base, tuned, n in predictions.groupBy("label", "base", "tuned").count().collect():
        if None in (label, base, tuned) or not all(0 <= x < CLASSES for x in (label, base, tuned)):
            raise ValueError("labels and predictions must be classes 0 to 3")
        out[(label * CLASSES + base) * CLASSES + tuned] = n
    if not out.sum():
        raise ValueError("there are no rows to resample")
    return out


def macro_f1(cells: np.ndarray) -> np.ndarray:
    """Macro-F1 of (..., label, pred) counts."""
    hit = np.diagonal(cells, axis1=-2, axis2=-1).astype(float)
    whole = cells.sum(-1) + cells.sum(-2)
    return np.divide(2 * hit, whole, out=np.zeros_like(hit), where=whole > 0).mean(-1)


def _values(counts: np.ndarray) -> pd.DataFrame:
    cube = counts.reshape(-1, CLASSES, CLASSES, CLASSES)
    base, tuned = macro_f1(cube.sum(3)), macro_f1(cube.sum(2))
    return pd.DataFrame({"resample": np.arange(len(cube)), "base": base, "tuned": tuned, "delta": tuned - base})


def cell_resamples(counts: np.ndarray, resamples: int = 2000, seed: int = 73) -> pd.DataFrame:
    """(resample, base, tuned, delta) by multinomial cell counts."""
    return _values(np.random.default_rng(seed).multinomial(int(counts.sum()), counts / counts.sum(), resamples))


def exact_resamples(predictions: DataFrame, resamples: int = 2000, seed: int = 73) -> DataFrame:
    """(resample, base, tuned, delta) by the sequential generator; ``predictions`` has pos, label, base, tuned."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        cell = ((rows["label"] * CLASSES + rows["base"]) * CLASSES + rows["tuned"]).to_numpy()
        rng = np.random.default_rng(seed)
        return _values(np.stack([np.bincount(cell[rng.integers(0, len(cell), len(cell))], minlength=CELLS) for _ in range(resamples)]))

    one = predictions.select(F.lit(0).alias("one"), "pos", "label", "base", "tuned")
    return one.groupBy("one").applyInPandas(run, "resample bigint, base double, tuned double, delta double")


def percentile_interval(values: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    if not 0 < alpha < 1:
        raise ValueError("alpha must be in (0, 1)")
    low, high = np.percentile(values, (100 * alpha / 2, 100 * (1 - alpha / 2)))
    return float(low), float(high)
