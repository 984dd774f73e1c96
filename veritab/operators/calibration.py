"""Fitting a temperature to scores."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from veritab.functions.scores import loss_of, with_probabilities

INVERSE_PHI = (math.sqrt(5.0) - 1.0) / 2.0
#: Steps of the search decided by one pass over the rows.
LEVELS = 4


class Search(NamedTuple):
    low: float = 0.05
    high: float = 10.0
    tolerance: float = 1e-4

    def checked(self) -> Search:
        if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x > 0 for x in self):
            raise ValueError("the search needs finite positive bounds and tolerance")
        if self.low >= self.high or self.tolerance >= self.high - self.low:
            raise ValueError("the search bounds must enclose more than the tolerance")
        return self


def probes(low: float, high: float) -> tuple[float, float]:
    """The two inner points of a golden section."""
    return high - INVERSE_PHI * (high - low), low + INVERSE_PHI * (high - low)


def reachable(low: float, high: float, levels: int, tolerance: float) -> set[float]:
    """All points that the next steps can look at, whichever way they turn."""
    if not levels or high - low <= tolerance:
        return set()
    c, d = probes(low, high)
    return {c, d} | reachable(low, d, levels - 1, tolerance) | reachable(c, high, levels - 1, tolerance)


def _losses(logits: DataFrame, by: list[str], temperatures: Column) -> DataFrame:
    """(*by, temperature, nll): the mean log loss at each of an array of temperatures."""
    each, p = with_probabilities(logits.withColumn("temperature", F.explode(temperatures)), F.col("temperature"))
    return each.withColumn("_loss", loss_of(p, F.col("label"))).groupBy(*by, "temperature").agg(F.avg("_loss").alias("nll"))


def nll_curve(logits: DataFrame, temperatures: list[float], by: list[str] | None = None) -> DataFrame:
    """(*by, temperature, nll): the mean log loss at each temperature, in one pass.

    The points are unfolded next to each row and reduced before the shuffle, so
    only one row for each group and point is moved.
    """
    return _losses(logits, by or [], F.array(*[F.lit(float(t)) for t in temperatures]))


def _searched(losses: Callable[[dict], dict], names: list, search: Search, levels: int) -> dict:
    """Golden section for each name; ``losses`` maps points of each name to their loss."""
    search.checked()
    state = {name: (search.low, search.high) for name in names}

    def open_(bounds: tuple[float, float]) -> bool:
        return bounds[1] - bounds[0] > search.tolerance

    while unfinished := [n for n in names if open_(state[n])]:
        loss = losses({n: sorted(reachable(*state[n], levels, search.tolerance)) for n in unfinished})
        for n in unfinished:
            for _ in range(levels):
                if open_((low_high := state[n])):
                    (low, high), (c, d) = low_high, probes(*low_high)
                    state[n] = (low, d) if loss[n, c] < loss[n, d] else (c, high)
    fitted = {n: (low + high) / 2.0 for n, (low, high) in state.items()}
    for n, t in fitted.items():
        if not search.low + 10 * search.tolerance < t < search.high - 10 * search.tolerance:
            raise ValueError(f"the search ended at its bound ({t:.4f} in [{search.low}, {search.high}]); the optimum lies outside")
    return fitted


def fit_temperature(logits: DataFrame, search: Search = Search(), levels: int = LEVELS) -> float:
    """The temperature of least log loss by golden section; ``logits`` has z and label.

    One pass evaluates every point that the next ``levels`` steps can need, so a
    fit to the default tolerance reads the rows 6 times instead of 48.  A minimum
    within ten tolerances of a bound, and an empty input, are refused.
    """
    return fit_temperatures(logits.withColumn("_one", F.lit(0)), "_one", search, levels)[0]


def fit_temperatures(logits: DataFrame, by: str, search: Search = Search(), levels: int = LEVELS) -> dict:
    """fit_temperature() for each value of ``by``, a column of few values such as the system.

    All values share the passes over the rows.
    """
    names = sorted(r[0] for r in logits.where(F.col(by).isNotNull()).select(by).distinct().collect())
    if not names:
        raise ValueError("a temperature can't be fitted to no rows")

    def losses(points: dict) -> dict:
        arrays = None
        for name, own in points.items():
            one = F.array(*[F.lit(t) for t in own])
            arrays = F.when(F.col(by) == name, one) if arrays is None else arrays.when(F.col(by) == name, one)
        return {(r[0], r[1]): r[2] for r in _losses(logits, [by], arrays).collect()}

    return _searched(losses, names, search, levels)
