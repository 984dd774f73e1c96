"""Class scores as columns: softmax, arg-max, float32 temperature, reliability bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CLASSES = 4
LEAST_PROBABILITY = 1e-12


def divided(z: Column, temperature: Column | float) -> Column:
    """Scores over a temperature with the rounding of 32-bit floats, as doubles.

    The quotient of two floats taken in double and rounded to float is the float
    quotient, since a double has more than twice the bits.
    """
    t = (F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature).cast("float").cast("double")
    return F.transform(z, lambda x: (x.cast("float").cast("double") / t).cast("float").cast("double"))


def _powers(z: Column, temperature: Column | float | None, classes: int) -> list[Column]:
    """exp(score - largest score) of each class, in double, without arrays.

    Written out for each class, so that a pass over the rows stays in generated
    code; a missing score makes the sums of all null.
    """
    values = [F.get(z, F.lit(k)).cast("float").cast("double") for k in range(classes)]
    if temperature is not None:
        t = (F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature).cast("float").cast("double")
        values = [(v / t).cast("float").cast("double") for v in values]
    top = F.greatest(*values)
    return [F.exp(v - top) for v in values]


def probabilities(z: Column, temperature: Column | float | None = None, classes: int = CLASSES) -> list[Column]:
    """The softmax of the scores as one column for each class."""
    powers = _powers(z, temperature, classes)
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return [p / total for p in powers]


def with_probabilities(rows: DataFrame, temperature: Column | float | None = None, classes: int = CLASSES) -> tuple[DataFrame, list[Column]]:
    """``rows`` with the softmax of z in columns _p0, _p1, ..., and those columns.

    One step after the other, so that the generated code computes each value once
    and stays small.
    """
    t = None if temperature is None else (F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature).cast("float").cast("double")
    each = range(classes)
    score = [F.get("z", F.lit(k)).cast("float").cast("double") for k in each]
    out = rows.withColumns({f"_v{k}": s if t is None else (s / t).cast("float").cast("double") for k, s in enumerate(score)})
    out = out.withColumn("_t", F.greatest(*[F.col(f"_v{k}") for k in each]))
    out = out.withColumns({f"_e{k}": F.exp(F.col(f"_v{k}") - F.col("_t")) for k in each})
    out = out.withColumn("_s", sum((F.col(f"_e{k}") for k in range(1, classes)), F.col("_e0")))
    out = out.withColumns({f"_p{k}": F.col(f"_e{k}") / F.col("_s") for k in each})
    kept = [*rows.columns, *(f"_p{k}" for k in each)]
    return out.select(*kept), [F.col(f"_p{k}") for k in each]


def loss_of(each: list[Column], label: Column) -> Column:
    """-ln of the true class's probability, cut to [1e-12, 1]."""
    true = each[-1]
    for k in range(len(each) - 2, -1, -1):
        true = F.when(label == k, each[k]).otherwise(true)
    return -F.ln(F.greatest(F.lit(LEAST_PROBABILITY), F.least(F.lit(1.0), true)))


def softmax(z: Column, temperature: Column | float | None = None, classes: int = CLASSES) -> Column:
    """Probabilities in double as an array; the largest score is subtracted first."""
    return F.array(*probabilities(z, temperature, classes))


def argmax(values: Column) -> Column:
    """The first place of the largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def first_of(columns: list[Column], value: Column) -> Column:
    """The number of the first column that has the value."""
    out = F.when(columns[0] == value, 0)
    for k, c in enumerate(columns[1:], 1):
        out = out.when(c == value, k)
    return out.cast("int")


def log_loss(z: Column, label: Column, temperature: Column | float = 1.0, classes: int = CLASSES) -> Column:
    """-ln of the true class's probability, cut to [1e-12, 1]."""
    return loss_of(probabilities(z, temperature, classes), label)


def edges(bins: int) -> list[float]:
    """Borders of equal bins of [0, 1], as the nearest doubles to i * (1 / bins)."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def reliability_bin(confidence: Column, bins: int = 15) -> Column:
    """The right-closed bin of a confidence; the first is closed on the left too.

    The guess from the product is moved by at most one bin, so that it agrees with
    the borders as doubles.
    """
    borders = F.array(*[F.lit(x) for x in edges(bins)])
    guess = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil(confidence * bins).cast("int") - 1))
    low, high = F.get(borders, guess), F.get(borders, guess + 1)
    return F.when((guess > 0) & (confidence <= low), guess - 1).when((guess < bins - 1) & (confidence > high), guess + 1).otherwise(guess)


def valid_scores(z: Column, classes: int = CLASSES) -> Column:
    """Whether there are the right number of scores, all finite."""
    return F.coalesce((F.size(z) == classes) & F.forall(z, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
