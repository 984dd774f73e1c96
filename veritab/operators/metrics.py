"""Classification metrics and reliability from predictions and scores.

Everything reduces to counts over at most a few dozen cells; formulas run on the
cells, so one partial aggregation of the rows is all that is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritab.functions.scores import CLASSES, edges, first_of, loss_of, reliability_bin, with_probabilities

BINS = 15


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def confusion(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, label, pred, rows): all 16 cells; predictions outside 0..3 are in none.

    ``predictions`` has label and pred; rows with a null label don't count, a null
    prediction counts as one outside the range.
    """
    by = by or []
    cells = predictions.where(F.col("label").isNotNull()).groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    wide = cells.groupBy(*by).agg(*[F.sum(F.when((F.col("label") == k // CLASSES) & (F.col("pred") == k % CLASSES), F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(CLASSES**2)])
    long_ = F.explode(F.array(*[F.struct(F.lit(k // CLASSES).alias("label"), F.lit(k % CLASSES).alias("pred"), F.coalesce(f"c{k}", F.lit(0)).alias("rows")) for k in range(CLASSES**2)]))
    return wide.select(*by, long_.alias("x")).select(*by, "x.*")


def _counts(k: int) -> dict[str, Column]:
    label, pred = F.col("label") == k, F.coalesce(F.col("pred") == k, F.lit(False))
    return {f"tp{k}": label & pred, f"truth{k}": label, f"guess{k}": pred}


def _wide(predictions: DataFrame, by: list[str]) -> DataFrame:
    """One row of counts for each group."""
    out = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label").eqNullSafe(F.col("pred"))).alias("correct"), F.count_if(~F.coalesce(F.col("pred").between(0, CLASSES - 1), F.lit(False))).alias("invalid")]
    for k in range(CLASSES):
        out += [F.count_if(c).alias(n) for n, c in _counts(k).items()]
    return predictions.where(F.col("label").isNotNull()).groupBy(*by).agg(*out)


def _f1(k: int) -> Column:
    return ratio(2 * F.col(f"tp{k}"), F.col(f"truth{k}") + F.col(f"guess{k}"))


def per_class(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, label, precision, recall, f1, support) of all four classes.

    A class never predicted has precision 0, one that never occurs recall 0; a
    prediction out of range is a miss of its true class.
    """
    by = by or []
    rows = [
        F.struct(F.lit(k).alias("label"), ratio(F.col(f"tp{k}"), F.col(f"guess{k}")).alias("precision"), ratio(F.col(f"tp{k}"), F.col(f"truth{k}")).alias("recall"), _f1(k).alias("f1"), F.col(f"truth{k}").alias("support"))
        for k in range(CLASSES)
    ]
    return _wide(predictions, by).select(*by, F.explode(F.array(*rows)).alias("x")).select(*by, "x.*")


def accuracy_macro_f1(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, rows, accuracy, macro_f1, invalid_rate); the mean of F1 is over all four classes."""
    by = by or []
    mean = (_f1(0) + _f1(1) + _f1(2) + _f1(3)) / F.lit(float(CLASSES))
    wide = _wide(predictions, by).where("rows > 0")
    return wide.select(*by, "rows", ratio(F.col("correct"), F.col("rows")).alias("accuracy"), mean.alias("macro_f1"), ratio(F.col("invalid"), F.col("rows")).alias("invalid_rate"))


def macro_f1_of_cells(cells: DataFrame, by: list[str], label: str, pred: str, weight: str, name: str) -> DataFrame:
    """(*by, name): macro-F1 from weighted cells, 2tp / (2tp + fp + fn) of each class."""
    def total(condition: Column, alias: str) -> Column:
        return F.sum(F.when(condition, F.col(weight)).otherwise(0)).alias(alias)

    sums = []
    for k in range(CLASSES):
        sums += [total((F.col(label) == k) & (F.col(pred) == k), f"tp{k}"), total(F.col(label) == k, f"truth{k}"), total(F.col(pred) == k, f"guess{k}")]
    mean = (_f1(0) + _f1(1) + _f1(2) + _f1(3)) / F.lit(float(CLASSES))
    return cells.groupBy(*by).agg(*sums).select(*by, mean.alias(name))


def scored(logits: DataFrame, temperature: Column | float | None = 1.0) -> DataFrame:
    """``logits`` with p, pred, confidence, correct and loss at a temperature."""
    made = ("p", "pred", "confidence", "correct", "loss")
    wide, each = with_probabilities(logits, temperature)
    wide = wide.withColumn("_top", F.greatest(*each))
    wide = wide.withColumn("_pred", first_of(each, F.col("_top")))
    return wide.select(
        *[c for c in logits.columns if c not in made], F.array(*each).alias("p"), F.col("_pred").alias("pred"), F.col("_top").alias("confidence"),
        (F.col("_pred") == F.col("label")).alias("correct"), loss_of(each, F.col("label")).alias("loss"),
    )


def reliability(scores: DataFrame, by: list[str] | None = None, bins: int = 15) -> DataFrame:
    """(*by, bin, lower, upper, rows, average_confidence, accuracy, gap): all bins.

    ``scores`` has confidence and correct.  Bins are closed on the right; an empty
    bin stays with nulls; the gap is confidence minus accuracy, with its sign.
    """
    if type(bins) is not int or bins <= 0:
        raise ValueError("bins must be a positive integer")
    by = by or []
    part = scores.withColumn("bin", reliability_bin(F.col("confidence"), bins)).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("average_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )
    border = edges(bins)
    spine = F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(border[i]).alias("lower"), F.lit(border[i + 1]).alias("upper")) for i in range(bins)]))
    base = part.select(*by).distinct() if by else scores.sparkSession.range(1).select()
    every = base.select(*by, spine.alias("x")).select(*by, "x.*")
    joined = every.join(part, [*by, "bin"], "left")
    return joined.select(*by, "bin", "lower", "upper", F.coalesce("rows", F.lit(0)).alias("rows"), "average_confidence", "accuracy", (F.col("average_confidence") - F.col("accuracy")).alias("gap"))


def calibration_error(bins_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, ece): the mean absolute gap weighted by rows; null without rows."""
    by = by or []
    total = F.sum("rows")
    weighted = F.sum(F.col("rows") * F.abs(F.coalesce("gap", F.lit(0.0))))
    return bins_.groupBy(*by).agg(F.when(total > 0, weighted / total).alias("ece"))


def evaluation_block(logits: DataFrame, by: list[str], temperature: Column | float = 1.0) -> DataFrame:
    """(*by, rows, accuracy, macro_f1, invalid_rate, nll, ece): one row for each group.

    One scan and one aggregation: the counts of each class and the gap of each bin
    are sums of their own, reduced before the shuffle to one row for each group.
    """
    rows = scored(logits, temperature).withColumn("bin", reliability_bin(F.col("confidence")))
    right = F.col("correct").cast("double")
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("loss").alias("loss"), F.sum(right).alias("right")]
    for k in range(CLASSES):
        sums += [F.count_if(c).alias(n) for n, c in _counts(k).items()]
    sums += [F.sum(F.when(F.col("bin") == b, F.col("confidence") - right)).alias(f"gap{b}") for b in range(BINS)]
    wide = rows.groupBy(*by).agg(*sums).where("rows > 0")
    mean = (_f1(0) + _f1(1) + _f1(2) + _f1(3)) / F.lit(float(CLASSES))
    gaps = F.lit(0.0)
    for b in range(BINS):
        gaps = gaps + F.abs(F.coalesce(f"gap{b}", F.lit(0.0)))
    n = F.col("rows")
    return wide.select(*by, "rows", (F.col("right") / n).alias("accuracy"), mean.alias("macro_f1"), F.lit(0.0).alias("invalid_rate"), (F.col("loss") / n).alias("nll"), (gaps / n).alias("ece"))
