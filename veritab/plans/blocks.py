"""The metrics of a scored split as one small tree."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from veritab.errors import EvidenceError
from veritab.functions.scores import valid_scores
from veritab.functions.text import CLASS_NAMES
from veritab.operators import digests, metrics

BINS = 15


def attached(logits: DataFrame, labels: DataFrame) -> DataFrame:
    """(pos, label, z) of scores and labels that match row for row, or a refusal."""
    both = logits.select("pos", "z").join(labels.select("pos", "label"), "pos", "full_outer")
    good = valid_scores(F.col("z")) & F.coalesce(F.col("label").between(0, 3), F.lit(False))
    n, bad, distinct = both.agg(F.count(F.lit(1)), F.count_if(~good), F.count_distinct("pos")).first()
    if not n or bad or distinct != n:
        raise EvidenceError(f"scores and labels don't match: {n} places, {distinct} distinct, {bad} without finite scores or a class")
    return both


def evaluation_block(rows: DataFrame, temperature: float = 1.0) -> dict[str, Any]:
    """Accuracy, macro-F1, per class numbers, confusion matrix, NLL and reliability of (pos, label, z)."""
    if isinstance(temperature, bool) or not 0 < temperature < float("inf"):
        raise ValueError("a temperature must be finite and positive")
    scored = metrics.scored(rows, temperature).select("label", "pred", "confidence", "correct", "loss")
    main = metrics.accuracy_macro_f1(scored).first()
    if main is None:
        raise ValueError("there are no rows to evaluate")
    classes = sorted(metrics.per_class(scored).collect())
    cells = {(c["label"], c["pred"]): c["rows"] for c in metrics.confusion(scored).collect()}
    bins = sorted(metrics.reliability(scored, bins=BINS).collect(), key=lambda b: b["bin"])
    names = ("lower", "upper", "count", "average_confidence", "accuracy", "gap")
    return {
        "rows": main["rows"], "accuracy": main["accuracy"], "macro_f1": main["macro_f1"], "invalid_prediction_rate": main["invalid_rate"],
        "per_class": {CLASS_NAMES[c["label"]]: {k: c[k] for k in ("precision", "recall", "f1", "support")} for c in classes},
        "confusion_matrix": [[cells[a, b] for b in range(4)] for a in range(4)],
        "nll": scored.agg(F.avg("loss")).first()[0],
        "calibration": {"ece": sum(b["rows"] / main["rows"] * abs(b["gap"] or 0.0) for b in bins), "bins": [dict(zip(names, b[1:])) for b in bins], "n_bins": BINS},
        "temperature": float(temperature),
    }


def predictions(rows: DataFrame) -> DataFrame:
    return metrics.scored(rows).select("pos", "label", "pred")


def prediction_digest(rows: DataFrame) -> str:
    return digests.streamed(predictions(rows), "pred", "pos", ",")


def label_digest(labels: DataFrame) -> str:
    return digests.streamed(labels, "label", "pos", ",")
