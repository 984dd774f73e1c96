import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.functions.scores import argmax, edges, reliability_bin, softmax, valid_scores
from veritab.operators import calibration, metrics
from veritab.plans.blocks import attached, evaluation_block

#: Published confusion matrices with their macro-F1.
MATRICES = [
    ([[1629, 89, 150, 32], [111, 1701, 65, 23], [172, 33, 1636, 59], [289, 72, 860, 679]], 0.7261902147623102),
    ([[1776, 26, 54, 44], [6, 1885, 8, 1], [52, 6, 1738, 104], [45, 2, 159, 1694]], 0.9332520991438105),
    ([[434, 24, 36, 6], [43, 442, 11, 4], [39, 6, 441, 14], [74, 21, 227, 178]], 0.7299025824068093),
    ([[465, 7, 17, 11], [5, 495, 0, 0], [10, 1, 457, 32], [12, 1, 42, 445]], 0.9309929481760548),
    ([[434, 24, 36, 6], [43, 442, 11, 4], [39, 6, 441, 14], [73, 21, 228, 178]], 0.7299361500436565),
]


def predictions(spark, rows):
    return spark.createDataFrame(rows, "label int, pred int")


def scores(spark, z, labels):
    return spark.createDataFrame([(i, int(y), [float(v) for v in r]) for i, (r, y) in enumerate(zip(z, labels))], "pos bigint, label int, z array<float>")


@pytest.mark.parametrize("matrix, macro", MATRICES)
def test_published_matrices(spark, matrix, macro):
    cells = spark.createDataFrame([(a, b, n) for a, row in enumerate(matrix) for b, n in enumerate(row)], "label int, pred int, n bigint")
    rows = cells.select("label", "pred", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).select("label", "pred")
    found = metrics.accuracy_macro_f1(rows).first()
    assert found["macro_f1"] == pytest.approx(macro, abs=1e-12)
    assert found["accuracy"] == pytest.approx(np.trace(matrix) / np.sum(matrix), abs=1e-12)
    assert sorted(tuple(r) for r in metrics.confusion(rows).collect()) == sorted((a, b, n) for a, row in enumerate(matrix) for b, n in enumerate(row))
    assert metrics.macro_f1_of_cells(cells, [], "label", "pred", "n", "m").first()["m"] == pytest.approx(macro, abs=1e-12)


def test_invalid_predictions(spark):
    rows = predictions(spark, [(0, 0), (1, 9)])
    found = metrics.accuracy_macro_f1(rows).first()
    assert (found["accuracy"], found["invalid_rate"]) == (0.5, 0.5)
    one = {r["label"]: r for r in metrics.per_class(rows).collect()}
    assert one[1]["recall"] == 0 and one[1]["support"] == 1 and one[2]["f1"] == 0
    assert sum(r["rows"] for r in metrics.confusion(rows).collect()) == 1
    nulls = metrics.accuracy_macro_f1(predictions(spark, [(0, None), (None, 1)])).first()
    assert (nulls["rows"], nulls["invalid_rate"]) == (1, 1.0)
    assert metrics.accuracy_macro_f1(predictions(spark, [])).count() == 0


def test_softmax_argmax_and_bins(spark):
    df = spark.createDataFrame([([0.0, 3.0, 3.0, 1.0],), ([1e30, 0.0, 0.0, 0.0],)], "z array<float>")
    rows = df.select(softmax(F.col("z")).alias("p"), argmax(softmax(F.col("z"))).alias("a")).collect()
    assert [r["a"] for r in rows] == [1, 0]
    assert sum(rows[0]["p"]) == pytest.approx(1)
    assert edges(15) == np.linspace(0, 1, 16).tolist()
    values = [0.0, 1.0, *edges(15), *np.nextafter(edges(15), 2)[:-1].tolist()]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "c double").select(reliability_bin(F.col("c"))).collect()]
    e = np.linspace(0, 1, 16)
    assert found == [next(i for i in range(15) if (i == 0 and v <= e[1]) or e[i] < v <= e[i + 1]) for v in values]


def test_float32_division_is_numpys(spark):
    z = np.random.default_rng(0).normal(0, 5, (500, 4)).astype(np.float32)
    df = scores(spark, z, [0] * 500)
    from veritab.functions.scores import divided

    for t in (1.2925297694782887, 4.526268843270257):
        found = np.array([r[0] for r in df.orderBy("pos").select(divided(F.col("z"), t)).collect()])
        assert (found == (z / np.float32(t)).astype(np.float64)).all()


def nll(z, y, t=1.0):
    v = (z / np.float32(t)).astype(float)
    e = np.exp(v - v.max(1, keepdims=True))
    return float(-np.log(np.clip((e / e.sum(1, keepdims=True))[np.arange(len(y)), y], 1e-12, 1)).mean())


def test_blocks(spark):
    block = evaluation_block(scores(spark, np.eye(4, dtype=np.float32) * 10, range(4)))
    assert block["macro_f1"] == 1 and block["accuracy"] == 1 and block["calibration"]["ece"] < 0.001
    assert [b["count"] for b in block["calibration"]["bins"]] == [0] * 14 + [4]
    assert block["calibration"]["bins"][0]["gap"] is None
    rng = np.random.default_rng(3)
    z, y = rng.normal(0, 2, (300, 4)).astype(np.float32), rng.integers(0, 4, 300)
    block = evaluation_block(scores(spark, z, y), 1.7)
    assert block["nll"] == pytest.approx(nll(z, y, 1.7), abs=1e-12)
    flat = metrics.evaluation_block(scores(spark, z, y).withColumn("system", F.lit("x")), ["system"], 1.7).first()
    for name, value in (("accuracy", block["accuracy"]), ("macro_f1", block["macro_f1"]), ("nll", block["nll"]), ("ece", block["calibration"]["ece"])):
        assert flat[name] == pytest.approx(value, abs=1e-12)


def test_reliability_of_calibrated_rows(spark):
    rows = spark.createDataFrame([(0.7, i < 70) for i in range(100)], "confidence double, correct boolean")
    assert metrics.calibration_error(metrics.reliability(rows, bins=10)).first()["ece"] == pytest.approx(0)
    with pytest.raises(ValueError):
        metrics.reliability(rows, bins=0)


def reference_fit(z, y, low=0.05, high=10.0, tolerance=1e-4):
    k = (math.sqrt(5) - 1) / 2
    while high - low > tolerance:
        c, d = high - k * (high - low), low + k * (high - low)
        low, high = (low, d) if nll(z, y, c) < nll(z, y, d) else (c, high)
    return (low + high) / 2


def test_temperature(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 4, 200)
    z = rng.normal(0, 1.5, (200, 4)).astype(np.float32)
    z[np.arange(200), y] += 3.0
    df = scores(spark, z, y)
    fitted = calibration.fit_temperature(df)
    assert fitted == reference_fit(z, y)
    assert calibration.fit_temperature(df, levels=1) == fitted
    assert evaluation_block(df)["confusion_matrix"] == evaluation_block(df, fitted)["confusion_matrix"]
    noise = scores(spark, rng.normal(0, 200, (200, 4)), y)
    with pytest.raises(ValueError, match="bound"):
        calibration.fit_temperature(noise)
    with pytest.raises(ValueError):
        calibration.fit_temperature(df.limit(0))
    for bad in (calibration.Search(0.0), calibration.Search(2.0, 1.0), calibration.Search(1.0, 2.0, 5.0), calibration.Search(True)):
        with pytest.raises(ValueError):
            bad.checked()
    curve = {r["temperature"]: r["nll"] for r in calibration.nll_curve(df, [1.0, 2.0]).collect()}
    assert curve[2.0] == pytest.approx(nll(z, y, 2.0), abs=1e-12)


def test_scores_must_match_labels(spark):
    df = scores(spark, np.eye(4), range(4))
    assert attached(df, df).count() == 4
    labels = df.select("pos", "label")
    for bad in (df.limit(3), df.limit(0), df.withColumn("z", F.lit(None).cast("array<float>")), df.withColumn("z", F.array(*[F.lit(float("nan")).cast("float")] * 4)), df.unionAll(df.limit(1))):
        with pytest.raises(RuntimeError):
            attached(bad.select("pos", "z"), labels if bad.count() else labels.limit(0))
    assert [r[0] for r in spark.sql("select array(1f,2f,3f) z union all select null").select(valid_scores(F.col("z"))).collect()] == [False, False]
