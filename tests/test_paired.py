import hashlib
import math

import numpy as np
import pytest

from veritab.operators import paired, resample, selection
from veritab.plans import catalog


def pairs(spark, labels, base, tuned):
    return spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(zip(labels, base, tuned))], "pos bigint, label int, base int, tuned int")


def test_counts(spark):
    found = paired.paired_counts(pairs(spark, [0, 1, 2, 3, 0, 1], [0, 1, 0, 0, 1, 1], [0, 2, 2, 3, 0, 1])).first()
    assert tuple(found) == (6, 4, 3, 1, 2, 0)
    with_null = spark.sql("select 0 label, cast(null as int) base, 1 tuned union all select 1, 1, 1")
    assert tuple(paired.paired_counts(with_null).first()) == (1, 0, 0, 0, 1, 0)


def exact_log10(f, b):
    n, m = f + b, min(f, b)
    total = sum(math.comb(n, k) for k in range(m + 1))
    return min(0.0, math.log10(total) - (n - 1) * math.log10(2)) if n < 3000 else None


@pytest.mark.parametrize("f, b", [(50, 50), (10, 0), (0, 10), (1, 0), (1577, 129), (300, 280), (7, 3), (1, 1)])
def test_mcnemar(spark, f, b):
    r = paired.mcnemar(spark.createDataFrame([(f, b)], "fixed bigint, broken bigint")).first()
    assert r["discordant"] == f + b
    assert r["chi_square"] == pytest.approx((abs(f - b) - 1) ** 2 / (f + b))
    assert r["log10_p"] == pytest.approx(exact_log10(f, b), rel=1e-12, abs=1e-12)


def test_mcnemar_edges(spark):
    def one(f, b):
        return paired.mcnemar(spark.createDataFrame([(f, b)], "fixed bigint, broken bigint")).first()

    none = one(0, 0)
    assert none["discordant"] == 0 and none["chi_square"] is None and none["p"] is None and none["p_text"] is None
    assert one(50, 50)["p"] == 1.0 and one(50, 50)["chi_square"] == pytest.approx(0.01)
    assert one(10, 0)["p"] == pytest.approx(2 / 2**10)
    tiny = one(1577, 129)
    assert tiny["chi_square"] == pytest.approx(1227.320633059789) and tiny["log10_p"] == pytest.approx(-316.14715943205175, rel=1e-13)
    assert tiny["p_text"].endswith("e-317") and tiny["p"] > 0
    assert one(5000, 100)["p"] is None
    big = one(500_000_000, 499_000_000)
    assert -220 < big["log10_p"] < -210
    with pytest.raises(Exception, match="negative"):
        one(-1, 3)


def test_mcnemar_groups_run_the_whole_test(spark, small):
    lines = catalog.I.line_predictions(spark, small).select("label", "base", "tuned").collect()
    found = {r["grp"]: r for r in catalog.QUERIES["mcnemar_groups"](spark, small).collect()}
    assert set(found) == {r["label"] for r in lines} and len(found) == 4
    for grp, r in found.items():
        own = [x for x in lines if x["label"] == grp]
        f, b = sum(x["base"] != grp == x["tuned"] for x in own), sum(x["base"] == grp != x["tuned"] for x in own)
        log10_p = exact_log10(f, b)
        assert r["discordant"] == f + b and r["chi_square"] == pytest.approx((abs(f - b) - 1) ** 2 / (f + b), abs=1e-8)
        assert r["log10_p"] == pytest.approx(log10_p, abs=1e-8)
        assert r["p"] == (pytest.approx(10**log10_p, rel=1e-9) if 10**log10_p > 0 else None)


def test_pairing(spark):
    rows = spark.createDataFrame([("base", 1, 0, 2), ("tuned", 1, 0, 0), ("base", 2, 1, 1)], "system string, pos bigint, label int, pred int")
    assert [tuple(r) for r in paired.pair_systems(rows).collect()] == [(1, 0, 2, 0)]
    assert [tuple(r) for r in paired.unpaired(rows).collect()] == [(2, "base")]


def numpy_exact(labels, base, tuned, resamples, seed):
    rng = np.random.default_rng(seed)

    def f1(y, p):
        out = []
        for k in range(4):
            tp, whole = ((y == k) & (p == k)).sum(), (y == k).sum() + (p == k).sum()
            out.append(2 * tp / whole if whole else 0.0)
        return np.mean(out)

    draws = [rng.integers(0, len(labels), len(labels)) for _ in range(resamples)]
    return np.array([(f1(labels[d], base[d]), f1(labels[d], tuned[d])) for d in draws])


def test_bootstrap_modes(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 4, 150)
    base, tuned = (np.where(rng.random(150) < p, y, rng.integers(0, 4, 150)) for p in (0.5, 0.9))
    df = pairs(spark, y, base, tuned)
    exact = resample.exact_resamples(df, 60, 73).toPandas().sort_values("resample")
    assert np.allclose(exact[["base", "tuned"]], numpy_exact(y, base, tuned, 60, 73), atol=1e-12)
    summary = {r["system"]: r for r in resample.summary(resample.exact_resamples(df, 60, 73)).collect()}
    low, high = resample.percentile_interval(exact["delta"].to_numpy())
    assert summary["delta"]["ci_lower"] == pytest.approx(low) and summary["delta"]["ci_upper"] == pytest.approx(high)
    hashed = resample.hash_resamples(df.withColumnRenamed("pos", "j"), 150, 80).toPandas()
    cells = resample.cell_resamples(resample.cell_counts(df), 2000)
    for other in (hashed, cells):
        assert abs(other["delta"].mean() - exact["delta"].mean()) < 0.03
        assert 0.4 < other["delta"].std() / exact["delta"].std() < 2.2


def test_bootstrap_ci_takes_all_resamples(spark, small):
    rows = np.array(sorted(map(tuple, catalog._pairs(spark, small).select("pos", "label", "base", "tuned").collect())))
    n = len(rows)
    assert (rows[:, 0] == np.arange(n)).all()
    cell = (rows[:, 1] * 4 + rows[:, 2]) * 4 + rows[:, 3]
    drawn = [[int(hashlib.sha256(f"73\0{b}\0{j}".encode()).hexdigest()[:15], 16) % n for j in range(n)] for b in range(2000)]
    values = resample._values(np.stack([np.bincount(cell[d], minlength=64) for d in drawn]))
    found = {r["system"]: r for r in catalog.bootstrap_ci(spark, small).collect()}
    for system in ("base", "tuned", "delta"):
        low, high = resample.percentile_interval(values[system].to_numpy())
        assert found[system]["ci_lower"] == pytest.approx(low, abs=2e-8) and found[system]["ci_upper"] == pytest.approx(high, abs=2e-8)
    assert found["delta"]["no_improvement"] == (values["delta"] <= 0).sum()


def test_identical_systems(spark):
    df = pairs(spark, [0, 1, 2, 3] * 5, [0, 1, 2, 0] * 5, [0, 1, 2, 0] * 5)
    out = resample.exact_resamples(df, 200).toPandas()
    assert (out["delta"] == 0).all()
    row = {r["system"]: r for r in resample.summary(spark.createDataFrame(out)).collect()}["delta"]
    assert row["no_improvement"] == 200 and row["ci_lower"] == 0 == row["ci_upper"]
    with pytest.raises(ValueError):
        resample.summary(spark.createDataFrame(out), 1.5)
    with pytest.raises(ValueError):
        resample.cell_counts(df.limit(0))
    with pytest.raises(ValueError):
        resample.cell_counts(pairs(spark, [0], [7], [0]))
    with pytest.raises(ValueError):
        resample.hash_draws(spark, 0, 1)


def test_positions(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1009 as v")
    rows = sorted(resample.positions(df, "v").collect(), key=lambda r: r["v"])
    assert [r["j"] for r in rows] == list(range(1000))


def test_selection(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.91), (3, 0.91)], "epoch int, macro_f1 double")
    assert tuple(selection.select_checkpoint(rows).first()) == (2, 0.91)
    assert selection.select_checkpoint(rows.limit(0)).count() == 0
    with pytest.raises(Exception, match="twice"):
        selection.select_checkpoint(rows.unionAll(rows)).collect()
    records = [{"epoch": e, "validation": {"macro_f1": m}} for e, m in ((2, 0.5), (1, 0.5))]
    assert selection.chosen(records)["epoch"] == 1
    for bad in ([], records + records):
        with pytest.raises(ValueError):
            selection.chosen(bad)
    assert selection.require_agreement(0.73, 0.734)["agrees"]
    with pytest.raises(RuntimeError):
        selection.require_agreement(0.73, 0.74)
    values = spark.sql("select 0.5d expected, 0.504d actual union all select 0.5d, null")
    assert sorted((r["agrees"] for r in selection.baseline_agreement(values).collect())) == [False, True]


def test_steps_and_arguments():
    assert selection.optimizer_steps(8000, 2, 8, 2) == 1000
    assert [selection.warmup_steps(0.03, s) for s in (1000, 5, 50)] == [30, 1, 2]
    full = {"seed": 1, "logging_steps": 10}
    assert selection.training_arguments(full, {"seed", "warmup_steps"}, 0.03, 1000) == {"seed": 1, "warmup_steps": 30}
    assert selection.training_arguments(full, {"seed", "warmup_ratio", "logging_steps"}, 0.03, 1000)["warmup_ratio"] == 0.03
    for supported in ({"warmup_ratio"}, {"seed"}):
        with pytest.raises(RuntimeError):
            selection.training_arguments(full, supported, 0.03, 1000)
