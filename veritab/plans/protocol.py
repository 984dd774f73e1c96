"""The evaluation protocol: freeze on validation, test once, verify everything.

Reports are small JSON files under a root folder; scores lie beside them as
parquet.  Each verifier recomputes what a report says from its inputs and refuses
the first leaf that differs.  What may happen once is guarded by the atomic
creation of a file, not by looking first.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.config import ExperimentConfig
from veritab.errors import EvidenceError
from veritab.operators import calibration, digests, paired, resample
from veritab.operators.selection import chosen
from veritab.operators.trees import TOLERANCE, require_equal
from veritab.plans.blocks import attached, evaluation_block, label_digest, prediction_digest, predictions
from veritab.session import written
from veritab.sources.files import environment, local_manifest, sha256_file, verify_manifest
from veritab.sources.logits import load_logits, save_logits
from veritab.sources.reports import create_json, is_utc, read_json, utc_now, write_json

TRAINING, FROZEN, FINAL, INTERVALS, CLAIM = (f"outputs/{n}.json" for n in ("training-report", "frozen-selection", "final-test-report", "test-intervals-v2", "final-test-claim"))
ADAPTER = "adapters/selected"
#: The protocol of published intervals, and what confirms the test.
RESAMPLES, SEED, ALPHA = 2_000, 73, 0.05
CONFIRMATION = "i-am-running-the-single-final-test"
SCOPE = "how far the one stored test run would move with another sample of rows; other training runs may differ by more"
#: A card may be put beside an adapter without touching its digest.
MUTABLE = frozenset({"README.md"})
SYSTEMS = ("base", "tuned")
#: What ties a report to its run: the leaf of a training report, under the name others record it by.
PROVENANCE = {"model": ("model",), "model_revision": ("model_revision",), "config": ("config",), "selected_epoch": ("selection", "selected_epoch"), "selected_adapter_hashes": ("selection", "selected_adapter_hashes")}
#: How a prediction is read from the scores of the final test.
DECODING = "argmax over the scores of the four class codes; no answer outside the codes can occur, so the invalid rate is 0 by construction"
COUNTER = "test_evaluations_run"


def provenance(training: dict) -> dict:
    """The fields that bind the frozen selection and the final report to a training report."""
    out = {}
    for name, path in PROVENANCE.items():
        node = training
        for key in path:
            node = node[key]
        out[name] = node
    return out


def frozen_digest(frozen: dict) -> str:
    """The digest of a frozen selection without the counter that the test raises."""
    return digests.json_sha256({k: v for k, v in frozen.items() if k != COUNTER})


def _same(report: dict, expected: dict, what: str) -> None:
    for name, value in expected.items():
        if report.get(name) != value or type(report.get(name)) is not type(value):
            raise EvidenceError(f"{what}: {name} is {report.get(name)!r} instead of {value!r}")


def validation_baseline(logits: DataFrame, labels: DataFrame, config: ExperimentConfig) -> dict:
    """The untuned system on validation: before and after a fitted temperature."""
    rows = written(attached(logits, labels), "baseline")
    fitted = calibration.fit_temperature(rows)
    return {
        "schema_version": 1, "created_at_utc": utc_now(), "model": config.model_name, "model_revision": config.model_revision, "split": "validation",
        "test_evaluated": False, "metrics_before_temperature": evaluation_block(rows), "validation_temperature": fitted, "metrics_after_temperature": evaluation_block(rows, fitted),
    }


def training_report(config: ExperimentConfig, root: str | Path, labels: DataFrame, base: DataFrame, epochs: dict[int, DataFrame], train_rows: int, extra: dict | None = None) -> dict:
    """The report of a training run from its scores; the training itself happens elsewhere."""
    if (Path(root) / TRAINING).exists():
        raise EvidenceError("a training report exists already")
    rows = attached(base, labels)
    records = [
        {"epoch": e, "validation": evaluation_block(attached(z, labels)), "validation_logits": save_logits(z, root, f"outputs/logits/tuned-validation-epoch-{e}.parquet")}
        for e, z in sorted(epochs.items())
    ]
    best = chosen(records)
    report = {
        "schema_version": 1, "created_at_utc": utc_now(), "model": config.model_name, "model_revision": config.model_revision, "config": config.to_dict(), "test_evaluated": False,
        "train_rows": train_rows, "validation_rows": labels.count(), "validation_label_sha256": label_digest(labels), "base_validation_metrics": evaluation_block(rows),
        "base_validation_logits": save_logits(base, root, "outputs/logits/base-validation.parquet"), "epochs": records,
        "selection": {"rule": "highest validation macro_f1, of equal ones the earliest epoch", "selected_epoch": best["epoch"], "selected_adapter_dir": ADAPTER, "selected_adapter_hashes": local_manifest(Path(root) / ADAPTER)},
        **(extra or {}),
    }
    create_json(report, Path(root) / TRAINING)
    return report


def _recomputed(spark: SparkSession, stored: dict, logits: dict, labels: DataFrame, root: str | Path, name: str) -> DataFrame:
    rows = attached(load_logits(spark, logits, root), labels)
    require_equal(stored, evaluation_block(rows, stored.get("temperature", 1.0)), name, absolute=TOLERANCE)
    return rows


def verify_training(spark: SparkSession, root: str | Path, labels: DataFrame, adapters: bool = True, report: dict | None = None) -> dict:
    """Recompute all blocks of the training report and reapply the selection rule; the selected record."""
    report = report or read_json(Path(root) / TRAINING)
    _same(report, {"schema_version": 1, "test_evaluated": False, "validation_label_sha256": label_digest(labels), "validation_rows": labels.count()}, "training report")
    if len(report["epochs"]) != report["config"]["training"]["epochs"]:
        raise EvidenceError("training report: the number of epochs is not the configured one")
    _recomputed(spark, report["base_validation_metrics"], report["base_validation_logits"], labels, root, "base_validation_metrics")
    for k, record in enumerate(report["epochs"]):
        _recomputed(spark, record["validation"], record["validation_logits"], labels, root, f"epochs[{k}].validation")
    best = chosen(report["epochs"])
    if report["selection"]["selected_epoch"] != best["epoch"]:
        raise EvidenceError("training report: selected_epoch doesn't follow the rule")
    if adapters:
        verify_manifest(Path(root) / ADAPTER, report["selection"]["selected_adapter_hashes"], MUTABLE)
    return best


def _argmax_kept(rows: DataFrame, temperature: float) -> None:
    from veritab.operators.metrics import scored

    moved = predictions(rows).join(scored(rows, temperature).select("pos", F.col("pred").alias("after")), "pos").where("pred <> after")
    if not moved.isEmpty():
        raise EvidenceError("a temperature changed a prediction")


def freeze_selection(spark: SparkSession, root: str | Path, labels: DataFrame) -> dict:
    """Fix the adapter and both temperatures on validation, once and before any test."""
    root = Path(root)
    if (root / FROZEN).exists() or (root / FINAL).exists():
        raise EvidenceError("the selection is frozen already or the test was used")
    report = read_json(root / TRAINING)
    best = verify_training(spark, root, labels, report=report)
    validation = {}
    for name, logits in (("base", report["base_validation_logits"]), ("tuned", best["validation_logits"])):
        rows = written(attached(load_logits(spark, logits, root), labels), "frozen")
        fitted = calibration.fit_temperature(rows)
        _argmax_kept(rows, fitted)
        validation[name] = {"logits": logits, "temperature": fitted, "before": evaluation_block(rows), "after": evaluation_block(rows, fitted)}
    frozen = {
        "schema_version": 1, "created_at_utc": utc_now(), **provenance(report), "training_report_sha256": sha256_file(root / TRAINING),
        "validation_label_sha256": report["validation_label_sha256"], "validation": validation, COUNTER: 0,
    }
    create_json(frozen, root / FROZEN)
    return frozen


def verify_frozen(spark: SparkSession, root: str | Path, labels: DataFrame) -> dict:
    """Refit the temperatures and recompute the blocks of a frozen selection."""
    root = Path(root)
    frozen, report = read_json(root / FROZEN), read_json(root / TRAINING)
    best = verify_training(spark, root, labels, adapters=False, report=report)
    _same(frozen, provenance(report) | {"training_report_sha256": sha256_file(root / TRAINING), "validation_label_sha256": label_digest(labels)}, "frozen selection")
    if set(frozen["validation"]) != set(SYSTEMS):
        raise EvidenceError("frozen selection: validation must have both systems")
    for name, logits in (("base", report["base_validation_logits"]), ("tuned", best["validation_logits"])):
        block = frozen["validation"][name]
        require_equal(block["logits"], logits, f"validation.{name}.logits")
        rows = attached(load_logits(spark, logits, root), labels)
        require_equal(block["temperature"], calibration.fit_temperature(rows), f"validation.{name}.temperature", absolute=TOLERANCE)
        require_equal(block["before"], evaluation_block(rows), f"validation.{name}.before", absolute=TOLERANCE)
        require_equal(block["after"], evaluation_block(rows, block["temperature"]), f"validation.{name}.after", absolute=TOLERANCE)
    return frozen


def require_frozen(root: str | Path) -> dict:
    """The frozen selection, its adapter unchanged and the test not used yet."""
    root = Path(root)
    frozen = read_json(root / FROZEN)
    if frozen.get(COUNTER) != 0:
        raise EvidenceError("the test was used already")
    verify_manifest(root / ADAPTER, frozen["selected_adapter_hashes"], MUTABLE)
    return frozen


def system_block(rows: DataFrame, logits: dict, temperature: float, seconds: float | None = None) -> dict:
    """One system on the test split, before and after its frozen temperature."""
    _argmax_kept(rows, temperature)
    before, after = evaluation_block(rows), evaluation_block(rows, temperature)
    if before["macro_f1"] != after["macro_f1"]:
        raise EvidenceError("a temperature changed the macro-F1")
    n = before["rows"]
    return {"logits": logits, "temperature": temperature, "metrics_before_temperature": before, "metrics_after_temperature": after, "prediction_sha256": prediction_digest(rows), "seconds": seconds, "seconds_per_row": None if seconds is None else seconds / n}


def delta_of(systems: dict) -> dict:
    def gap(get: Callable[[dict], float]) -> float:
        return get(systems["tuned"]) - get(systems["base"])

    return {
        "macro_f1": gap(lambda s: s["metrics_before_temperature"]["macro_f1"]), "accuracy": gap(lambda s: s["metrics_before_temperature"]["accuracy"]),
        "ece_after_temperature": gap(lambda s: s["metrics_after_temperature"]["calibration"]["ece"]),
    }


def run_final_test(
    spark: SparkSession, root: str | Path, config: ExperimentConfig, confirmation: str, test: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], names: dict[str, str] | None = None
) -> dict:
    """The one evaluation on the test split.

    ``test`` has pos, row_id and label; each scorer turns it into (pos, z) and is
    run once; ``names`` says what the scorers are.  The claim file is created
    before anything is scored, so two runs can't both pass; a failure after that
    is recorded with its stage and raised, and the claim stays.
    """
    root = Path(root)
    if type(config.test_evaluations_allowed) is not int or config.test_evaluations_allowed != 1:
        raise EvidenceError("the configuration allows no test evaluation")
    if confirmation != CONFIRMATION:
        raise EvidenceError("the final test needs its exact confirmation")
    if (root / FINAL).exists():
        raise EvidenceError("the final report exists already")
    frozen = require_frozen(root)
    require_equal(config.to_dict(), config.to_dict() | {k: v for k, v in frozen["config"].items()}, "config")
    rows = test.count()
    if rows != config.data.publisher_test_rows:
        raise EvidenceError(f"the test split has {rows} rows instead of {config.data.publisher_test_rows}")
    create_json({"created_at_utc": utc_now(), "confirmation": confirmation}, root / CLAIM)
    stage = "start"
    try:
        systems = {}
        for name in SYSTEMS:
            stage, began = f"scoring {name}", time.perf_counter()
            logits = save_logits(scorers[name](test), root, f"outputs/logits/{name}-test.parquet")
            seconds = time.perf_counter() - began
            stage = f"metrics of {name}"
            systems[name] = system_block(attached(load_logits(spark, logits, root), test), logits, frozen["validation"][name]["temperature"], seconds)
        stage = "report"
        report = {
            "schema_version": 1, "created_at_utc": utc_now(), "test_evaluated": True, COUNTER: 1, "split": "publisher test", "rows": rows,
            **{k: frozen[k] for k in PROVENANCE}, "environment": environment(), "decoding": DECODING, "scorers": names or {},
            "frozen_selection_sha256": frozen_digest(frozen), "test_row_ids_sha256": digests.streamed(test, "row_id", "pos"), "test_label_sha256": label_digest(test),
            "systems": systems, "delta": delta_of(systems),
        }
        create_json(report, root / FINAL)
    except Exception as error:
        failed = {"created_at_utc": utc_now(), "stage": stage, "error": f"{type(error).__name__}: {error}", "selected_epoch": frozen["selected_epoch"], "note": "scores of this attempt may lie under outputs/logits"}
        create_json(failed, root / f"outputs/failed-attempts/final-test-{time.time_ns()}.json")
        raise
    write_json(frozen | {COUNTER: 1}, root / FROZEN)
    return report


def verify_final(spark: SparkSession, root: str | Path, test: DataFrame, validation: DataFrame) -> dict:
    """Recompute the final report from its scores, the test split, and temperatures refitted on validation."""
    root = Path(root)
    report, frozen = read_json(root / FINAL), verify_frozen(spark, root, validation)
    if frozen.get(COUNTER) != 1 or type(frozen.get(COUNTER)) is not int:
        raise EvidenceError("the frozen selection doesn't record one test")
    expected = {k: frozen[k] for k in PROVENANCE} | {"frozen_selection_sha256": frozen_digest(frozen), "decoding": DECODING}
    expected |= {"test_evaluated": True, COUNTER: 1, "rows": test.count(), "test_row_ids_sha256": digests.streamed(test, "row_id", "pos"), "test_label_sha256": label_digest(test)}
    _same(report, expected, "final report")
    if set(report["systems"]) != set(SYSTEMS):
        raise EvidenceError("final report: systems must be base and tuned")
    for name, stored in report["systems"].items():
        require_equal(stored["temperature"], frozen["validation"][name]["temperature"], f"systems.{name}.temperature", absolute=TOLERANCE)
        again = system_block(attached(load_logits(spark, stored["logits"], root), test), stored["logits"], stored["temperature"], stored["seconds"])
        require_equal(stored, again, f"systems.{name}", absolute=TOLERANCE)
    require_equal(report["delta"], delta_of(report["systems"]), "delta", absolute=TOLERANCE)
    return {"verified": True, "delta": report["delta"]["macro_f1"]}


def mcnemar_record(fixed: int, broken: int, spark: SparkSession) -> dict:
    if any(type(x) is not int or x < 0 for x in (fixed, broken)):
        raise ValueError("counts must be integers of at least 0")
    row = paired.mcnemar(spark.createDataFrame([(fixed, broken)], "fixed bigint, broken bigint")).first()
    out = {"discordant_pairs": row["discordant"], "chi_square": row["chi_square"], "log10_p_value": row["log10_p"], "p_value": row["p"], "p_value_scientific": row["p_text"]}
    return out if fixed + broken else out | {"note": "no row was right for one system only"}


def interval_blocks(spark: SparkSession, rows: dict[str, DataFrame], resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA, mode: str = "exact") -> dict:
    """Bootstrap and paired comparison of (pos, label, z) of both systems.

    ``exact`` draws by the sequential generator and may claim parity with published
    numbers; ``cells`` is for test sets of any size.  The mode is recorded.
    """
    both = None
    for name in SYSTEMS:
        one = predictions(rows[name]).select(F.lit(name).alias("system"), "pos", "label", "pred")
        both = one if both is None else both.unionByName(one)
    if not paired.unpaired(both).isEmpty():
        raise EvidenceError("a row was scored by one system only")
    pairs = paired.pair_systems(both)
    drawn = resample.exact_resamples(pairs, resamples, seed).toPandas() if mode == "exact" else resample.cell_resamples(resample.cell_counts(pairs), resamples, seed)
    point = resample.macro_f1(resample.cell_counts(pairs).reshape(4, 4, 4).sum(2)), resample.macro_f1(resample.cell_counts(pairs).reshape(4, 4, 4).sum(1))
    points = {"base": float(point[0]), "tuned": float(point[1]), "delta": float(point[1] - point[0])}
    out: dict[str, Any] = {}
    for name, value in points.items():
        low, high = resample.percentile_interval(drawn[name].to_numpy(), alpha)
        out[name] = {"delta" if name == "delta" else "macro_f1": value, "ci_lower": low, "ci_upper": high, "ci_width": high - low}
    out["resamples_without_improvement"] = int((drawn["delta"] <= 0).sum())
    out["settings"] = {"resamples": resamples, "seed": seed, "alpha": alpha, "method": "percentiles of paired resamples of the test rows", "draws": mode}
    c = paired.paired_counts(pairs).first()
    counts = {"rows": c["rows"], "disagreements": c["disagreements"], "tuned_fixed_base_error": c["fixed"], "tuned_broke_base_success": c["broken"], "both_correct": c["both_right"], "both_wrong": c["both_wrong"]}
    return {"bootstrap": out, "paired": counts | {"mcnemar": mcnemar_record(c["fixed"], c["broken"], spark)}}


def _test_rows(spark: SparkSession, root: Path, labels: DataFrame, report: dict) -> dict[str, DataFrame]:
    if report.get("test_evaluated") is not True or report.get("test_evaluations_run") != 1:
        raise EvidenceError("intervals need the single final test")
    if label_digest(labels) != report["test_label_sha256"]:
        raise EvidenceError("the test labels are not those of the final report")
    out = {}
    for name in SYSTEMS:
        stored = report["systems"][name]
        out[name] = attached(load_logits(spark, stored["logits"], root), labels)
        if prediction_digest(out[name]) != stored["prediction_sha256"]:
            raise EvidenceError(f"the predictions of {name} are not those of the final report")
    return out


def _intervals(spark: SparkSession, root: Path, labels: DataFrame) -> dict:
    report = read_json(root / FINAL)
    blocks = interval_blocks(spark, _test_rows(spark, root, labels, report))
    return {"schema_version": 2, "source_report": FINAL, "source_report_sha256": sha256_file(root / FINAL), "test_label_sha256": report["test_label_sha256"], "new_test_evaluations": 0, "scope": SCOPE, **blocks}


def build_intervals(spark: SparkSession, root: str | Path, labels: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> dict:
    if (resamples, seed) != (RESAMPLES, SEED):
        raise EvidenceError(f"published intervals use {RESAMPLES} resamples and seed {SEED}")
    out = _intervals(spark, Path(root), labels) | {"created_at_utc": utc_now()}
    write_json(out, Path(root) / INTERVALS)
    return out


def verify_intervals(spark: SparkSession, root: str | Path, labels: DataFrame) -> dict:
    stored = read_json(Path(root) / INTERVALS)
    if not is_utc(stored.get("created_at_utc")):
        raise EvidenceError("created_at_utc is no UTC timestamp")
    require_equal({k: v for k, v in stored.items() if k != "created_at_utc"}, _intervals(spark, Path(root), labels), "intervals", relative=TOLERANCE)
    delta = stored["bootstrap"]["delta"]
    return {"verified": True, "delta": delta["delta"], "ci": [delta["ci_lower"], delta["ci_upper"]]}


def verify_all(spark: SparkSession, root: str | Path, validation: DataFrame, test: Callable[[], DataFrame], adapters: bool = True) -> dict:
    """Verify whatever reports exist; the test split is asked for only if one needs it."""
    root = Path(root)
    present = {p: (root / p).exists() for p in (TRAINING, FROZEN, FINAL, INTERVALS)}
    if not any(present.values()):
        raise EvidenceError("there is nothing to verify")
    out: dict[str, Any] = {}
    if present[TRAINING]:
        out["training_report"] = {"verified": True, "selected_epoch": verify_training(spark, root, validation, adapters)["epoch"], "adapter_files_verified": adapters}
    if present[FROZEN] and not present[FINAL]:  # else the final report's check includes it
        out["frozen_selection"] = {"verified": True, "selected_epoch": verify_frozen(spark, root, validation)["selected_epoch"]}
    if present[FINAL] or present[INTERVALS]:
        held = test()
        if present[FINAL]:
            out["final_test_report"] = verify_final(spark, root, held, validation)
        if present[INTERVALS]:
            out["test_intervals"] = verify_intervals(spark, root, held)
    return out
