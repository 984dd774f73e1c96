import copy
import json
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritab import cli
from veritab.config import DataConfig, ExperimentConfig, TrainingConfig, from_dict, load_config
from veritab.errors import EvidenceError
from veritab.operators import compare, manifest, trees
from veritab.plans import audit, card, protocol
from veritab.sources import files, reports

VALIDATION, TEST = 80, 60


def frame(spark, z):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(z)], "pos bigint, z array<float>")


def labels_of(spark, y, name):
    return spark.createDataFrame([(i, f"{name}{i:04d}", int(v)) for i, v in enumerate(y)], "pos bigint, row_id string, label int")


def logits(rng, y, lift):
    z = rng.normal(0, 1.2, (len(y), 4)).astype(np.float32)
    z[np.arange(len(y)), y] += np.float32(lift)
    return z


@pytest.fixture(scope="module")
def evidence(spark, tmp_path_factory):
    """A consistent folder of reports, built by the protocol itself."""
    root = tmp_path_factory.mktemp("evidence")
    (root / "adapters/selected").mkdir(parents=True)
    (root / "adapters/selected/weights.bin").write_bytes(b"weights")
    rng = np.random.default_rng(5)
    yv, yt = rng.integers(0, 4, VALIDATION), rng.integers(0, 4, TEST)
    validation, test = labels_of(spark, yv, "v"), labels_of(spark, yt, "t")
    config = ExperimentConfig(data=DataConfig(publisher_test_rows=TEST), training=TrainingConfig(epochs=2))
    extra = {"parameters": {"trainable_parameters": 200, "total_parameters": 10_200, "trainable_percent": 100 * 200 / 10_200}}
    protocol.training_report(config, root, validation, frame(spark, logits(rng, yv, 1.0)), {1: frame(spark, logits(rng, yv, 1.6)), 2: frame(spark, logits(rng, yv, 2.2))}, 40, extra)
    protocol.freeze_selection(spark, root, validation)
    before_test = card.build_card(root, spark=spark)
    z = {"base": logits(rng, yt, 1.0), "tuned": logits(rng, yt, 2.2)}
    scored = {s: spark.sparkContext.accumulator(0) for s in z}

    def scorer(s):
        def run(frames):
            for f in frames:
                scored[s].add(len(f))
                yield pd.DataFrame({"pos": f["pos"], "z": [z[s][i] for i in f["pos"]]})

        return lambda rows: rows.select("pos").mapInPandas(run, "pos bigint, z array<float>")

    scorers = {s: scorer(s) for s in z}
    with pytest.raises(EvidenceError, match="confirmation"):
        protocol.run_final_test(spark, root, config, "yes", test, scorers)
    protocol.run_final_test(spark, root, config, protocol.CONFIRMATION, test, scorers, {"base": "a test"})
    assert {s: a.value for s, a in scored.items()} == {"base": TEST, "tuned": TEST}, "a row was scored more than once"
    protocol.build_intervals(spark, root, test)
    return {"root": root, "validation": validation, "test": test, "config": config, "scorers": scorers, "card": before_test}


def verify(spark, e, **kwargs):
    return protocol.verify_all(spark, e["root"], e["validation"], lambda: e["test"], **kwargs)


def test_everything_verifies(spark, evidence):
    out = verify(spark, evidence)
    assert out["training_report"]["verified"] and out["final_test_report"]["verified"] and out["test_intervals"]["verified"]
    assert protocol.verify_frozen(spark, evidence["root"], evidence["validation"])["test_evaluations_run"] == 1
    final = reports.read_json(evidence["root"] / protocol.FINAL)
    assert final["scorers"] == {"base": "a test"} and final["split"] == "publisher test" and "packages" in final["environment"]
    assert all(s["seconds"] > 0 and s["seconds_per_row"] == pytest.approx(s["seconds"] / TEST) for s in final["systems"].values())
    text = card.build_card(evidence["root"], "somewhere", spark)
    assert "test (60 rows)" in text and "200 (1.9608% of 10,200)" in text and "Quantisation: 4 bits, nf4" in text and "How the class is read" in text
    assert "No test result" in evidence["card"]
    assert card.write_card(evidence["root"], spark=spark).exists()


def test_what_may_happen_once(spark, evidence):
    with pytest.raises(EvidenceError):
        protocol.freeze_selection(spark, evidence["root"], evidence["validation"])
    with pytest.raises(EvidenceError, match="exists"):
        protocol.run_final_test(spark, evidence["root"], evidence["config"], protocol.CONFIRMATION, evidence["test"], evidence["scorers"])
    with pytest.raises(EvidenceError, match="used already"):
        protocol.require_frozen(evidence["root"])
    with pytest.raises(EvidenceError):
        protocol.build_intervals(spark, evidence["root"], evidence["test"], resamples=10)
    with pytest.raises(EvidenceError):
        reports.create_json({}, evidence["root"] / protocol.FINAL)


def edited(path, keys, value):
    tree = json.loads(path.read_text())
    node = tree
    for k in keys[:-1]:
        node = node[k]
    node[keys[-1]] = value(node[keys[-1]]) if callable(value) else value
    path.write_text(json.dumps(tree, indent=2) + "\n")


EDITS = [
    (protocol.TRAINING, ("base_validation_metrics", "macro_f1"), lambda v: v + 1e-6),
    (protocol.TRAINING, ("epochs", 0, "validation", "per_class", "World", "recall"), 0.5),
    (protocol.TRAINING, ("epochs", 1, "validation", "calibration", "bins", 14, "gap"), 0.25),
    (protocol.TRAINING, ("selection", "selected_epoch"), 1),
    (protocol.TRAINING, ("validation_label_sha256",), "0" * 64),
    (protocol.TRAINING, ("epochs", 0, "validation_logits", "sha256"), "0" * 64),
    (protocol.TRAINING, ("config", "training", "epochs"), 3),
    (protocol.FINAL, ("model",), "another"),
    (protocol.FINAL, ("selected_epoch",), 7),
    (protocol.FINAL, ("rows",), float(TEST)),
    (protocol.FINAL, ("systems", "tuned", "temperature"), lambda v: v + 1e-3),
    (protocol.FINAL, ("systems", "base", "metrics_after_temperature", "nll"), lambda v: v * 1.001),
    (protocol.FINAL, ("systems", "base", "prediction_sha256"), "0" * 64),
    (protocol.FINAL, ("delta", "macro_f1"), lambda v: v + 1e-6),
    (protocol.FINAL, ("frozen_selection_sha256",), "0" * 64),
    (protocol.FINAL, ("decoding",), "free text"),
    (protocol.FINAL, ("test_row_ids_sha256",), "0" * 64),
    (protocol.INTERVALS, ("bootstrap", "settings", "resamples"), 2000.0),
    (protocol.INTERVALS, ("scope",), "training variance too"),
    (protocol.INTERVALS, ("created_at_utc",), "yesterday"),
    (protocol.INTERVALS, ("paired", "both_wrong"), lambda v: v + 1),
]


@pytest.mark.parametrize("report, keys, value", EDITS, ids=[".".join(map(str, k)) for _, k, _ in EDITS])
def test_an_edited_leaf_is_refused(spark, evidence, report, keys, value):
    path = evidence["root"] / report
    original = path.read_text()
    check = {protocol.TRAINING: lambda: protocol.verify_training(spark, evidence["root"], evidence["validation"]), protocol.FINAL: lambda: protocol.verify_final(spark, evidence["root"], evidence["test"], evidence["validation"]), protocol.INTERVALS: lambda: protocol.verify_intervals(spark, evidence["root"], evidence["test"])}[report]
    try:
        edited(path, keys, value)
        with pytest.raises(EvidenceError):
            check()
    finally:
        path.write_text(original)


def test_reordered_rows_and_other_adapters_are_refused(spark, evidence):
    turned = evidence["test"].withColumn("pos", TEST - 1 - F.col("pos"))
    with pytest.raises(EvidenceError, match="test_row_ids|test_label"):
        protocol.verify_final(spark, evidence["root"], turned, evidence["validation"])
    weights = evidence["root"] / "adapters/selected/weights.bin"
    weights.write_bytes(b"changed")
    try:
        with pytest.raises(EvidenceError, match="weights.bin"):
            protocol.verify_training(spark, evidence["root"], evidence["validation"])
        assert protocol.verify_training(spark, evidence["root"], evidence["validation"], adapters=False)["epoch"] == 2
    finally:
        weights.write_bytes(b"weights")
    (evidence["root"] / "adapters/selected/README.md").write_text("a card")
    assert protocol.verify_training(spark, evidence["root"], evidence["validation"])["epoch"] == 2


def test_a_frozen_temperature_is_refitted(spark, evidence):
    path = evidence["root"] / protocol.FROZEN
    original = path.read_text()
    try:
        edited(path, ("validation", "base", "temperature"), lambda v: v + 1e-6)
        with pytest.raises(EvidenceError, match="temperature"):
            protocol.verify_frozen(spark, evidence["root"], evidence["validation"])
    finally:
        path.write_text(original)


def test_a_temperature_tampered_in_both_files_is_refused(spark, evidence):
    frozen_path, final_path = (evidence["root"] / p for p in (protocol.FROZEN, protocol.FINAL))
    originals = frozen_path.read_text(), final_path.read_text()
    moved = json.loads(originals[0])["validation"]["tuned"]["temperature"] * 1.1
    rows = protocol.attached(protocol.load_logits(spark, json.loads(originals[1])["systems"]["tuned"]["logits"], evidence["root"]), evidence["test"])
    validation = protocol.attached(protocol.load_logits(spark, json.loads(originals[0])["validation"]["tuned"]["logits"], evidence["root"]), evidence["validation"])
    try:
        edited(frozen_path, ("validation", "tuned", "temperature"), moved)
        edited(frozen_path, ("validation", "tuned", "after"), protocol.evaluation_block(validation, moved))
        edited(final_path, ("systems", "tuned", "temperature"), moved)
        edited(final_path, ("systems", "tuned", "metrics_after_temperature"), protocol.evaluation_block(rows, moved))
        tree = json.loads(final_path.read_text())
        edited(final_path, ("delta",), protocol.delta_of(tree["systems"]))
        edited(final_path, ("frozen_selection_sha256",), protocol.frozen_digest(json.loads(frozen_path.read_text())))
        with pytest.raises(EvidenceError, match="temperature"):
            verify(spark, evidence)
    finally:
        frozen_path.write_text(originals[0])
        final_path.write_text(originals[1])


def test_a_failed_attempt_is_kept(spark, evidence, tmp_path):
    for name in (protocol.TRAINING, protocol.FROZEN):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text((evidence["root"] / name).read_text())
    shutil.copytree(evidence["root"] / "adapters", tmp_path / "adapters")
    edited(tmp_path / protocol.FROZEN, ("test_evaluations_run",), 0)

    def broken(rows):
        raise RuntimeError("no device")

    with pytest.raises(RuntimeError):
        protocol.run_final_test(spark, tmp_path, evidence["config"], protocol.CONFIRMATION, evidence["test"], {"base": evidence["scorers"]["base"], "tuned": broken})
    (kept,) = (tmp_path / "outputs/failed-attempts").iterdir()
    kept = json.loads(kept.read_text())
    assert kept["stage"] == "scoring tuned" and kept["selected_epoch"] == 2 and "no device" in kept["error"]
    with pytest.raises(EvidenceError):
        protocol.run_final_test(spark, tmp_path, evidence["config"], protocol.CONFIRMATION, evidence["test"], evidence["scorers"])


def test_a_validation_baseline(spark, evidence):
    z = frame(spark, logits(np.random.default_rng(1), [r["label"] for r in evidence["validation"].orderBy("pos").collect()], 1.5))
    out = protocol.validation_baseline(z, evidence["validation"], evidence["config"])
    assert out["split"] == "validation" and not out["test_evaluated"]
    before, after = (out[f"metrics_{k}_temperature"] for k in ("before", "after"))
    assert before["macro_f1"] == after["macro_f1"] and after["nll"] <= before["nll"] and after["temperature"] == out["validation_temperature"]


def test_card_refuses_another_run(spark, evidence):
    path = evidence["root"] / protocol.FINAL
    original = path.read_text()
    try:
        edited(path, ("selected_epoch",), 1)
        with pytest.raises(EvidenceError, match="another run"):
            card.build_card(evidence["root"], spark=spark)
    finally:
        path.write_text(original)
    for block in (None, {"trainable_parameters": 200}, {"trainable_parameters": 200, "total_parameters": 10_200, "trainable_percent": 3.0}):
        with pytest.raises(EvidenceError):
            card.parameters_line(spark, {"parameters": block})


def test_worse_systems_still_verify(spark, evidence):
    rows = {s: evidence["test"].join(evidence["scorers"][o](evidence["test"]), "pos") for s, o in (("base", "tuned"), ("tuned", "base"))}
    out = protocol.interval_blocks(spark, rows, resamples=50, mode="cells")
    assert out["bootstrap"]["delta"]["delta"] < 0 and out["bootstrap"]["settings"]["draws"] == "cells"
    none = protocol.mcnemar_record(0, 0, spark)
    assert none["chi_square"] is None and "note" in none
    for bad in ((-1, 3), (1.5, 3), (True, 3)):
        with pytest.raises(ValueError):
            protocol.mcnemar_record(*bad, spark)


def test_configs(tmp_path):
    config = ExperimentConfig()
    assert "validation_start_per_class" not in config.to_dict()["data"]
    config.write(tmp_path / "c.json")
    assert load_config(tmp_path / "c.json") == config
    good = config.to_dict()
    for keys, value in ((("lora", "rank"), 0), (("lora", "dropout"), 1.0), (("test_evaluations_allowed",), True), (("test_evaluations_allowed",), 2), (("schema_version",), 2), (("data", "train_per_class"), 0), (("extra",), 1), (("data", "extra"), 1), (("resume_eligible",), True)):
        bad = copy.deepcopy(good)
        node = bad
        for k in keys[:-1]:
            node = node[k]
        node[keys[-1]] = value
        with pytest.raises(ValueError):
            from_dict(bad)


def report(rank=16, packages=None, epoch=2, **other):
    return {
        "environment": {"packages": packages or {"transformers": "4", "torch": "2"}, "gpu_name": "T4"}, "config": {"lora": {"rank": rank, "alpha": 2 * rank}}, "validation_label_sha256": "a" * 64,
        "epochs": [{"epoch": 1, "validation": {"macro_f1": 0.9}}, {"epoch": 2, "validation": {"macro_f1": 0.91}}], "selection": {"selected_epoch": epoch}, **other,
    }


def test_compare_runs():
    changes = {"lora.rank", "lora.alpha"}
    good = compare.compare_runs(report(), report(4), changes)
    assert good["controlled"] and set(good["config_differences"]) == changes and good["validation_macro_f1"]["delta"] == 0
    compare.require_controlled(good)
    torch = compare.compare_runs(report(), report(4, {"transformers": "4", "torch": "3"}), changes)
    assert torch["controlled"] and set(torch["package_differences"]) == {"torch"}
    for other, expected in ((report(4, {"transformers": "5", "torch": "2"}), changes), (report(4), {"lora.rank"}), (report(), changes), (report(4, validation_label_sha256="b"), changes), (report(4, environment={"packages": {"transformers": "4", "torch": "2"}}), changes)):
        out = compare.compare_runs(report(), other, expected)
        assert not out["controlled"]
        with pytest.raises(EvidenceError):
            compare.require_controlled(out)
    tie = [{"epoch": e, "validation": {"macro_f1": 0.9}} for e in (1, 2)]
    for bad in (report(epoch=7), report(epoch=1), report(epochs=tie), report(epochs=None), report(epochs=[{"epoch": 2, "validation": {}}])):
        with pytest.raises(EvidenceError):
            compare.compare_runs(report(), bad)


def test_trees(spark):
    assert trees.flatten({"a": {"b": 1, "c": {}}, "d": [1]}) == {"a.b": 1, "d": [1]}
    assert compare.differences({"f": compare.ABSENT}, {}) == {"f": (compare.ABSENT, compare.ABSENT)}
    assert trees.mismatch({"a": [1.0, 2]}, {"a": [1.0 + 1e-12, 2]}, absolute=1e-9) is None
    assert trees.mismatch({"a": [1.0, True]}, {"a": [1.0, 1]}) == "a[1]"
    assert trees.mismatch({"a": float("nan")}, {"a": 1.0}, absolute=1) == "a"
    assert trees.mismatch({"a": 1}, {"a": 1, "b": 2}) == "."
    table = trees.leaf_table(spark, {"l": {"x": 1.0, "n": None, "same": "s", "i": 1}, "r": {"x": 1.0 + 1e-12, "same": "s", "i": 1.0, "new": []}})
    left, right = (table.where(F.col("tree") == s).drop("tree") for s in "lr")
    found = {r["path"]: r["reason"] for r in trees.tree_diff(left, right, absolute=1e-9).collect()}
    assert found == {"n": "missing", "new": "unexpected", "i": "different"}
    assert "x" in {r["path"] for r in trees.tree_diff(left, right).collect()}
    docs = spark.createDataFrame([(1, '{"a": {"b": 1, "c": {}}, "d": [1], "e": null, "f": 1.5, "g": "t", "h": true}'), (2, None), (3, "{bad"), (4, "{}")], "k int, j string")
    deep = "".join('{"x": ' for _ in range(11)) + "7" + "}" * 11
    wide = spark.range(1_200_000).select("id", F.concat(F.lit('{"a": {"b": '), F.col("id").cast("string"), F.lit("}}")).alias("j")).unionByName(spark.createDataFrame([(-1, deep), (-2, "[1]"), (-3, "null")], "id bigint, j string"))
    found = trees.flatten_json(wide, "id", "j").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("bigint")).alias("s")).collect()
    assert {tuple(r) for r in found} == {("a.b", 1_200_000, 1_200_000 * 1_199_999 // 2), (".".join("x" * 11), 1, 7)}
    rows = sorted((r["path"], r["kind"], r["value"]) for r in trees.flatten_json(docs, "k", "j").collect())
    assert rows == [("a.b", "int", "1"), ("d", "list", "[1]"), ("e", "null", None), ("f", "float", "1.5"), ("g", "text", '"t"'), ("h", "bool", "true")]


def test_manifests(spark, tmp_path):
    for name, data in (("b/x", b"1"), ("b-c", b"22"), ("a", b"")):
        (tmp_path / "m" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / name).write_bytes(data)
    recorded = files.local_manifest(tmp_path / "m")
    assert list(recorded["files"]) == ["a", "b/x", "b-c"] and recorded["total_bytes"] == 3
    scanned = files.scan(spark, str(tmp_path / "m"))
    assert {r["path"]: r["sha256"] for r in scanned.collect()} == recorded["files"]
    assert tuple(manifest.combined(scanned).first()) == (3, recorded["combined_sha256"], 3)
    files.verify_manifest(tmp_path / "m", recorded)
    then = spark.createDataFrame(scanned.collect(), scanned.schema)
    (tmp_path / "m" / "a").write_bytes(b"new")
    (tmp_path / "m" / "b-c").unlink()
    (tmp_path / "m" / "README.md").write_text("card")
    with pytest.raises(EvidenceError):
        files.verify_manifest(tmp_path / "m", recorded)
    now = files.scan(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in manifest.manifest_diff(then, now, ("README.md",)).collect()} == {("a", "changed"), ("b-c", "missing")}
    with pytest.raises(EvidenceError):
        manifest.require_unchanged(then, now)
    with pytest.raises(EvidenceError):
        files.verify_manifest(tmp_path / "m", {"files": []})
    with pytest.raises(EvidenceError):
        files.local_manifest(tmp_path / "absent")


def test_paths_and_reports(spark, tmp_path):
    assert files.guarded("a/b.parquet", tmp_path, ".parquet") == (tmp_path / "a/b.parquet").resolve()
    for bad in ("", None, 3, "/etc/x.parquet", "../x.parquet", "a/../../x.parquet", "x.npy"):
        with pytest.raises(EvidenceError):
            files.guarded(bad, tmp_path, ".parquet")
    reports.write_json({"a": 1}, tmp_path / "r.json")
    assert (tmp_path / "r.json").read_text() == '{\n  "a": 1\n}\n'
    with pytest.raises(EvidenceError):
        reports.read_json(tmp_path / "absent.json")
    assert reports.read_reports(spark, str(tmp_path / "r.json")).count() == 1
    assert reports.is_utc(reports.utc_now()) and not reports.is_utc("2024-01-01") and not reports.is_utc(3)
    assert files.versions(("numpy", "no-such"))["no-such"] == "not-installed"
    assert files.environment_table(spark).count() == len(files.AUDITED)


def test_token_audit(spark):
    rows = [("train", f"r{n}", n + 5) for n in (1, 2, 3)] + [("validation", f"v{n}", n + 5) for n in (4, 5)]
    lengths = spark.createDataFrame(rows, "split string, row_id string, n_tokens bigint")
    config = ExperimentConfig(training=TrainingConfig(max_sequence_length=10))
    stored = audit.build(lengths, config, (10, 11, 12, 13))
    assert stored["splits"]["train"]["prompt_plus_answer_tokens"] == {"minimum": 6, "median": 7, "p95_nearest_rank": 8, "maximum": 8, "rows_over_max_sequence_length": 0}
    assert audit.verify(json.loads(json.dumps(stored)), lengths, config, (10, 11, 12, 13))["safe_to_train_without_truncation"]
    for key in ("config_sha256", "development_rows"):
        with pytest.raises(EvidenceError):
            audit.verify(stored | {key: 1}, lengths, config, (10, 11, 12, 13))
    short = ExperimentConfig(training=TrainingConfig(max_sequence_length=8))
    with pytest.raises(EvidenceError, match="longer"):
        audit.verify(audit.build(lengths, short, (10, 11, 12, 13)), lengths, short, (10, 11, 12, 13))
    with pytest.raises(ValueError):
        audit.build(lengths, config, (10, 11, 12, 13), test_loaded=True)


def test_commands(spark, tmp_path, capsys):
    rows = [(f"row {c} {i}", c, 1000 * c + i) for c in range(4) for i in range(20)]
    spark.createDataFrame(rows, "text string, label int, source_index bigint").write.parquet(str(tmp_path / "train"))
    ExperimentConfig(data=DataConfig(train_per_class=5, validation_per_class=2)).write(tmp_path / "c.json")
    base = ["--config", str(tmp_path / "c.json"), "--root", str(tmp_path), "--train", str(tmp_path / "train"), "--publisher-rows", "80"]
    assert cli.main([*base, "data-stats", "--output", str(tmp_path / "stats.json")]) == 0
    stats = reports.read_json(tmp_path / "stats.json")
    assert stats["splits"]["train"]["rows"] == 20 and stats["selection"]["unused_publisher_train_rows"] == 80 - 28
    cli.main([*base, "examples", "--output", str(tmp_path / "examples.json")])
    assert len(reports.read_json(tmp_path / "examples.json")) == 3
    with pytest.raises(SystemExit, match="--tokenizer"):
        cli.main([*base, "token-audit", "--output", str(tmp_path / "audit.json")])
    stand_in = ["--tokenizer", "veritab.sources.scorer:HashTokenizer"]
    for extra in ([], ["--check"]):
        assert cli.main([*base, *stand_in, "token-audit", "--output", str(tmp_path / "audit.json"), *extra]) == 0
    assert reports.read_json(tmp_path / "audit.json")["model_tokenizer"] == "stand-in: hashed words"
    for command in (["final-test", "--confirm", protocol.CONFIRMATION], ["validation-baseline", "--output", str(tmp_path / "b.json")]):
        with pytest.raises(SystemExit, match="--base"):
            cli.main([*base, *stand_in, *command])
    # scores that have nothing to do with the labels have no temperature between the bounds
    with pytest.raises(ValueError, match="search ended"):
        cli.main([*base, *stand_in, "validation-baseline", "--base", "veritab.sources.scorer:hash_scorer", "--output", str(tmp_path / "b.json")])
    with pytest.raises(ValueError, match="80 rows instead of 120000"):
        cli.main([*base[:-2], "data-stats", "--output", str(tmp_path / "stats.json")])
    for name, r in (("a", report()), ("b", report(4))):
        reports.write_json(r, tmp_path / f"{name}.json")
    with pytest.raises(EvidenceError):
        cli.main(["compare-runs", str(tmp_path / "a.json"), str(tmp_path / "b.json"), "--strict"])
    assert cli.main(["--root", str(tmp_path), "write-config"]) == 0
    with pytest.raises(EvidenceError, match="nothing to verify"):
        cli.main([*base, "verify"])
    capsys.readouterr()
