"""Commands: python -m veritab.cli COMMAND --help"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Window, functions as F

from veritab.config import ExperimentConfig, load_config
from veritab.errors import EvidenceError
from veritab.functions.text import inference_messages, render_chat, training_messages
from veritab.operators import compare, splits
from veritab.plans import audit, card, protocol
from veritab.session import local_session, written
from veritab.sources.corpus import PUBLISHED_ROWS, Bundle, load_bundle
from veritab.sources.reports import read_json, write_json
from veritab.sources.scorer import code_ids, named, prompt_ids, score


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veritab")
    p.add_argument("--config", help="experiment settings as JSON")
    p.add_argument("--root", default=".", help="folder of reports and scores")
    p.add_argument("--train", help="parquet of the publisher's training rows")
    p.add_argument("--test", help="parquet of the publisher's test rows")
    p.add_argument("--publisher-rows", type=int, default=PUBLISHED_ROWS, help="refuse another number of training rows")
    p.add_argument("--tokenizer", help="module:attribute, or the JSON file of a public tokenizer")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("write-config")
    for name in ("data-stats", "examples"):
        commands.add_parser(name).add_argument("--output", required=True)
    token = commands.add_parser("token-audit")
    token.add_argument("--output", required=True)
    token.add_argument("--check", action="store_true")
    commands.add_parser("freeze-selection")
    baseline = commands.add_parser("validation-baseline")
    baseline.add_argument("--base", help="scorer of the untuned model, module:attribute")
    baseline.add_argument("--output", required=True)
    final = commands.add_parser("final-test")
    final.add_argument("--confirm", default="")
    for name in protocol.SYSTEMS:
        final.add_argument(f"--{name}", help=f"scorer of the {name} system, module:attribute")
    commands.add_parser("intervals")
    runs = commands.add_parser("compare-runs")
    runs.add_argument("baseline")
    runs.add_argument("variant")
    runs.add_argument("--expect-change", action="append", default=[])
    runs.add_argument("--strict", action="store_true")
    commands.add_parser("model-card").add_argument("--source")
    commands.add_parser("verify").add_argument("--reports-only", action="store_true")
    return p


def placed(rows: DataFrame, order: str) -> DataFrame:
    """Rows of a split of configured size with their place in its order."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(order)) - 1)


def description(bundle: Bundle, config: ExperimentConfig) -> dict:
    rows = splits.described(bundle.members(), bundle.publisher_rows).collect()
    return {
        "schema_version": 1, "dataset": config.data.dataset_name, "dataset_revision": config.data.dataset_revision, "publisher_train_rows": bundle.publisher_rows,
        "publisher_test_rows": config.data.publisher_test_rows, "selection": {"seed": config.data.seed, "unused_publisher_train_rows": rows[0]["unused"] if rows else None},
        "splits": {r["split"]: {"rows": r["rows"], "class_counts": {n: r[f"n_{k}"] for k, n in enumerate(splits.CLASS_NAMES)}, "row_ids_sha256": r["row_ids_sha256"]} for r in rows},
        "test_loaded": bundle.test is not None,
    }


def scorer_of(args: argparse.Namespace, system: str, config: ExperimentConfig) -> Callable[[DataFrame], DataFrame]:
    """(pos, text) to (pos, z) by the scorer and tokenizer that the flags name; without one it refuses."""
    tokenizer, scorer = named(args.tokenizer, "--tokenizer"), named(getattr(args, system), f"--{system}")
    ids, sizes = prompt_ids(tokenizer), config.training
    prompt = render_chat(inference_messages(F.col("text")))
    return lambda rows: score(rows.select("pos", ids(prompt).alias("ids")), scorer, tokenizer.pad_token_id, sizes.per_device_eval_batch_size, sizes.max_sequence_length)


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    config = load_config(args.config) if args.config else ExperimentConfig().validate()
    root = Path(args.root)
    if args.command == "write-config":
        config.write(root / "configs/experiment.json")
        out: dict = {"output": str(root / "configs/experiment.json")}
    elif args.command == "compare-runs":
        out = compare.compare_files(args.baseline, args.variant, set(args.expect_change))
        if args.strict:
            compare.require_controlled(out)
    elif args.command == "model-card":
        out = {"written": str(card.write_card(root, args.source, local_session()))}
    else:
        out = with_data(args, config, root)
    print(json.dumps(out, indent=2))
    return 0


def with_data(args: argparse.Namespace, config: ExperimentConfig, root: Path) -> dict:
    spark = local_session()
    if not args.train:
        raise SystemExit("--train is needed")
    bundle = load_bundle(spark, args.train, config.data, publisher_rows=args.publisher_rows)

    def test() -> DataFrame:
        unlocked = load_bundle(spark, args.train, config.data, args.test, allow_test=True)
        return placed(unlocked.require_test(), "source_index")

    validation = placed(bundle.validation, "row_id")
    if args.command == "data-stats":
        out = description(bundle, config)
        write_json(out, args.output)
    elif args.command == "examples":
        rows = splits.first_of_classes(bundle.members()).withColumn("messages", training_messages(F.col("text"), F.col("label"))).orderBy("label").collect()
        found = [{"row_id": r["row_id"], "messages": [m.asDict() for m in r["messages"]]} for r in rows]
        write_json(found, args.output)
        out = {"output": args.output, "examples": len(found)}
    elif args.command == "token-audit":
        tokenizer = named(args.tokenizer, "--tokenizer")
        name = getattr(tokenizer, "name", args.tokenizer)
        codes = code_ids(tokenizer, "Topic code:")
        lengths = audit.lengths_of(bundle.members(), prompt_ids(tokenizer))
        if args.check:
            out = audit.verify(read_json(args.output), lengths, config, codes, name)
        else:
            out = audit.build(lengths, config, codes, tokenizer=name)
            write_json(out, args.output)
            if not out["safe_to_train_without_truncation"]:
                raise EvidenceError(f"rows are too long; see {args.output}")
    elif args.command == "freeze-selection":
        frozen = protocol.freeze_selection(spark, root, validation)
        out = {"selected_epoch": frozen["selected_epoch"], **{f"{s}_temperature": frozen["validation"][s]["temperature"] for s in protocol.SYSTEMS}}
    elif args.command == "validation-baseline":
        logits = written(scorer_of(args, "base", config)(validation), "baseline-scores")
        out = protocol.validation_baseline(logits, validation, config) | {"scorer": args.base}
        write_json(out, args.output)
    elif args.command == "final-test":
        scorers = {s: scorer_of(args, s, config) for s in protocol.SYSTEMS}
        said = {s: getattr(args, s) for s in protocol.SYSTEMS} | {"tokenizer": args.tokenizer}
        report = protocol.run_final_test(spark, root, config, args.confirm, test(), scorers, said)
        out = report["delta"]
    elif args.command == "intervals":
        out = protocol.build_intervals(spark, root, test())["bootstrap"]["delta"]
    else:
        out = protocol.verify_all(spark, root, validation, test, not args.reports_only)
    return out


if __name__ == "__main__":
    raise SystemExit(main())
