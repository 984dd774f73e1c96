"""The token-length audit of a development split, stored and verified."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from veritab.config import ExperimentConfig
from veritab.errors import EvidenceError
from veritab.operators import digests, splits, tokens
from veritab.operators.trees import require_equal


def build(lengths: DataFrame, config: ExperimentConfig, code_ids: tuple[int, ...], test_loaded: bool = False, tokenizer: str | None = None) -> dict[str, Any]:
    """The audit of (split, row_id, n_tokens) of train and validation; ``tokenizer`` names what measured them, by default the model's own."""
    if test_loaded:
        raise ValueError("an audit of lengths must not load the test split")
    longest = config.training.max_sequence_length
    rows = {r["split"]: r for r in tokens.token_audit(lengths, longest).collect()}
    ids = {r["split"]: r["row_ids_sha256"] for r in splits.split_digests(lengths).collect()}
    each = {r["split"]: r["token_lengths_sha256"] for r in digests.lengths_digest(lengths, ["split"]).collect()}
    if missing := {"train", "validation"} - set(rows):
        raise ValueError(f"empty splits {sorted(missing)} can't be audited")
    blocks = {
        name: {
            "rows": rows[name]["rows"], "row_ids_sha256": ids[name], "token_lengths_sha256": each[name],
            "prompt_plus_answer_tokens": {
                "minimum": rows[name]["minimum"], "median": tokens.median_value(rows[name]["median"]), "p95_nearest_rank": rows[name]["p95_nearest_rank"], "maximum": rows[name]["maximum"],
                "rows_over_max_sequence_length": rows[name]["rows_over"],
            },
        }
        for name in ("train", "validation")
    }
    over = sum(b["prompt_plus_answer_tokens"]["rows_over_max_sequence_length"] for b in blocks.values())
    return {
        "schema_version": 1, "config_sha256": digests.json_sha256(config.to_dict()), "dataset": config.data.dataset_name, "dataset_revision": config.data.dataset_revision,
        "model_tokenizer": tokenizer or config.model_name, "model_revision": config.model_revision, "max_sequence_length": longest, "test_loaded": False,
        "class_code_token_ids": dict(zip("ABCD", code_ids, strict=True)), "splits": blocks, "development_rows": sum(b["rows"] for b in blocks.values()),
        "rows_over_max_sequence_length": over, "safe_to_train_without_truncation": over == 0,
    }


def verify(stored: dict, lengths: DataFrame, config: ExperimentConfig, code_ids: tuple[int, ...], tokenizer: str | None = None) -> dict:
    """Recompute an audit; a stale field or a row too long is refused."""
    again = build(lengths, config, code_ids, tokenizer=tokenizer)
    require_equal(stored, again, "token_audit")
    if not again["safe_to_train_without_truncation"]:
        raise EvidenceError(f"{again['rows_over_max_sequence_length']} rows are longer than {again['max_sequence_length']} tokens")
    return again


def lengths_of(members: DataFrame, encode) -> DataFrame:
    """(split, row_id, n_tokens) by a column function from prompt text to ids."""
    from veritab.functions.text import inference_messages, render_chat

    ids = encode(render_chat(inference_messages(F.col("text"))))
    return members.select("split", "row_id", (F.size(ids) + tokens.ANSWER_TOKENS).cast("bigint").alias("n_tokens"))
