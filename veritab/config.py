"""Experiment settings with their checks, and how they are stored."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any


# The names and defaults of the settings, as reports store them.


@dataclass(frozen=True)
class DataConfig:
    dataset_name: str = "newsroom/topics4"
    dataset_revision: str = "unpinned"
    seed: int = 73
    train_per_class: int = 2_000
    validation_per_class: int = 500
    validation_start_per_class: int | None = None
    publisher_test_rows: int = 7_600


@dataclass(frozen=True)
class QuantizationConfig:
    load_in_4bit: bool = True
    quant_type: str = "nf4"
    compute_dtype: str = "float16"
    use_double_quant: bool = True


@dataclass(frozen=True)
class LoraConfig:
    rank: int = 16
    alpha: int = 32
    dropout: float = 0.05
    bias: str = "none"
    target_modules: tuple[str, ...] = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj")


@dataclass(frozen=True)
class TrainingConfig:
    epochs: int = 2
    learning_rate: float = 2e-4
    per_device_train_batch_size: int = 2
    per_device_eval_batch_size: int = 4
    gradient_accumulation_steps: int = 8
    warmup_ratio: float = 0.03
    max_sequence_length: int = 512
    gradient_checkpointing: bool = True
    optimizer: str = "paged_adamw_8bit"
    select_metric: str = "macro_f1"


@dataclass(frozen=True)
class ExperimentConfig:
    schema_version: int = 1
    model_name: str = "unnamed"
    model_revision: str = "unpinned"
    data: DataConfig = field(default_factory=DataConfig)
    quantization: QuantizationConfig = field(default_factory=QuantizationConfig)
    lora: LoraConfig = field(default_factory=LoraConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    resume_eligible: bool = False
    test_evaluations_allowed: int = 1

    def problems(self) -> list[str]:
        """What is wrong with these settings; empty if nothing is."""
        budget, start = self.test_evaluations_allowed, self.data.validation_start_per_class
        rules = (
            (type(self.schema_version) is int and self.schema_version == 1, "unsupported experiment schema"),
            (self.quantization.load_in_4bit and self.quantization.quant_type == "nf4", "the base must be in 4-bit NF4"),
            (self.lora.rank > 0 and self.lora.alpha > 0, "adapter rank and alpha must be positive"),
            (0 <= self.lora.dropout < 1, "adapter dropout must be in [0, 1)"),
            (self.training.select_metric == "macro_f1", "selection must use validation macro-F1"),
            (self.data.train_per_class > 0 and self.data.validation_per_class > 0, "split counts must be positive"),
            (start is None or start >= 0, "validation_start_per_class must not be negative"),
            (type(budget) is int and budget in (0, 1), "test_evaluations_allowed must be the integer 0 or 1"),
            (self.resume_eligible is False, "resume_eligible must be false"),
        )
        return [text for holds, text in rules if not holds]

    def validate(self) -> ExperimentConfig:
        if problems := self.problems():
            raise ValueError("; ".join(problems))
        return self

    def to_dict(self) -> dict[str, Any]:
        """As stored; an unset validation start is left out, so that older digests hold."""
        out = asdict(self)
        if self.data.validation_start_per_class is None:
            del out["data"]["validation_start_per_class"]
        return out

    def write(self, path: str | Path) -> None:
        self.validate()
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.to_dict(), indent=2) + "\n", encoding="utf-8")


SECTIONS = {"data": DataConfig, "quantization": QuantizationConfig, "lora": LoraConfig, "training": TrainingConfig}


def from_dict(payload: dict[str, Any]) -> ExperimentConfig:
    """Settings from their stored form; unknown and missing sections are refused."""
    known = {f.name for f in fields(ExperimentConfig)}
    if unknown := sorted(set(payload) - known):
        raise ValueError(f"unknown settings {unknown}")
    if missing := sorted(set(SECTIONS) - set(payload)):
        raise ValueError(f"missing sections {missing}")
    values = dict(payload)
    for name, kind in SECTIONS.items():
        section = dict(values[name])
        if unknown := sorted(set(section) - {f.name for f in fields(kind)}):
            raise ValueError(f"unknown settings {unknown} in {name}")
        if "target_modules" in section:
            section["target_modules"] = tuple(section["target_modules"])
        values[name] = kind(**section)
    return ExperimentConfig(**values).validate()


def load_config(path: str | Path) -> ExperimentConfig:
    return from_dict(json.loads(Path(path).read_text(encoding="utf-8")))
