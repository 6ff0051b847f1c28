"""Settings of a run: frozen dataclasses, read from YAML, checked where they are made."""

from __future__ import annotations

import dataclasses
import math
import typing
from dataclasses import dataclass, field
from typing import Any

from .plans.variants import BUDGETS


def positive(**values: float) -> None:
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v <= 0:
            raise ValueError(f"{name} must be a positive number, not {v!r}")


@dataclass(frozen=True)
class Parser:
    max_height: int = 30
    max_width: int = 30

    def __post_init__(self) -> None:
        positive(max_height=self.max_height, max_width=self.max_width)


@dataclass(frozen=True)
class Compute:
    prefill_tokens_per_second: float = 5000.0
    decode_tokens_per_second: float = 75.0
    training_token_multiplier: float = 3.0

    def __post_init__(self) -> None:
        positive(**dataclasses.asdict(self))


@dataclass(frozen=True)
class Evaluation:
    schema_version: int = 1
    grid_parser: Parser = field(default_factory=Parser)
    compute: Compute = field(default_factory=Compute)

    def __post_init__(self) -> None:
        check_version(self.schema_version)


@dataclass(frozen=True)
class Sampling:
    temperature: float = 0.7
    top_p: float = 0.9
    max_tokens: int = 10000

    def __post_init__(self) -> None:
        positive(max_tokens=self.max_tokens)
        if self.temperature < 0 or not 0 < self.top_p <= 1:
            raise ValueError("temperature is 0 or more, top_p in (0, 1]")


@dataclass(frozen=True)
class Protocols:
    standard_samples: int = 32
    augmented_variants: int = 64
    augmented_samples_per_variant: int = 1
    budgeted_total_samples: int = 64
    guidance_budgets: tuple[int, ...] = BUDGETS

    def __post_init__(self) -> None:
        if tuple(self.guidance_budgets) != BUDGETS or self.augmented_variants != 64:
            raise ValueError(f"budgets are {BUDGETS}, of 64 variants")
        positive(standard_samples=self.standard_samples, augmented_samples_per_variant=self.augmented_samples_per_variant, budgeted_total_samples=self.budgeted_total_samples)


@dataclass(frozen=True)
class Inference:
    schema_version: int = 1
    augmentation_seed: int = 167
    sampling_seed: int = 42
    reasoning: Sampling = field(default_factory=Sampling)
    prediction: Sampling = field(default_factory=Sampling)
    protocols: Protocols = field(default_factory=Protocols)

    def __post_init__(self) -> None:
        check_version(self.schema_version)


@dataclass(frozen=True)
class Engine:
    """Settings of a generation engine; a run may override some."""

    tensor_parallel_size: int = 1
    gpu_memory_utilization: float = 0.9
    request_batch_size: int = 256

    def __post_init__(self) -> None:
        positive(tensor_parallel_size=self.tensor_parallel_size, gpu_memory_utilization=self.gpu_memory_utilization, request_batch_size=self.request_batch_size)
        for name in ("tensor_parallel_size", "request_batch_size"):
            if not isinstance(getattr(self, name), int):
                raise ValueError(f"{name} must be a whole number")
        if self.gpu_memory_utilization > 1:
            raise ValueError("gpu_memory_utilization is at most 1")

    def overridden(self, **overrides: Any) -> Engine:
        """The settings with those overrides that aren't None."""
        return dataclasses.replace(self, **{k: v for k, v in overrides.items() if v is not None})


@dataclass(frozen=True)
class Training:
    """Data side of a training run; a profile's fields replace the general ones."""

    schema_version: int = 1
    seed: int = 42
    epochs: int = 100
    variants_per_task: int = 100
    max_sequence_length: int = 8192
    micro_batch: int = 2
    accumulation: int = 8
    warmup_ratio: float = 0.1
    peak_learning_rate: float = 2e-4
    end_learning_rate: float = 1e-5
    pad_multiple: int = 8

    def __post_init__(self) -> None:
        check_version(self.schema_version)
        positive(epochs=self.epochs, variants_per_task=self.variants_per_task, max_sequence_length=self.max_sequence_length, micro_batch=self.micro_batch, accumulation=self.accumulation, peak_learning_rate=self.peak_learning_rate, pad_multiple=self.pad_multiple)
        if not 0 <= self.warmup_ratio < 1 or not 0 < self.end_learning_rate <= self.peak_learning_rate:
            raise ValueError("warm-up is in [0, 1), the end rate at most the peak")
        if self.epochs > self.variants_per_task:
            raise ValueError("an epoch takes a variant of its own per task")


def check_version(version: int) -> None:
    if version != 1:
        raise ValueError(f"schema version 1 is read, not {version}")


def build(kind: type, values: dict[str, Any]) -> Any:
    """A settings object from nested mappings; unknown names are an error."""
    hints, known = typing.get_type_hints(kind), {f.name for f in dataclasses.fields(kind)}
    if extra := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    made = {k: build(hints[k], v) if dataclasses.is_dataclass(hints[k]) else tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    return kind(**made)


def load(kind: type, path: str, profile: str | None = None) -> Any:
    """Settings from a YAML file, with those of ``profiles.<profile>`` laid over them."""
    import yaml

    with open(path, encoding="utf-8") as f:
        values = yaml.safe_load(f)
    if not isinstance(values, dict):
        raise ValueError(f"{path} holds no mapping")
    profiles = values.pop("profiles", {})
    if profile is not None:
        if profile not in profiles:
            raise ValueError(f"no profile {profile!r} in {path}")
        values |= profiles[profile]
    return build(kind, values)
