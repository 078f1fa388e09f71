"""Configuration of tree building, drift thresholds and memory."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from driftgrove.errors import InvalidConfiguration


def _share(owner: object, *names: str) -> None:
    for name in names:
        if not 0.0 <= getattr(owner, name) <= 1.0:
            raise InvalidConfiguration(f"{name} must be in [0,1]")


@dataclass(frozen=True)
class BuilderConfig:
    minimum_threshold_against_max_word_count: float = 0.5
    similarity_threshold: float = 0.5
    minimum_number_of_sources_to_create_branch_for_node: int = 1

    def __post_init__(self) -> None:
        _share(self, "minimum_threshold_against_max_word_count", "similarity_threshold")


@dataclass(frozen=True)
class ThresholdConfig:
    alpha: float = 0.5
    beta: float = 0.5
    alpha_error_threshold: float = 0.1
    beta_error_threshold: float = 0.1
    word_importance_error_threshold: float = 0.1
    alpha_option1_threshold: float = 0.1
    alpha_option2_threshold: float = 0.2
    alpha_option3_threshold: float = 0.3
    beta_option1_threshold: float = 0.13
    beta_option2_threshold: float = 0.2
    beta_option3_threshold: float = 0.2
    word_importance_option1_threshold: float = 0.3
    word_importance_option2_threshold: float = 0.2
    selected_alpha_option: str = "Option1"
    selected_beta_option: str = "Option1"
    selected_word_importance_option: str = "Option1"

    def __post_init__(self) -> None:
        options = [f.name for f in dataclasses.fields(self) if "_option" in f.name and f.name.endswith("_threshold")]
        _share(self, "alpha", "beta", *options)
        for name, most in (("alpha", 3), ("beta", 3), ("word_importance", 2)):
            if getattr(self, f"selected_{name}_option") not in [f"Option{i + 1}" for i in range(most)]:
                raise InvalidConfiguration(f"selected_{name}_option must be one of Option1 to Option{most}")


@dataclass(frozen=True)
class Config:
    builder: BuilderConfig = field(default_factory=BuilderConfig)
    thresholds: ThresholdConfig = field(default_factory=ThresholdConfig)
    memory_mode: str = "Full"
    max_batches_in_memory: int | None = None
    trigger_policy_mode: str = "PaperDiagnosticScaffold"

    def __post_init__(self) -> None:
        if self.memory_mode not in ("Full", "SlidingWindow"):
            raise InvalidConfiguration("memory_mode must be Full or SlidingWindow")
        if self.trigger_policy_mode not in ("Placeholder", "PaperDiagnosticScaffold"):
            raise InvalidConfiguration("trigger_policy_mode must be Placeholder or PaperDiagnosticScaffold")

    @property
    def window(self) -> int | None:
        """Batches that are retained, or None for all. Zero is refused when it would be used."""
        if self.memory_mode == "Full" or self.max_batches_in_memory is None:
            return None
        if self.max_batches_in_memory < 1:
            raise InvalidConfiguration("max_batches_in_memory must be greater than zero in SlidingWindow mode")
        return self.max_batches_in_memory

    def to_dict(self) -> dict:
        return {
            "hkt_builder": dataclasses.asdict(self.builder),
            "thresholds": dataclasses.asdict(self.thresholds),
            "memory_mode": self.memory_mode,
            "max_batches_in_memory": self.max_batches_in_memory,
            "trigger_policy_mode": self.trigger_policy_mode,
        }

    @classmethod
    def from_dict(cls, raw: dict, strict: bool = False) -> Config:
        """Missing keys take their defaults; ``strict`` refuses missing and unknown ones. Any key that ends in ``_thresholds`` stands for ``thresholds``."""
        raw = {"thresholds" if k.endswith("_thresholds") else k: v for k, v in raw.items()}

        def part(kind, given: dict, where: str):
            names = {f.name for f in dataclasses.fields(kind)}
            if strict and names != set(given):
                raise InvalidConfiguration(f"{where}: missing or unknown keys {sorted(names ^ set(given))}")
            return kind(**{k: v for k, v in given.items() if k in names})

        if strict and set(raw) != set(cls().to_dict()):
            raise InvalidConfiguration(f"missing or unknown keys {sorted(set(raw) ^ set(cls().to_dict()))}")
        top = {k: raw[k] for k in ("memory_mode", "max_batches_in_memory", "trigger_policy_mode") if k in raw}
        return cls(part(BuilderConfig, raw.get("hkt_builder", {}), "hkt_builder"), part(ThresholdConfig, raw.get("thresholds", {}), "thresholds"), **top)

    @classmethod
    def load(cls, path: str, strict: bool = False) -> Config:
        with open(path) as f:
            return cls.from_dict(json.load(f), strict)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.to_dict(), f, indent=2)
