"""Driver-side settings: frozen defaults, overlaid by TOML files in order (global, then local)."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Recall:
    # Defaults of the recall pipeline.
    rrf_k: int = 20
    pool: int = 20
    min_similarity: float = 0.35
    max_results: int = 3
    w_relevance: float = 1.0
    w_recency: float = 0.5
    w_importance: float = 0.3
    w_strength: float = 0.4
    half_life_days: float = 90.0
    token_budget: int = 4000


@dataclass(frozen=True)
class Lifecycle:
    # Defaults of the lifecycle operators.
    duplicate_similarity: float = 0.92
    supersede_similarity: float = 0.85
    gap_min_asks: int = 3
    gap_max_best: float = 0.5
    promote_min_use: int = 3
    promote_max_noise: float = 0.5
    failure_min_sessions: int = 2
    failure_min_days: float = 3.0
    failure_window: int = 25


@dataclass(frozen=True)
class Config:
    recall: Recall = field(default_factory=Recall)
    lifecycle: Lifecycle = field(default_factory=Lifecycle)


def overlaid(config: Config, values: dict[str, Any]) -> Config:
    """Known keys replace defaults; unknown sections and keys are left out."""
    parts = {}
    for f in fields(config):
        section, given = getattr(config, f.name), values.get(f.name, {})
        known = {g.name: type(getattr(section, g.name))(given[g.name]) for g in fields(section) if g.name in given}
        parts[f.name] = replace(section, **known)
    return Config(**parts)


def load(*paths: str | Path) -> Config:
    """Defaults under the files that exist, the later ones on top."""
    config = Config()
    for path in map(Path, paths):
        if path.is_file():
            config = overlaid(config, tomllib.loads(path.read_text()))
    return config
