"""Typed settings with bounds, from a mapping (an environment, Spark's configuration)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    # name: default; bounds below
    segment_chars: int = 16000
    planning_batch: int = 45
    realization_batch: int = 10
    concurrency: int = 3
    timeout_s: int = 180
    retries: int = 1
    repair_calls: int = 4  # a document with as many calls gets no second realization
    output_tokens: int = 8000
    embedding_dimension: int = 1024
    embedding_batch: int = 10
    retention_hours: int = 168

    @classmethod
    def load(cls, values: Mapping[str, str], prefix: str = "CLAIMFORGE_") -> "Settings":
        given = {f.name: int(values[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in values}
        out = cls(**given)
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(out, name) <= high:
                raise ValueError(f"{name} is outside {low}..{high}")
        return out


#: Least and greatest allowed.
BOUNDS = {"segment_chars": (500, 200000), "concurrency": (1, 8), "retries": (0, 5), "embedding_batch": (1, 20), "retention_hours": (1, 8760)}
