"""Settings with their ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields


def _clamped(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


@dataclass(frozen=True)
class Settings:
    threads: int = 4
    punctuation_level: int = 7
    case_level: int = 7
    text_scale: float = 1.0
    beam: int = 8
    phrase_score: float = 1.5
    chunk_ms: int = 30_000
    overlap_ms: int = 3_000
    diarization: str = "campp"

    def __post_init__(self) -> None:
        limits = {"threads": (1, 8), "punctuation_level": (1, 10), "case_level": (1, 10), "text_scale": (0.8, 1.6), "beam": (1, 16), "phrase_score": (0.0, 8.0)}
        for name, (low, high) in limits.items():
            object.__setattr__(self, name, type(getattr(self, name))(_clamped(getattr(self, name), low, high)))

    @classmethod
    def of(cls, values: dict) -> "Settings":
        """Of a dictionary; unknown names and nulls are passed over."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})
