"""Parameters of cue merging, with their defaults and the ranges that a user may set."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any


@dataclass(frozen=True)
class MergeParams:
    duplicate_gap_sec: float = 2.0
    contained_gap_sec: float = 1.0
    min_contained_key_len: int = 4
    similar_threshold: float = 0.95
    min_similar_key_len: int = 8
    similar_length_ratio: float = 0.75
    min_duration_sec: float = 0.5
    postprocess_passes: int = 3

    @classmethod
    def of(cls, given: Mapping[str, Any] | MergeParams | None = None) -> MergeParams:
        """Defaults where nothing is given; unknown names are an error."""
        if given is None or isinstance(given, cls):
            return given or cls()
        unknown = sorted(given.keys() - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown merge parameters: {', '.join(unknown)}")
        return cls(**given)

    def checked(self) -> MergeParams:
        """The same, if all values are within the ranges a user may set."""
        wrong = [n for n, v in asdict(self).items() if not RANGES[n][0] <= v <= RANGES[n][1]]
        if wrong:
            raise ValueError(f"out of range: {', '.join(f'{n} must be in {RANGES[n]}' for n in wrong)}")
        return self


#: Least and greatest values that a user may set (fixed values).
RANGES = {
    "duplicate_gap_sec": (0, 5),
    "contained_gap_sec": (0, 3),
    "min_contained_key_len": (2, 12),
    "similar_threshold": (0.88, 1.0),
    "min_similar_key_len": (4, 24),
    "similar_length_ratio": (0.5, 1.0),
    "min_duration_sec": (0, 2),
    "postprocess_passes": (1, 5),
}
