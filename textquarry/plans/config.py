"""The parameters of each pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ProfileConfig:
    """Corpus profile and segmentation."""

    sample_size: int = 10_000
    seed: int = 20260916
    word_limits: tuple[int, ...] = (150, 180, 200, 220)
    audit_limit: int = 120
    example_cap: int = 100
    most_overflow_pct: float = 0.1
    p99_target: float = 480
    excluded_categories: tuple[str, ...] = ("Qonunchilik",)

    def __post_init__(self):
        if not self.word_limits or min(self.word_limits) <= 0:
            raise ValueError("word limits must be positive")


@dataclass(frozen=True)
class DiscoveryConfig:
    """Structural discovery."""

    seed: int = 20260920
    examples_per_signature: int = 3
    excerpt_chars: int = 4000
    baseline: int = 80
    outliers_per_axis: int = 20
    frequent: int = 40
    rare_pages: int = 3
    rare_take: int = 120
    rare_characters: int = 80
    rare_character_count: int = 5
    cap: int = 800
    batch_size: int = 50
    max_pages: int | None = None


@dataclass(frozen=True)
class RefineConfig:
    """Classes after cleanup, and the blind sample."""

    word_limits: tuple[int, ...] = (120, 130, 140)
    example_cap: int = 50
    sample_limit: int = 120
    per_stratum: int = 20
    seed: int = 20260917
    most_words: int = 480
