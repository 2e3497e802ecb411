"""Every tunable number of the engine, as frozen records; override with ``dataclasses.replace``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import SparkSession

from .fixed import SHORT_TYPE, TELEVISION_TYPES


@dataclass(frozen=True)
class StagingConfig:
    """Sparse filtering of the ratings fact: each of two passes drops thin items, then thin users."""

    min_item_ratings: int = 20
    min_user_ratings: int = 5
    passes: int = 2


@dataclass(frozen=True)
class ProfileConfig:
    """From stars to a comparable signal."""

    sigma_floor: float = 0.5
    recency_half_life_years: float | None = 3.0  # None: every rating weighs 1
    use_likes: bool = False
    like_bonus_z: float = 0.25
    bulk_share: float = 0.25  # a single date above this share of ratings looks like an import


@dataclass(frozen=True)
class MatchConfig:
    """Title and year against the catalogue."""

    year_tolerance: int = 1
    fuzzy_threshold: float = 88.0
    subset_threshold: float = 95.0
    require_year_agreement: bool = True
    any_year_for_fuzzy: bool = False  # True: the best key's first entry, even outside the year window


@dataclass(frozen=True)
class SimilarityConfig:
    shrinkage_lambda: float = 60.0
    top_k_neighbours: int = 200
    item_centered: bool = False
    sigma_floor: float = 0.5
    consensus_shrinkage_lambda: float = 30.0


@dataclass(frozen=True)
class ScoringConfig:
    use_residual_input: bool = True
    consensus_beta: float = 1.0
    popularity_alpha: float = 0.15
    min_support: float = 0.03
    pred_shrinkage_k: float = 0.0
    rank_shrinkage_k: float = 1.0
    pred_gain: float = 1.17
    epsilon: float = 1e-9


@dataclass(frozen=True)
class PresentationConfig:
    drop_non_films: bool = True
    drop_title_types: tuple[str, ...] = TELEVISION_TYPES
    include_shorts: bool = True
    short_type: str = SHORT_TYPE
    dedupe_same_work: bool = True
    dedupe_against_seen: bool = True
    max_per_series: int = 2  # 0: no cap
    min_predicted_z: float | None = 0.0
    min_neighbours_to_show: int = 2  # 0: no guard

    def excluded_types(self) -> tuple[str, ...]:
        return self.drop_title_types + (() if self.include_shorts else (self.short_type,))


@dataclass(frozen=True)
class EvalConfig:
    holdout_frac: float = 0.2
    relevant_z: float = 0.5
    ks: tuple[int, ...] = (10, 20, 50, 100)
    seed: int = 20260730
    repeats: int = 10
    holdout_users: int = 300
    holdout_share: float | None = None  # at most this share of the eligible users
    holdout_min: int = 150
    holdout_max: int = 1500


@dataclass(frozen=True)
class Mode:
    """A retrieval mode: the same engine under another novelty setting and popularity window."""

    alpha: float
    min_popularity: int | None = None
    max_popularity: int | None = None
    min_support: float | None = None


MODES = {
    "balanced": Mode(0.15),
    "gem": Mode(0.40, max_popularity=3_000, min_support=0.01),
    "blindspot": Mode(0.0, min_popularity=20_000),
}

#: Settings of the parameter sweep: what each knob costs, against the settings before residual scoring.
SWEEP = {
    "before": ScoringConfig(use_residual_input=False, consensus_beta=0.0, rank_shrinkage_k=0.0, min_support=0.1, pred_gain=1.0),
    "defaults": ScoringConfig(),
    "min_support 0.10": ScoringConfig(min_support=0.10),
    "min_support 0.01": ScoringConfig(min_support=0.01),
    "no rank shrinkage": ScoringConfig(rank_shrinkage_k=0.0),
    "beta 0.5": ScoringConfig(consensus_beta=0.5),
    "beta 0.0": ScoringConfig(consensus_beta=0.0),
    "alpha 0.0": ScoringConfig(popularity_alpha=0.0),
    "alpha 0.4": ScoringConfig(popularity_alpha=0.4),
}
#: The old scorer and the new one side by side.
COMPARE = {
    "legacy": ScoringConfig(use_residual_input=False, consensus_beta=0.0),
    "residual, beta 1.0": ScoringConfig(consensus_beta=1.0),
    "residual, beta 0.5": ScoringConfig(consensus_beta=0.5),
    "residual, beta 0.0": ScoringConfig(consensus_beta=0.0),
}


def from_session(spark: SparkSession, record: Any) -> Any:
    """A configuration record with the fields that the session sets as ``tastegraph.<Record>.<field>`` (``none``: None)."""
    found = {}
    for f in fields(record):
        value = spark.conf.get(f"tastegraph.{type(record).__name__}.{f.name}", None)
        if value is None:
            continue
        now = getattr(record, f.name)
        if value.lower() == "none":
            found[f.name] = None
        elif isinstance(now, bool):
            found[f.name] = value.lower() == "true"
        elif isinstance(now, tuple):
            parts = [x.strip() for x in value.split(",") if x.strip()]
            found[f.name] = tuple(type(now[0])(x) if now else x for x in parts)
        else:
            found[f.name] = value if isinstance(now, str) else int(value) if isinstance(now, int) else float(value)
    return replace(record, **found)
