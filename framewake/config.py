"""Parameters of the trace, with the defaults that its results depend on (fixed values)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class ShotConfig:
    method: str = "auto"  # auto, histogram, fixed
    fixed_window: float = 2.0
    min_shot: float = 0.6
    max_shot: float = 12.0
    least_threshold: float = 0.12
    most_threshold: float = 0.35
    deviations: float = 6.0
    peak_ratio: float = 2.5  # a cut scores so many times the median at least


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 5
    top_n: int = 20
    trim: float = 0.2
    hit_above: float = 0.5
    score_weight: float = 0.75
    vote_weight: float = 0.25
    least_visual: float = 0.30


@dataclass(frozen=True)
class AlignConfig:
    method: str = "tn"  # tn, dp, dtw, hv, none
    min_sim: float = 0.35
    adaptive: bool = True
    keep_each: float = 5.0
    top_points: int = 5
    max_step: int = 10
    least_slope: float = 0.5
    most_slope: float = 2.0
    min_length: int = 3
    gap_penalty: float = 0.2
    max_paths: int = 6
    slopes: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.25)
    offset_tolerance: float = 1.0
    fit_rounds: int = 3
    fit_sigma: float = 2.0
    fit_floor: float = 0.15


@dataclass(frozen=True)
class ScoreConfig:
    visual: float = 0.45
    temporal: float = 0.25
    margin: float = 0.15
    alignment: float = 0.15
    high: float = 0.80
    medium: float = 0.65
    low: float = 0.50
    margin_unit: float = 0.04
    min_segment: float = 0.8


@dataclass(frozen=True)
class MergeConfig:
    query_gap: float = 0.35
    source_gap: float = 0.6
    speed_gap: float = 0.12


@dataclass(frozen=True)
class SamplingConfig:
    """Frames a second at each density; tables with fewer give what they have."""

    coarse: float = 1.0
    medium: float = 2.0
    fine: float = 4.0
    hard: float = 8.0
    longest_rescan: float = 1200.0
    margin: float = 1.5


@dataclass(frozen=True)
class RefineConfig:
    enabled: bool = True
    second_within: float = 0.12
    enhance_below: float = 0.85
    normalise: bool = False
    norm_beta: float = 0.5
    norm_k: int = 10
    background: int = 256
    crop_views: tuple[float, ...] = (0.9, 0.8)
    crop_candidates: int = 3


@dataclass(frozen=True)
class TraceConfig:
    shots: ShotConfig = field(default_factory=ShotConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    align: AlignConfig = field(default_factory=AlignConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    merge: MergeConfig = field(default_factory=MergeConfig)
    sampling: SamplingConfig = field(default_factory=SamplingConfig)
    refine: RefineConfig = field(default_factory=RefineConfig)

    def as_dict(self) -> dict:
        return asdict(self)


def load(data: dict, into=TraceConfig):
    """A configuration from nested dictionaries; unknown keys are an error, so that a misspelt one is not lost."""
    known = {f.name: f for f in fields(into)}
    if unknown := set(data) - set(known):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    made = {}
    for name, value in data.items():
        default = getattr(into(), name)
        made[name] = load(value, type(default)) if is_dataclass(default) else tuple(value) if isinstance(default, tuple) else value
    return into(**made)
