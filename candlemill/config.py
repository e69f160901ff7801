"""Frozen research settings. Every table they shape carries their hash."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

# fixed values: pattern families in priority order
PATTERN_NAMES = (
    "head_and_shoulders",
    "inverse_head_and_shoulders",
    "broadening_formation",
    "rectangle",
    "symmetrical_triangle",
    "double_top",
    "double_bottom",
)
NEUTRAL_PATTERNS = ("broadening_formation", "rectangle", "symmetrical_triangle")
ALL_PATTERNS = "__all_patterns__"
GEOMETRY_FLOOR = 1e-10


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def settings_hash(settings, extra: dict | None = None, length: int = 16) -> str:
    """Provenance hash of a settings object (and the rule text that goes with it)."""
    payload = {"settings": asdict(settings), "rules": extra or {}}
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()[:length]


@dataclass(frozen=True)
class PatternConfig:
    """Detector settings. Geometry thresholds are ratios in relative-log price space."""

    # fixed values: the published baseline settings
    core_lengths: tuple[int, ...] = (35, 55, 80)
    min_context_bars: int = 3
    context_bandwidth_multiple: float = 2.0
    max_age_fraction: float = 0.15
    bandwidth_fraction: float = 0.045
    bandwidth_multipliers: tuple[float, ...] = (0.90, 1.00, 1.10)
    min_bandwidth: float = 1.5
    max_bandwidth: float = 12.0
    prominence_noise_scale: float = 0.75
    prominence_lookaround: int = 3
    pivot_refine_radius: int = 1
    min_pivot_separation: int = 2
    min_span_bars: int = 5
    height_noise_scale: float = 2.0
    max_shoulder_error: float = 0.75
    max_neckline_slope: float = 1.25
    max_time_asymmetry: float = 3.0
    min_head_prominence: float = 0.15
    min_shoulder_clearance: float = 0.05
    max_double_level_error: float = 0.75
    min_double_spacing: int = 3
    min_double_spacing_fraction: float = 0.12
    max_double_spacing_fraction: float = 0.80
    require_double_confirmation: bool = False
    max_rectangle_error: float = 0.35
    min_triangle_convergence: float = 0.12
    max_triangle_apex_spans: float = 2.5
    min_broadening_expansion: float = 0.10
    cluster_min_overlap: float = 0.40
    cluster_min_pivot_match: float = 0.60
    cluster_min_pivot_match_neutral: float = 0.80
    cluster_pivot_tolerance: int = 2
    cluster_center_tolerance: float = 0.35
    competition_overlap: float = 0.40
    context_lookback: int = 10
    execution_delay: int = 1

    def __post_init__(self) -> None:
        cores = tuple(sorted(self.core_lengths))
        _require(bool(cores) and len(set(cores)) == len(cores), "core lengths must be non-empty and distinct")
        _require(all(isinstance(c, int) and c >= 8 for c in cores), "every core length must be an integer >= 8")
        object.__setattr__(self, "core_lengths", cores)
        object.__setattr__(self, "bandwidth_multipliers", tuple(sorted(self.bandwidth_multipliers)))
        _require(any(abs(m - 1.0) <= 1e-12 for m in self.bandwidth_multipliers), "multipliers must include 1.0")
        _require(all(m > 0 for m in self.bandwidth_multipliers), "multipliers must be positive")
        _require(0 <= self.max_age_fraction <= 1, "max_age_fraction must lie in [0, 1]")
        _require(self.max_bandwidth >= self.min_bandwidth > 0, "bandwidth bounds are inverted")
        _require(self.prominence_lookaround >= 2, "prominence_lookaround must be >= 2")
        _require(self.max_time_asymmetry >= 1, "max_time_asymmetry must be >= 1")
        _require(self.execution_delay >= 1, "execution_delay must be >= 1")
        _require(
            0 <= self.min_double_spacing_fraction <= self.max_double_spacing_fraction <= 1,
            "double spacing fractions must be ordered inside [0, 1]",
        )
        _require(
            self.cluster_min_pivot_match_neutral >= self.cluster_min_pivot_match,
            "neutral pivot threshold must not be below the general one",
        )

    def bandwidths(self, core: int) -> tuple[float, ...]:
        def clip(b: float) -> float:
            return min(self.max_bandwidth, max(self.min_bandwidth, b))

        base = clip(self.bandwidth_fraction * core)
        return tuple(sorted({round(clip(base * m), 10) for m in self.bandwidth_multipliers}))

    def context(self, core: int) -> int:
        """Bars on each side of the core that only steady the smoother."""
        return max(self.min_context_bars, math.ceil(self.context_bandwidth_multiple * max(self.bandwidths(core))))

    def observation_length(self, core: int) -> int:
        _require(core in self.core_lengths, "unknown core length")
        return core + 2 * self.context(core)

    def max_age(self, core: int) -> int:
        return math.floor(self.max_age_fraction * core)

    def double_spacing(self, core: int) -> tuple[int, int]:
        low = max(self.min_double_spacing, math.ceil(self.min_double_spacing_fraction * core))
        return low, max(low, math.floor(self.max_double_spacing_fraction * core))

    @property
    def warmup_bars(self) -> int:
        return max(self.observation_length(c) for c in self.core_lengths)


@dataclass(frozen=True)
class CostModel:
    # fixed values: default trading costs
    brokerage_bps_per_side: float = 1.0
    slippage_bps_per_side: float = 0.0
    fallback_spread_bps: float = 5.0

    def __post_init__(self) -> None:
        for name in ("brokerage_bps_per_side", "slippage_bps_per_side", "fallback_spread_bps"):
            v = getattr(self, name)
            _require(not isinstance(v, bool) and math.isfinite(v) and v >= 0, f"{name} must be finite and >= 0")


@dataclass(frozen=True)
class ProcedureConfig:
    # fixed values: default statistical procedure
    horizons: tuple[int, ...] = (1, 3, 5, 10, 20)
    ticks_per_bar: int = 5
    overlap_policy: str = "skip_new"
    controls_per_event: int = 20
    min_controls: int = 5
    volatility_lookback: int = 20
    embargo: int = 5
    alpha: float = 0.05
    confidence: float = 0.95
    min_events: int = 30
    min_seeds: int = 5
    top_k: int = 100
    costs: CostModel = field(default_factory=CostModel)

    def __post_init__(self) -> None:
        _require(bool(self.horizons) and all(h > 0 for h in self.horizons), "horizons must be positive")
        object.__setattr__(self, "horizons", tuple(sorted(set(self.horizons))))
        _require(self.overlap_policy in ("skip_new", "allow"), "overlap_policy must be skip_new or allow")
        _require(0 < self.min_controls <= self.controls_per_event, "min_controls must lie in [1, controls_per_event]")
        _require(0 < self.alpha < 1 and 0 < self.confidence < 1, "alpha and confidence must lie in (0, 1)")


@dataclass(frozen=True)
class ExperimentConfig:
    # fixed values: default experiment settings
    base_seed: int = 20_260_101
    horizon: int = 20
    lookback_bars: int = 20
    train_fraction: float = 0.60
    validation_fraction: float = 0.20
    test_fraction: float = 0.20
    threshold_min: float = 0.50
    threshold_max: float = 0.90
    threshold_step: float = 0.025
    min_validation_trades: int = 25
    min_validation_runs: int = 5

    def __post_init__(self) -> None:
        total = self.train_fraction + self.validation_fraction + self.test_fraction
        _require(abs(total - 1.0) < 1e-9, "split fractions must sum to 1")

    def thresholds(self) -> list[float]:
        """Whole steps from the lowest threshold; the highest is never passed."""
        last = int((self.threshold_max - self.threshold_min) / self.threshold_step + 1e-12)
        grid = (self.threshold_min + k * self.threshold_step for k in range(last + 1))
        return [t if t < self.threshold_max else self.threshold_max for t in grid]
