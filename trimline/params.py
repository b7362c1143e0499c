"""Frozen parameter sets. Every threshold an operator uses is a named field here."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

EXACT = "exact"
INCREMENTAL = "incremental"


@dataclass(frozen=True)
class Tiering:
    """Granularity and retention of the three sample tiers.

    ``mode`` picks the bucket semantics: ``exact`` takes nearest-rank percentiles over all
    samples of a bucket, ``incremental`` merges samples one at a time (P50 becomes the mean,
    P95 and P99 the largest sample).

    ``as_of`` fixes the clock for all series; ``None`` lets each series run on its own latest
    sample. ``hot_rows`` is the row count from which a series is handled by the split path
    instead of by one task: over four years of samples at 30 seconds. ``hot_bucket_rows`` is
    the row count from which one bucket of such a series is ranked without gathering it.
    """

    raw_seconds: int = 300
    fine_seconds: int = 300
    fine_keep_seconds: int = 86_400
    coarse_seconds: int = 3_600
    coarse_keep_seconds: int = 604_800
    mode: str = EXACT
    as_of: datetime | None = None
    hot_rows: int = 5_000_000
    hot_bucket_rows: int = 200_000

    def __post_init__(self) -> None:
        if self.mode not in (EXACT, INCREMENTAL):
            raise ValueError(f"mode must be {EXACT!r} or {INCREMENTAL!r}, got {self.mode!r}")
        if self.coarse_seconds % self.fine_seconds:
            raise ValueError("coarse_seconds must be a multiple of fine_seconds")
        if 86_400 % self.coarse_seconds:
            raise ValueError("coarse_seconds must divide a day")
        if self.hot_rows < 1 or self.hot_bucket_rows < 1:
            raise ValueError("hot_rows and hot_bucket_rows must be positive")


@dataclass(frozen=True)
class Sizing:
    """Classifier and sizing parameters.

    The floors and the P99 factor are published safety limits. All other defaults are this
    library's own choice; the rules they stand for are published only in prose.
    """

    # published limits
    cpu_floor_millis: int = 50
    memory_floor_bytes: int = 64 * 1024 * 1024
    memory_p99_factor: float = 1.10
    idle_seconds: int = 48 * 3600

    # usage profile
    step_seconds: int = 3600
    idle_request_fraction: float = 0.02
    idle_cpu_millis: float = 5.0

    # classifier
    growth_share: float = 0.9
    growth_min_steps: int = 24
    batch_peak_ratio: float = 4.0
    batch_idle_share: float = 0.3
    burst_peak_ratio: float = 2.0
    burst_variation: float = 0.5

    # size proposals: factor on the P95 (steady, batch) or P50 (burstable) and on the maximum
    steady_headroom: float = 1.15
    steady_limit: float = 1.20
    burst_headroom: float = 1.25
    burst_limit: float = 1.25
    batch_headroom: float = 1.10
    batch_limit: float = 1.50

    # confidence: share of a full window and of a full sample count
    full_window_seconds: int = 7 * 86_400
    full_samples: int = 2016
    window_weight: float = 0.6

    # reduction cap by confidence
    low_confidence: float = 0.5
    high_confidence: float = 0.8
    cap_low: float = 0.2
    cap_medium: float = 0.35
    cap_high: float = 0.5

    # risk by reduction share
    risk_low_reduction: float = 0.3
    risk_high_reduction: float = 0.6
