"""Settings shared by the plans. Everything is immutable and passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# ---------------------------------------------------------------------------
# They define the results and must not change.
# ---------------------------------------------------------------------------
VALID_STATUSES = ("paid", "shipped", "delivered", "returned")
CANCELLED_STATUS = "cancelled"
NO_PROMO = "NO_PROMO"
PROMO_PREFIX = "PROMO-"
PROMO_LABEL = "Promo"
NON_PROMO_LABEL = "Non-promo"
PROMO_GROUPS = (PROMO_LABEL, NON_PROMO_LABEL)
RETURN_SIZES = ("S", "M", "L", "XL")
STREETWEAR = "Streetwear"
SOCIAL_SOURCE = "social_media"

# Days-of-supply buckets: right-closed, first bucket also holds its lower edge.
AGING_EDGES = (0.0, 30.0, 60.0, 90.0, 180.0, float("inf"))
AGING_LABELS = ("0-30 days", "31-60 days", "61-90 days", "91-180 days", "180+ days")

# Sell-through bands: (label, lowest, lowest included, highest, highest included).
SELL_THROUGH_BANDS = (
    ("Dead stock risk (<0.3)", None, False, 0.3, False),
    ("Healthy (0.6-0.8)", 0.6, True, 0.8, True),
    ("Stockout risk (>=0.9)", 0.9, True, None, False),
)

# Recurring shopping days: (month, first day, last day).
EVENT_DAYS = (
    (2, 12, 14),
    (3, 6, 8),
    (4, 28, 30),
    (5, 1, 1),
    (9, 1, 2),
    (12, 20, 31),
)

DATE_FEATURES = (
    "dayofweek", "month", "day", "dayofyear",
    "year", "weekofyear", "quarter", "is_weekend", "is_gregorian_peak",
)
# ---------------------------------------------------------------------------

HISTOGRAM_BINS = 40
DENSITY_POINTS = 200
WEEKS = 53


@dataclass(frozen=True)
class LagAgg:
    """One rolling statistic: ``fn`` over ``window`` rows of the series shifted by ``lag``."""

    lag: int
    window: int
    fn: str  # mean | max | min

    @property
    def name(self) -> str:
        return f"rolling_{self.fn}_lag{self.lag}_window{self.window}"


@dataclass(frozen=True)
class SeriesConfig:
    """Shape of the daily series and of its features."""

    targets: tuple[str, ...] = ("Revenue", "COGS")
    regime_col: str = "is_covid"
    regime_start: date = date(2019, 1, 1)
    regime_end: date = date(2022, 12, 31)
    horizon: int = 548
    test_days: int = 548
    lags: tuple[int, ...] = (7, 14, 30, 90, 180, 354, 365)
    rolling: tuple[LagAgg, ...] = tuple(
        LagAgg(w, w, fn) for w in (7, 30) for fn in ("mean", "max", "min")
    )
    harmonics: tuple[int, ...] = (1, 2, 3, 4)
    week_onehot: bool = True
    top_weeks: int = 6
    recent_years: int = 3
    growth_clip: tuple[float, float] = (0.80, 1.35)
    ratio_clip: tuple[float, float] = (0.50, 2.50)
    score_weights: tuple[float, float, float] = (0.45, 0.35, 0.20)
    regime_probability: float = 0.5


@dataclass(frozen=True)
class TreeParams:
    """One boosted-tree configuration, in Spark ML terms."""

    max_iter: int
    step_size: float
    max_depth: int
    min_instances: int
    subsampling: float
    feature_share: float
    seed: int = 2404


# The four published configurations.
FULL_ENSEMBLE: dict[str, TreeParams] = {
    "gbt_base": TreeParams(1402, 0.03759155708560107, 7, 100, 0.688363529336043, 0.8975121712165626),
    "gbt_shallow": TreeParams(900, 0.04, 4, 60, 0.85, 0.85),
    "gbt_deep": TreeParams(800, 0.06, 8, 30, 0.80, 0.85),
    "gbt_conservative": TreeParams(1500, 0.025, 5, 100, 0.90, 0.90),
}


def quick_ensemble(rounds: int = 6, depth: int = 4, step: float = 0.3) -> dict[str, TreeParams]:
    """Same four members with few, larger boosting steps; for tests and smoke runs."""
    return {
        name: TreeParams(rounds, step, min(p.max_depth, depth), min(p.min_instances, 20),
                         p.subsampling, p.feature_share, p.seed)
        for name, p in FULL_ENSEMBLE.items()
    }


@dataclass(frozen=True)
class BlendConfig:
    random_draws: int = 5000
    alpha: float = 0.8
    seed: int = 2404
    median_bias: bool = True
    clip_negative: bool = True
    output: str = "Optimized"


@dataclass(frozen=True)
class TrendBreakConfig:
    """Log-linear trend with one forced break plus seasonal terms."""

    break_date: date = date(2019, 1, 1)
    yearly_order: int = 10
    weekly_order: int = 3
    band: float = 0.80
    reg_param: float = 1e-4
    output: str = "TrendBreak"


@dataclass(frozen=True)
class AttributionConfig:
    sample_rows: int | None = None  # None: every day
    seed: int = 42
    top: int = 20


@dataclass(frozen=True)
class ForecastConfig:
    series: SeriesConfig = field(default_factory=SeriesConfig)
    ensemble: dict[str, TreeParams] = field(default_factory=lambda: dict(FULL_ENSEMBLE))
    blend: BlendConfig = field(default_factory=BlendConfig)
    trend: TrendBreakConfig = field(default_factory=TrendBreakConfig)
    attribution: AttributionConfig = field(default_factory=AttributionConfig)
