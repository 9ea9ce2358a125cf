"""Parameters of the analytics operators.

Every operator takes its thresholds from one of these dataclasses, so a preset
can be replaced with ``dataclasses.replace`` without touching a plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The ordered feature list the models are trained on.
FEATURE_NAMES = (
    "request_count", "unique_users", "unique_ips", "path_entropy",
    "request_variance", "spike_ratio", "error_rate", "avg_response_time",
    "response_time_std", "p95_response_time", "checkout_ratio", "payment_ratio",
    "ip_concentration", "user_concentration", "hour", "is_business_hours",
    "is_night", "is_weekend", "hour_sin", "hour_cos", "request_count_ma5",
    "request_count_std5", "deviation_ma5", "request_count_ma10",
    "request_count_std10", "deviation_ma10", "request_velocity",
    "request_acceleration", "request_pct_change",
)
# Appended to the list when the log carries the columns.
OPTIONAL_FEATURE_NAMES = ("bot_ratio", "user_agent_diversity")

# The six features a decision is explained with, and their defaults.
EXPLAIN_FEATURES = {
    "requests_per_minute": 0.0,
    "unique_ips": 0.0,
    "error_rate": 0.0,
    "avg_response_time": 0.0,
    "spike_ratio": 1.0,
    "ip_concentration": 1.0,
}

# Defaults of a request feature row when a field is missing.
REQUEST_DEFAULTS = {
    "requests_per_minute": 0,
    "unique_users": 0,
    "unique_ips": 0,
    "error_rate": 0.0,
    "avg_response_time": 0.0,
    "checkout_ratio": 0.0,
    "ip_concentration": 0.0,
    "hour": 0,
    "is_business_hours": 0,
}

# Reason text per feature name.
PRIMARY_REASONS = {
    "requests_per_minute": "Abnormally high request rate",
    "unique_ips": "Suspicious IP distribution",
    "error_rate": "High error rate indicates probing",
    "avg_response_time": "Response time degradation detected",
    "spike_ratio": "Sudden traffic spike detected",
    "ip_concentration": "Traffic concentrated from few IPs",
    "request_variance": "Irregular request pattern",
}
DEFAULT_REASON = "Anomalous behavior detected"


@dataclass(frozen=True)
class SequencePattern:
    """Consecutive requests whose endpoints contain every pattern element.

    ``strict`` counts repeated elements (three logins need three logins); with
    ``strict=False`` one occurrence satisfies all repeats of an element.
    """

    name: str
    endpoints: tuple[str, ...]
    max_time_ms: int
    severity: float
    strict: bool = True


@dataclass(frozen=True)
class ParallelPattern:
    """One endpoint hit ``min_count`` times, all of its hits inside ``max_time_ms``."""

    name: str
    min_count: int
    max_time_ms: int
    severity: float


# The built-in bot patterns.
RAPID_CHECKOUT = SequencePattern(
    "rapid_checkout", ("/api/products", "/api/cart", "/api/checkout"), 100, 0.9)
ENDPOINT_SCANNING = SequencePattern(
    "endpoint_scanning", ("/api/v1/", "/api/v2/", "/admin", "/debug"), 500, 0.95)
PARALLEL_REQUESTS = ParallelPattern("parallel_requests", 10, 100, 0.85)
CREDENTIAL_STUFFING = SequencePattern(
    "credential_stuffing", ("/login", "/login", "/login"), 1000, 0.90)
DEFAULT_PATTERNS = (RAPID_CHECKOUT, ENDPOINT_SCANNING, PARALLEL_REQUESTS, CREDENTIAL_STUFFING)


@dataclass(frozen=True)
class BehaviorConfig:
    history_seconds: int = 60
    # only the newest rows of the history, as a bounded buffer has them; None: all
    max_history: int | None = None
    rapid_gap_seconds: float = 0.1
    # with max_history, users are cut into blocks of this many rows
    block_rows: int = 10_000
    patterns: tuple = DEFAULT_PATTERNS


@dataclass(frozen=True)
class WindowConfig:
    window_seconds: int = 60
    rolling_windows: tuple[int, ...] = (5, 10, 30)
    burst_window: int = 5


@dataclass(frozen=True)
class HeuristicConfig:
    """Additive score: each exceeded threshold adds its weight, capped at 1."""

    spike_ratio: float = 3.0
    ip_concentration: float = 10.0
    error_rate: float = 0.3
    request_count: float = 300.0


@dataclass(frozen=True)
class OnlineHeuristicConfig:
    request_count: float = 200.0
    ip_concentration: float = 20.0
    error_rate: float = 0.5
    user_request_count: float = 100.0


@dataclass(frozen=True)
class LimitConfig:
    """Limit formula parameters; see ``FULL``, ``ONLINE`` and ``SIMPLE``."""

    base_limit: float = 100.0
    min_limit: int = 10
    max_limit: int = 1000
    alpha: float = 0.2
    forecast_weight: float = 0.6
    anomaly_weight: float = 0.4
    fairness_beta: float = 0.3
    flash_sale_multiplier: float = 2.0
    cpu_threshold: float = 80.0
    response_time_threshold: float = 500.0


FULL = LimitConfig()
ONLINE = LimitConfig(alpha=0.3)
SIMPLE = LimitConfig(alpha=0.3, max_limit=500)


@dataclass(frozen=True)
class ForestConfig:
    n_estimators: int = 100
    max_samples: int = 256
    contamination: float = 0.1
    random_state: int = 42


@dataclass(frozen=True)
class LearningConfig:
    learning_rate: float = 0.01
    clamp_step: float = 0.05
    clamp_low: float = 0.2
    clamp_high: float = 0.8


@dataclass(frozen=True)
class ForecastConfig:
    sequence_length: int = 60
    validation_split: float = 0.2
    growth: float = 1.1
    moving_average: int = 10


@dataclass(frozen=True)
class EngineConfig:
    windows: WindowConfig = field(default_factory=WindowConfig)
    behavior: BehaviorConfig = field(default_factory=BehaviorConfig)
    heuristics: HeuristicConfig = field(default_factory=HeuristicConfig)
    limits: LimitConfig = FULL
    forest: ForestConfig = field(default_factory=ForestConfig)
    learning: LearningConfig = field(default_factory=LearningConfig)
    forecast: ForecastConfig = field(default_factory=ForecastConfig)
