"""Job parameters. The defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

FEATURE_COLS = ("f_total_events_7d", "f_avg_session_sec_7d", "f_last_event_age_sec")
LABEL_COL = "label"
ENTITY_COL = "user_id"
TIME_COL = "event_timestamp"

REQUESTS_METRIC = "http_requests_total"
LATENCY_METRIC = "http_request_duration_highres_seconds_bucket"
UP_METRIC = "up"

# Raw event text carries no zone; it is a wall clock at this offset.
WALL_CLOCK_OFFSET = "+09:00"
FULL_REFRESH_START = "2026-01-01T00:00:00"


@dataclass(frozen=True)
class LabelRule:
    high_min_events: int = 4
    high_min_avg_sec: float = 300.0
    low_max_events: int = 1
    low_max_avg_sec: float = 30.0


@dataclass(frozen=True)
class QualityLimits:
    min_rows: int = 50
    min_classes: int = 2


@dataclass(frozen=True)
class DriftLimits:
    ks_threshold: float = 0.20
    sample_n: int | None = None
    max_columns: int | None = None
    min_values: int = 50
    seed: int = 42


@dataclass(frozen=True)
class TrainLimits:
    min_rows: int = 20
    min_classes: int = 2
    min_class_rows: int = 3
    test_size: float = 0.2
    seed: int = 42
    accuracy_threshold: float = 0.60
    C: float = 1.0
    max_iter: int = 200


@dataclass(frozen=True)
class RollbackLimits:
    min_up: float = 1.0
    max_5xx_ratio: float = 0.02
    max_5xx_rps: float = 1.0
    max_p95_sec: float = 0.8
    error_window_sec: int = 60
    latency_window_sec: int = 300
    lookback_sec: int = 300
    escalate_after: int = 3
    converge_min_pods: int = 2
    missing_errors_as_zero: bool = False


@dataclass(frozen=True)
class EvalGrid:
    """Evaluation instants start, start+step, ..., end, in epoch microseconds."""

    start_us: int
    end_us: int
    step_us: int = 15_000_000

    @property
    def last(self) -> int:
        return (self.end_us - self.start_us) // self.step_us

    @classmethod
    def at(cls, instant_us: int) -> "EvalGrid":
        return cls(instant_us, instant_us)


@dataclass(frozen=True)
class RunSource:
    """Where the rows of a training run come from, as recorded with the run."""

    feature_uri: str
    fs_version: str | None = None
    schema_hash: str | None = None
    env: str | None = None
    code_version: str | None = None
