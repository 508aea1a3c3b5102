"""Settings of the detectors, correlation and scoring: frozen dataclasses, changed with ``dataclasses.replace``.

Each part of the library takes the whole ``AnalyzerConfig`` or its own block.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import datetime
from typing import TypeVar

#: Names and paths that the insider and risk rules know.
PRIVILEGED = ("admin", "root", "administrator")
SENSITIVE = ("/admin", "/config", "/secret", "/backup", "/.env", "/etc")


# Names and defaults of all settings.
@dataclass(frozen=True)
class BruteForceConfig:
    enabled: bool = True
    failed_attempt_threshold: int = 5
    window_seconds: int = 120


@dataclass(frozen=True)
class PasswordSprayConfig:
    enabled: bool = True
    unique_user_threshold: int = 5
    window_seconds: int = 120


@dataclass(frozen=True)
class SqlInjectionConfig:
    enabled: bool = True


@dataclass(frozen=True)
class XssConfig:
    enabled: bool = True


@dataclass(frozen=True)
class ImpossibleTravelConfig:
    enabled: bool = True
    max_plausible_speed_kmh: float = 900.0


@dataclass(frozen=True)
class InsiderThreatConfig:
    """unusual_hour_start to unusual_hour_end (exclusive, may pass midnight; equal: none)."""

    enabled: bool = True
    unusual_hour_start: int = 0
    unusual_hour_end: int = 5
    activity_threshold: int = 20
    alert_score_threshold: int = 50
    privileged_users: tuple[str, ...] = PRIVILEGED
    sensitive_path_prefixes: tuple[str, ...] = SENSITIVE
    score_privileged: int = 30
    score_unusual_hour: int = 20
    score_unusual_ip: int = 20
    score_high_activity: int = 20
    score_sensitive_resource: int = 20


@dataclass(frozen=True)
class CorrelationConfig:
    enabled: bool = True
    window_seconds: int = 300
    correlate_by_ip: bool = True
    correlate_by_user: bool = True


@dataclass(frozen=True)
class RiskScoringConfig:
    enabled: bool = True
    base_low: int = 20
    base_medium: int = 40
    base_high: int = 70
    base_critical: int = 90
    multiple_alert_bonus: int = 10
    multiple_attack_type_bonus: int = 10
    repeated_activity_bonus: int = 5
    privileged_user_bonus: int = 5
    high_confidence_bonus: int = 3
    high_confidence_threshold: float = 0.85
    privileged_users: tuple[str, ...] = PRIVILEGED


@dataclass(frozen=True)
class AnomalyConfig:
    enabled: bool = True
    contamination: float = 0.05
    n_estimators: int = 100
    random_state: int = 42
    minimum_samples: int = 20
    alert_threshold: float = 70.0
    unusual_hour_start: int = 0
    unusual_hour_end: int = 5
    include_user_entities: bool = True


@dataclass(frozen=True)
class AnalyzerConfig:
    """default_log_year dates lines whose format names no year."""

    brute_force: BruteForceConfig = field(default_factory=BruteForceConfig)
    password_spray: PasswordSprayConfig = field(default_factory=PasswordSprayConfig)
    sql_injection: SqlInjectionConfig = field(default_factory=SqlInjectionConfig)
    xss: XssConfig = field(default_factory=XssConfig)
    impossible_travel: ImpossibleTravelConfig = field(default_factory=ImpossibleTravelConfig)
    insider_threat: InsiderThreatConfig = field(default_factory=InsiderThreatConfig)
    anomaly: AnomalyConfig = field(default_factory=AnomalyConfig)
    correlation: CorrelationConfig = field(default_factory=CorrelationConfig)
    risk_scoring: RiskScoringConfig = field(default_factory=RiskScoringConfig)
    default_log_year: int = field(default_factory=lambda: datetime.now().year)
    default_timezone: str = "UTC"


T = TypeVar("T")


def block(config: AnalyzerConfig | T | None, kind: type[T]) -> T:
    """The block of type ``kind``: ``config`` itself, that block of a whole configuration, or the defaults for None."""
    if isinstance(config, kind):
        return config
    if config is None:
        return kind()
    return next(v for f in fields(config) if isinstance(v := getattr(config, f.name), kind))
