"""Job parameters with their defaults and validation; fixed texts and lists."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime

# Signal order, weights and thresholds.
SIGNALS = ("freq", "churn", "recency", "authors", "ownership", "coupling")
WEIGHTS = {"freq": 0.22, "churn": 0.18, "recency": 0.20, "authors": 0.10, "ownership": 0.15, "coupling": 0.15}
THRESHOLDS = {"medium": 25.0, "high": 50.0, "critical": 75.0}
SEVERITIES = ("low", "medium", "high", "critical")

# Paths excluded by default.
EXCLUDE = (
    "**/node_modules/**",
    "**/dist/**",
    "**/build/**",
    "**/out/**",
    "**/*.min.js",
    "**/*.bundle.js",
    "**/*.map",
    "**/vendor/**",
    "**/*.lock",
    "**/package-lock.json",
    "**/yarn.lock",
    "**/pnpm-lock.yaml",
)

# Texts of explanations and reports.
PHRASES = {
    "freq": "changes very frequently",
    "churn": "has a lot of code churn",
    "recency": "was changed recently",
    "authors": "has many contributors",
    "ownership": "has fragmented ownership",
    "coupling": "is coupled to other files",
}
CAVEAT = "Relative ranking within this repo — not a probability, and can shift scan-to-scan."
LOW_CONFIDENCE = "⚠ Low confidence — thin git history; rankings may be noisy."
TREND_LABELS = {"rising": "↑ rising", "stable": "→ stable", "cooling": "↓ cooling"}
TREND_ARROWS = {"rising": "↑", "stable": "→", "cooling": "↓"}
TIER_BADGES = {"critical": "!!", "high": "!", "medium": "·"}


def _number(value) -> float | None:
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    return float(value) if ok else None


def merged(defaults: dict[str, float], given) -> dict[str, float]:
    """The defaults with those given values that are finite numbers of 0 or more; unknown keys are left out."""
    given = given if isinstance(given, dict) else {}
    good = {k: v for k in defaults if (v := _number(given.get(k))) is not None and v >= 0}
    return defaults | good


def months(value) -> int:
    """History window in whole months; 0, all of it, for anything but a finite number of 0 or more."""
    n = _number(value)
    return int(n) if n is not None and n >= 0 else 0


def globs(value) -> tuple[str, ...]:
    return tuple(g for g in value if isinstance(g, str)) if isinstance(value, (list, tuple)) else EXCLUDE


def severity(value) -> str:
    return value if value in SEVERITIES else "medium"


@dataclass(frozen=True)
class Params:
    """Parameters of a scan as they are; Params.of() replaces what is out of range by the default."""

    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    since_months: int = 0
    as_of: str | datetime | None = None  # the end of the history window
    exclude: tuple = EXCLUDE
    max_files_per_commit: int = 50
    min_support: int = 5
    top_k: int = 5
    minor_threshold: float = 0.05
    half_life_days: float = 365.0
    recent_days: float = 90.0
    spaces_per_indent: int = 4
    min_depth: int = 3
    min_lines: int = 3
    hint_floor: float = 0.3
    top_n: int = 20
    min_severity: str = "medium"
    explain: bool = True

    @classmethod
    def of(cls, **given) -> Params:
        rules = {
            "weights": lambda v: merged(WEIGHTS, v), "thresholds": lambda v: merged(THRESHOLDS, v), "since_months": months, "exclude": globs, "min_severity": severity,
            "spaces_per_indent": lambda v: v if (_number(v) or 0) > 0 else 4, "top_n": lambda v: max(1, int(_number(v) or 20)),
        }
        return cls(**{k: rules[k](v) if k in rules else v for k, v in given.items()})
