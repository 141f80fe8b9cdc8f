"""Limits, weights and names shared by every operator."""

from __future__ import annotations

# The limits and weights below decide every status and score.
PSI_WARNING = 0.10
PSI_DANGER = 0.25
JS_WARNING = 0.10
JS_DANGER = 0.20
PSI_BINS = 10
PSI_MIN_VALUES = 20
PSI_FLOOR = 1e-6
CALIBRATION_BINS = 10
BRIER_RISE = 0.03
MIN_SEGMENT_ROWS = 30
MIN_SEGMENT_CLASS_ROWS = 10
MAX_SEGMENT_GROUPS = 30
MISSING_DANGER = 0.10
MISSING_WARNING = 0.03
HEALTH_WEIGHTS = {
    "quality": 0.15,
    "stability": 0.25,
    "performance": 0.30,
    "reliability": 0.10,
    "segments": 0.20,
}
TARGET_HINTS = (
    "target", "label", "y_true", "outcome", "failure",
    "fraud", "churn", "defect", "price", "score",
)
ID_HINTS = ("id", "uuid", "key", "index", "timestamp", "datetime")

REFERENCE = "reference"
CURRENT = "current"
PERIOD = "period"
MISSING = "(missing)"

STABLE = "stable"
WARNING = "warning"
DANGER = "danger"
INSUFFICIENT = "insufficient"
