"""Column functions that turn scores into classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    stable: float
    moderate: float


#: Calibrated pair, pair without calibration (inverted, as published), narrow-band pair.
WIDE_BAND = Thresholds(0.46550, 0.38407)
UNCALIBRATED = Thresholds(0.3277, 0.5059)
NARROW_BAND = Thresholds(0.4829, 0.3788)
#: Class names and what to do about them.
ACTIONS = {
    "STABLE": "Same location",
    "MODERATE_DRIFT": "Ambiguous zone — borderline, recommend recheck",
    "RELOCATION_OR_FRAUD": "Likely different location",
}
FOUR = ("Stable Environment", "Minor Drift", "Significant Drift", "Relocated / Fraud Suspected")
LOW_CONFIDENCE = "LOW — scores too close to call reliably"
UNKNOWN = "UNKNOWN_NEW_LOCATION"


def drift_class(score: Column, stable: Column | float, moderate: Column | float) -> Column:
    """Three classes by the larger and the smaller threshold, whichever is which; strict."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (stable, moderate))
    return F.when(score > F.greatest(a, b), "STABLE").when(score > F.least(a, b), "MODERATE_DRIFT").otherwise("RELOCATION_OR_FRAUD")


def drift_class_in_order(score: Column, stable: Column | float = NARROW_BAND.stable, moderate: Column | float = NARROW_BAND.moderate) -> Column:
    """Three classes by stable first, then moderate; differs from drift_class where they are inverted."""
    return F.when(score > stable, "STABLE").when(score > moderate, "MODERATE_DRIFT").otherwise("RELOCATION_OR_FRAUD")


def drift_class_four(score: Column) -> Column:
    """Four classes of the first generation; inclusive."""
    return F.when(score >= 0.92, FOUR[0]).when(score >= 0.80, FOUR[1]).when(score >= 0.65, FOUR[2]).otherwise(FOUR[3])


def drift_action(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[status]


def confidence(margin: Column) -> Column:
    """HIGH above 0.15, MODERATE above 0.05, else low; null for a null margin (one location only)."""
    return F.when(margin.isNull(), F.lit(None)).when(margin > 0.15, "HIGH").when(margin > 0.05, "MODERATE").otherwise(LOW_CONFIDENCE)


def open_set(status: Column, match: Column) -> Column:
    """The match, unless the status says that it is none of the known locations."""
    return F.when(status == "RELOCATION_OR_FRAUD", UNKNOWN).otherwise(match)


#: Fixed value: what is said of a recording that no known location explains.
NEW_LOCATION = (
    "This audio doesn't match any of the %d known locations well enough (closest guess was '%s', score=%.4f). "
    "It may be a NEW location not yet in the system, rather than one of the existing ones."
)


def open_set_message(status: Column, match: Column, score: Column, known: Column) -> Column:
    """Why a match was not accepted; null where it was."""
    return F.when(status == "RELOCATION_OR_FRAUD", F.format_string(NEW_LOCATION, known, match, score))


def environment_rule(level: Column, quiet: Column | float, noisy: Column | float) -> Column:
    """quiet at or below the one, noisy at or above the other, else moderate."""
    return F.when(level <= quiet, "quiet").when(level >= noisy, "noisy").otherwise("moderate")
