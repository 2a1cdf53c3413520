"""Dates, ratios and trend arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnflow.functions.checks import number_within
from cairnflow.schemas import CHANGE_THRESHOLD, GRANULARITIES

# Fixed value: an ISO-8601 date and time that carries an offset.
OFFSET_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)$"


# Years 1 to 9999, the range of a timestamp.
EPOCH_RANGE = (-62135596800, 253402300799)


def epoch_timestamp(seconds: Column) -> Column:
    """NULL outside of the years 1 to 9999 (as for milliseconds or microseconds given by mistake)."""
    return F.when(seconds.between(*EPOCH_RANGE), F.timestamp_seconds(seconds))


def iso_timestamp(text: Column) -> Column:
    """A timestamp from an ISO string with an offset; naive or malformed text gives NULL."""
    # "+0200" is written "+02:00" so that the cast accepts it, and a decimal comma becomes a dot.
    spelled = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(OFFSET_TIMESTAMP), F.try_to_timestamp(spelled))


def period_start(timestamp: Column, granularity: str) -> Column:
    """First instant of the UTC day, Monday week or month (session time zone UTC)."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    return F.date_trunc(granularity, timestamp)


def ratio(numerator: Column, denominator: Column) -> Column:
    """A division that is 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def growth_rate(current: Column, previous: Column) -> Column:
    """Relative change, NULL when there was nothing before."""
    return F.try_divide((current - previous).cast("double"), previous.cast("double"))


def validate_change_threshold(threshold: float) -> float:
    return number_within(threshold, "change_threshold", 0)


def trend_status(
    matched: Column, change: Column, growth: Column, threshold: float = CHANGE_THRESHOLD
) -> Column:
    """new / rising / falling / stable; a change equal to the threshold is stable."""
    return (
        F.when(~matched, "new")
        .when(growth.isNull(), F.when(change > 0, "rising").otherwise("stable"))
        .when(growth > threshold, "rising")
        .when(growth < -threshold, "falling")
        .otherwise("stable")
    )


def growth_score(
    status: Column,
    growth: Column,
    max_rising_growth: Column,
    new_score: float = 0.75,
    stable_score: float = 0.25,
) -> Column:
    return (
        F.when(status == "new", F.lit(float(new_score)))
        .when((status == "rising") & (growth > 0), ratio(growth, max_rising_growth))
        .when(status == "stable", F.lit(float(stable_score)))
        .otherwise(F.lit(0.0))
    )
