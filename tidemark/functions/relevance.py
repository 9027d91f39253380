"""Temporal relevance and outlink scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
METHODS = ("CONTENT", "CONTENT_AND_TIME", "CONTENT_AND_TIME_EXP", "TIME", "TIME_EXP", "UNFOCUSED")
GATE, WEIGHT = 0.25, 0.5


@dataclass(frozen=True)
class Interval:
    """An event from ``start`` to ``end`` (dates) with half-lives in days before and after it."""

    start: str
    end: str
    before: int
    after: int

    @classmethod
    def after_date(cls, start: str, days: int) -> Interval:
        return cls(start, "9999-12-31", days, days)


def _ms(when: Column) -> Column:
    return F.unix_micros(when.cast("timestamp")) / F.lit(1000.0)


def _bounds(interval: Interval) -> tuple[Column, Column]:
    return _ms(F.lit(interval.start)), _ms(F.lit(interval.end))


def contains(when: Column, interval: Interval) -> Column:
    start, end = _bounds(interval)
    return F.coalesce((_ms(when) > start) & (_ms(when) < end), F.lit(False))


def half_life_between(when: Column, start: Column, end: Column, before: Column, after: Column, clamp: bool = True) -> Column:
    """1 inside (start, end), halved every ``before`` days before the start and every ``after`` days after the end's day."""
    t, start, end = _ms(when), _ms(start), _ms(end)

    def decay(distance: Column, days: Column) -> Column:
        value = F.exp(-distance / (days * F.lit(float(DAY_MS))) * F.log(F.lit(2.0)))
        return F.when(days > 0, value).otherwise(F.when(distance > 0, 0.0).otherwise(1.0))

    value = F.when((t > start) & (t < end), 1.0).when(t < start, decay(start - t, before)).otherwise(decay(t - (end + DAY_MS), after))
    return F.when(t.isNull(), 1.0).otherwise(F.least(F.lit(1.0), value) if clamp else value)


def half_life(when: Column, interval: Interval, clamp: bool = True) -> Column:
    return half_life_between(when, F.lit(interval.start), F.lit(interval.end), F.lit(interval.before), F.lit(interval.after), clamp)


def stepwise(when: Column, interval: Interval) -> Column:
    """exp(-n), n whole pairs of days away from the interval."""
    t, (start, end) = F.unix_millis(when.cast("timestamp")), (F.unix_millis(F.lit(x).cast("timestamp")) for x in (interval.start, interval.end))
    away = F.when(t < start, start - t).otherwise(t - (end + DAY_MS))
    whole = (away / F.lit(float(2 * DAY_MS))).cast("long")
    return F.when(t.isNull(), 1.0).when((t > start) & (t < end), 1.0).otherwise(F.exp(-whole.cast("double")))


def time_relevance(method: str, when: Column, interval: Interval) -> Column:
    return half_life(when, interval) if method in ("TIME", "CONTENT_AND_TIME") else stepwise(when, interval)


def outlink_score(method: str, similarity: Column, time: Column, gate: float = GATE, weight: float = WEIGHT, clamp: bool = True) -> Column:
    if method not in METHODS or not 0 <= weight <= 1:
        raise ValueError(f"unknown method {method!r} or weight {weight} outside [0, 1]")
    if method == "CONTENT":
        score = similarity
    elif method.startswith("CONTENT_AND_TIME"):
        score = F.when(similarity > gate, similarity * weight + time * (1 - weight)).otherwise(similarity)
    elif method.startswith("TIME"):
        score = time
    else:
        score = F.lit(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)) if clamp else score
