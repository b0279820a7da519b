"""Clock expressions: decision points, DST-aware local times, horizons, ages."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000

# Local decision clock per horizon as (days from target, hour).
HORIZON_OFFSETS = {
    "market_open": (-2, 12),
    "previous_evening": (-1, 18),
    "morning_of": (0, 6),
    "hourly_refresh": (0, 9),
}
ISSUE_LAG_HOURS = 6
MIN_LEAD_HOURS = 1.0


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(float(MICROS_PER_HOUR))


def local_decision_time(target_date: Column, horizon: Column) -> Column:
    """Zone-less decision clock of a target day; null for an unknown horizon."""
    days, hour = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (d, h) in HORIZON_OFFSETS.items():
        days = F.when(horizon == name, d).otherwise(days)
        hour = F.when(horizon == name, h).otherwise(hour)
    day = F.date_add(target_date.cast("date"), days)
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), hour, F.lit(0), F.lit(0))


def decision_point(target_date: Column, horizon: Column, zone: Column) -> Column:
    """Struct of decision time, issue time (6 h earlier) and lead hours (at least 1).

    The clock is set in the local zone and then turned into UTC, so it moves
    with daylight saving.
    """
    local = local_decision_time(target_date, horizon)
    decision = F.to_utc_timestamp(local, zone)
    issue = decision - F.expr(f"INTERVAL {ISSUE_LAG_HOURS} HOURS")
    midnight = F.to_utc_timestamp(target_date.cast("timestamp_ntz"), zone)
    lead = F.greatest(hours_between(midnight, decision), F.lit(MIN_LEAD_HOURS))
    return F.struct(decision.alias("decision_time_utc"), issue.alias("issue_time_utc"), lead.alias("lead_hours"))


def local_to_utc(local: Column, zone: Column) -> Column:
    """Local clock time to UTC: ambiguous times are null, missing ones move to the
    first valid instant (whole-hour gaps)."""
    utc = F.to_utc_timestamp(local, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    wall = local.cast("timestamp")
    ambiguous = (F.from_utc_timestamp(utc + hour, zone) == wall) | (F.from_utc_timestamp(utc - hour, zone) == wall)
    gap = F.from_utc_timestamp(utc, zone) != wall
    return F.when(gap, F.date_trunc("hour", utc)).when(~ambiguous, utc)


def local_date(instant: Column, zone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def target_day_distance(target_date: Column, now: Column, zone: Column) -> Column:
    return F.datediff(target_date, local_date(now, zone))


def candidate_horizon(distance: Column, near_term_days: int | None = None) -> Column:
    """Decision horizon by days to the target; none for a past day, or beyond the
    near term where one is given."""
    out = F.when(distance == 0, "morning_of").when(distance == 1, "previous_evening").when(distance >= 2, "market_open")
    return out if near_term_days is None else F.when(distance <= near_term_days, out)


def hours_to_settlement(target_date: Column, now: Column) -> Column:
    """Hours to 23:59:59 UTC of the target day, never negative."""
    end = F.unix_micros(target_date.cast("timestamp")) + F.lit(86_399 * 1_000_000)
    return F.greatest((end - F.unix_micros(now)) / F.lit(float(MICROS_PER_HOUR)), F.lit(0.0))


def age_bucket(hours: Column) -> Column:
    """Listing age: 0-6h, 6-24h, 24-48h, 48h+ or unknown (upper bounds inclusive)."""
    return (
        F.when(hours.isNull(), "unknown")
        .when(hours <= 6, "0-6h")
        .when(hours <= 24, "6-24h")
        .when(hours <= 48, "24-48h")
        .otherwise("48h+")
    )


def earliest(times: Column) -> Column:
    """Earliest parsed time of an array of ISO texts, bad ones ignored."""
    return F.array_min(F.transform(times, lambda t: F.try_to_timestamp(t)))


def opened_at(accepting: Column, created: Column, deploying: Column) -> Column:
    """Opening time: accepting orders, else created, else deploying."""
    return F.coalesce(accepting, created, deploying)


def day_cycle(date: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of year over 366 days."""
    angle = F.lit(2 * math.pi) * F.dayofyear(date) / 366.0
    return F.sin(angle), F.cos(angle)


def fresh(generated_at: Column, now: Column, max_minutes: float) -> Column:
    """Whether a time is at most ``max_minutes`` old."""
    return F.unix_micros(generated_at) >= F.unix_micros(now) - F.lit(int(max_minutes * 60_000_000))
