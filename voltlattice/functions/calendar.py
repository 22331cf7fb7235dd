"""Calendar parts, cyclical encodings, flags and the holiday lookup."""

from pyspark.sql import Column, functions as F

# Public holidays of 2025 used by the demand profiles.
HOLIDAYS_2025 = [
    "2025-01-26", "2025-02-26", "2025-03-14", "2025-03-31", "2025-04-10",
    "2025-04-14", "2025-04-18", "2025-05-01", "2025-06-07", "2025-07-06",
    "2025-08-15", "2025-10-02", "2025-10-20", "2025-11-05", "2025-12-25",
]


def calendar_parts(ts: Column) -> dict[str, Column]:
    """hour, day_of_week (Monday is 0) and month."""
    return {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts)}


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    angle = 2 * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def cyclical_parts(ts: Column) -> dict[str, Column]:
    hour_sin, hour_cos = cyclical(F.hour(ts), 24)
    day_sin, day_cos = cyclical(F.weekday(ts), 7)
    return {"hour_sin": hour_sin, "hour_cos": hour_cos, "day_sin": day_sin, "day_cos": day_cos}


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def flag(condition: Column) -> Column:
    """Boolean (or 0/1) to an integer flag."""
    return condition.cast("int")


def is_holiday(ts: Column, holidays=HOLIDAYS_2025) -> Column:
    """Membership of the calendar date in a fixed list, evaluated as a hash set."""
    return F.date_format(ts, "yyyy-MM-dd").isin(list(holidays))


def hour_of(ts: Column) -> Column:
    """Floor to the hour, kept timezone-naive."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def parse_naive(text: Column) -> Column:
    """Parse a time string, drop any offset keeping the wall clock, NULL when unparseable."""
    return F.trim(text).try_cast("timestamp_ntz")
