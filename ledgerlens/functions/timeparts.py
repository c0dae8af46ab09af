"""Calendar parts and exact time arithmetic on transaction times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that results depend on.
OFFICE_HOURS = (9, 18)
BUSINESS_DAYS = (1, 5)
HIGH_SEASON_MONTHS = (1, 6, 7, 12)
WEEKDAY_NAMES = ("lun", "mar", "mie", "jue", "vie", "sab", "dom")
LONG_SESSION_MICROS = 3_600_000_000


def day_of_week(ts: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(ts) - 1


def in_office_hours(ts: Column) -> Column:
    return F.hour(ts).between(*OFFICE_HOURS)


def on_business_day(ts: Column) -> Column:
    return day_of_week(ts).between(*BUSINESS_DAYS)


def in_high_season(ts: Column) -> Column:
    return F.month(ts).isin(*HIGH_SEASON_MONTHS)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch; needs a UTC session for zone-less times."""
    return F.unix_micros(ts.cast("timestamp"))


LOW_BITS = 26


def time_sums(micros: Column) -> dict[str, Column]:
    """Aggregates from which ``mean_of_sums`` takes the mean, on their own or summed again.

    High and low bits are summed apart as whole numbers. So the result is exact
    in any row order, and neither sum overflows below a hundred billion rows.
    """
    return {
        "high_bits": F.sum(F.shiftright(micros, LOW_BITS)),
        "low_bits": F.sum(micros.bitwiseAND(F.lit((1 << LOW_BITS) - 1))),
        "n_times": F.count(micros),
    }


def mean_of_sums(high: Column, low: Column, n: Column) -> Column:
    """Mean time to the nearest microsecond, NULL without times."""
    total = high.cast("decimal(20,0)") * (1 << LOW_BITS) + low.cast("decimal(20,0)")
    mean = F.try_divide(total, n.cast("decimal(20,0)"))
    return F.timestamp_micros(F.round(mean, 0).cast("bigint"))


def mean_time(ts: Column) -> Column:
    """Aggregate: mean time to the nearest microsecond, NULL without times."""
    return mean_of_sums(*time_sums(epoch_micros(ts)).values())


def micros_to_seconds(total: Column, n: Column) -> Column:
    """Mean in seconds from a sum of microseconds; NULL when ``n`` is 0."""
    return F.try_divide(total.cast("double"), n * F.lit(1e6))


def count_if(condition: Column) -> Column:
    """Aggregate: rows where the condition holds (NULL counts as not holding)."""
    return F.sum(F.when(condition, 1).otherwise(0))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, NULL for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
