"""Service-day clock arithmetic. Instants are TIMESTAMP in a UTC session.

Service-day values are wall-clock differences in the agency's zone, so a day with a clock
change is not stretched, and they may exceed one day for trips that run past midnight.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopclock.fixed import GRACE_AFTER_SECONDS, GRACE_BEFORE_SECONDS, SERVICE_TZ


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_to_instant(c: Column | str) -> Column:
    """Epoch seconds to an instant; absent and 0 (and below) are no value."""
    value = _col(c)
    return F.when(value > 0, F.timestamp_seconds(value))


def micros(c: Column | str) -> Column:
    return F.unix_micros(_col(c))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """`end - start` in seconds, with its fraction."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def rounded(us: Column, unit_us: int) -> Column:
    """Micros in whole units, rounded half away from zero.

    Done on whole numbers: rounding a double goes through big decimals, row by row.
    """
    return (F.floor((F.abs(us) + unit_us // 2) / unit_us) * F.signum(us)).cast("int")


def plus_seconds(instant: Column | str, seconds: Column | float | int) -> Column:
    shift = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(micros(instant) + F.floor(shift.cast("double") * 1_000_000 + 0.5))


def wall_clock(instant: Column | str, tz: str = SERVICE_TZ) -> Column:
    return F.from_utc_timestamp(_col(instant), tz)


def local_date(instant: Column | str, tz: str = SERVICE_TZ) -> Column:
    return F.to_date(wall_clock(instant, tz))


def micros_into_service_day(instant: Column | str, day: Column | str, tz: str = SERVICE_TZ) -> Column:
    return micros(wall_clock(instant, tz)) - micros(_col(day).cast("timestamp"))


def seconds_into_service_day(instant: Column | str, day: Column | str, tz: str = SERVICE_TZ) -> Column:
    return micros_into_service_day(instant, day, tz) / F.lit(1e6)


def service_minute(instant: Column | str, day: Column | str, tz: str = SERVICE_TZ) -> Column:
    """Rounded half away from zero, not truncated."""
    return rounded(micros_into_service_day(instant, day, tz), 60_000_000)


def hour_bin(instant: Column | str, day: Column | str, tz: str = SERVICE_TZ) -> Column:
    """Rounded half away from zero, so 12:30 falls in bin 13."""
    return rounded(micros_into_service_day(instant, day, tz), 3_600_000_000)


def is_weekend(day: Column | str) -> Column:
    return F.weekday(_col(day)) >= 5


def minute_of_day(instant: Column | str, tz: str = SERVICE_TZ) -> Column:
    local = wall_clock(instant, tz)
    return F.hour(local) * 60 + F.minute(local)


def scheduled_instant(day: Column | str, seconds: Column | str, tz: str = SERVICE_TZ) -> Column:
    """Service midnight plus a wall-clock offset, as an instant."""
    return F.to_utc_timestamp(plus_seconds(_col(day).cast("timestamp"), _col(seconds)), tz)


def delay_seconds(instant: Column | str, day: Column | str, scheduled: Column | str, tz: str = SERVICE_TZ) -> Column:
    return seconds_into_service_day(instant, day, tz) - _col(scheduled)


def known_at(arrived: Column | str, gap: Column | str) -> Column:
    """An inferred arrival exists only once the later bracketing ping has come in."""
    return plus_seconds(arrived, F.coalesce(_col(gap), F.lit(0)))


def prediction_instant(arrived: Column, horizon: Column, known: Column, anchor: Column) -> Column:
    """The scored cutoff where there is one, else when the anchor became known, else the anchor."""
    return F.coalesce(plus_seconds(arrived, -horizon * 60), known, anchor)


def signed_error(predicted: Column | str, actual: Column | str) -> Column:
    return rounded(micros(predicted) - micros(actual), 1_000_000)


def clamp_to_cutoff(anchor: Column, remaining: Column, cutoff: Column, clamp: bool = True) -> Column:
    """Arrival from a predicted travel time, never before the moment of prediction."""
    arrival = plus_seconds(anchor, F.greatest(remaining, F.lit(0.0)))
    return F.greatest(arrival, cutoff) if clamp else arrival


def resolve_service_day(
    instant: Column | str,
    first: Column | str,
    last: Column | str,
    before: int = GRACE_BEFORE_SECONDS,
    after: int = GRACE_AFTER_SECONDS,
    tz: str = SERVICE_TZ,
) -> Column:
    """Today when the trip's window fits, else yesterday when that fits, else today."""
    today = local_date(instant, tz)
    yesterday = F.date_sub(today, 1)
    low, high = _col(first) - before, _col(last) + after
    return (
        F.when(seconds_into_service_day(instant, today, tz).between(low, high), today)
        .when(seconds_into_service_day(instant, yesterday, tz).between(low, high), yesterday)
        .otherwise(today)
    )


def feed_service_day(text: Column | str, observed: Column | str, tz: str = SERVICE_TZ) -> Column:
    """The feed's own start_date where it parses, else the local date of the observation."""
    value = _col(text)
    return F.coalesce(F.try_to_date(F.nullif(value, F.lit("")), "yyyyMMdd"), local_date(observed, tz))
