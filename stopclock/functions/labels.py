"""Bands, labels and small report values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopclock.fixed import (
    COVERAGE_CRITICAL_PCT,
    COVERAGE_WARN_PCT,
    MEANINGFUL_CORRECTION_SECONDS,
    MIN_ROUTE_SAMPLE,
    MIN_STOP_ROUTE_SAMPLE,
    SOURCES,
    TIME_BANDS,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def checked_source(source: str) -> str:
    if source not in SOURCES:
        raise ValueError(f"unknown predictor {source!r}, expected one of {', '.join(SOURCES)}")
    return source


def checked_band(band: str) -> str:
    if band not in TIME_BANDS:
        raise ValueError(f"unknown time band {band!r}, expected one of {', '.join(TIME_BANDS)}")
    return band


def in_time_band(minute: Column | str, band: str) -> Column:
    bounds = TIME_BANDS[checked_band(band)]
    if bounds is None:
        return F.lit(True)
    value, (low, high) = _col(minute), bounds
    after, before = value >= low, value < high
    return (after & before) if low < high else (after | before)


def time_band(minute: Column | str) -> Column:
    """The one band a service minute falls in."""
    value = F.when(F.lit(False), F.lit(""))
    for name, bounds in TIME_BANDS.items():
        if bounds is not None:
            value = value.when(in_time_band(minute, name), F.lit(name))
    return value


def label_quality(gap: Column | str, names: str = "script") -> Column:
    """Band of the ping gap behind an arrival; `names` picks the report or the page spelling."""
    text = {
        # Band names as the report and the page spell them.
        "script": ("unknown", "tight (<= 60s)", "ok (<= 3min)", "loose (<= 10min)", "poor (> 10min)"),
        "page": ("unknown", "tight (<=60s)", "ok (<=3min)", "loose (<=10min)", "poor (>10min)"),
    }[names]
    value = _col(gap)
    return (
        F.when(value.isNull(), text[0])
        .when(value <= 60, text[1])
        .when(value <= 180, text[2])
        .when(value <= 600, text[3])
        .otherwise(text[4])
    )


def three_hour_block(minute: Column | str) -> Column:
    return F.expr("{} div 180".format(minute)) if isinstance(minute, str) else F.floor(minute / 180)


def three_hour_label(block: Column | str) -> Column:
    start = _col(block) * 3
    return F.concat(start.cast("string"), F.lit(":00-"), (start + 3).cast("string"), F.lit(":00"))


def day_type(weekend: Column | str) -> Column:
    return F.when(_col(weekend), "weekend").otherwise("weekday")


def in_minutes(seconds: Column | str) -> Column:
    return F.round(_col(seconds) / 60, 2)


def horizon_label(horizon: Column | str) -> Column:
    return F.concat(_col(horizon).cast("string"), F.lit(" min"))


def schedule_status(valid_until: Column | str, as_of: Column | str) -> Column:
    end, today = _col(valid_until), _col(as_of)
    return (
        F.when(end.isNull(), "NO SCHEDULE LOADED")
        .when(end < today, "EXPIRED: reload needed")
        .when(end < F.date_add(today, 14), "expires within 2 weeks")
        .otherwise("current")
    )


def coverage_status(pct: Column | str) -> Column:
    value = _col(pct)
    return (
        F.when(value.isNull() | F.isnan(value), "unknown")
        .when(value < COVERAGE_CRITICAL_PCT, "critical")
        .when(value < COVERAGE_WARN_PCT, "warning")
        .otherwise("good")
    )


def choose_bias(
    pair_n: Column,
    pair_bias: Column,
    route_n: Column,
    route_bias: Column,
    min_pair: int = MIN_STOP_ROUTE_SAMPLE,
    min_route: int = MIN_ROUTE_SAMPLE,
) -> Column:
    """struct(bias, basis, sample) of the most specific level with enough evidence."""
    use_pair = pair_bias.isNotNull() & (pair_n >= min_pair)
    use_route = route_bias.isNotNull() & (route_n >= min_route)
    return F.struct(
        F.when(use_pair, pair_bias).when(use_route, route_bias).alias("bias"),
        F.when(use_pair, "stop_and_route").when(use_route, "route").otherwise("none").alias("basis"),
        F.when(use_pair, pair_n).when(use_route, route_n).alias("sample"),
    )


def correction_is_meaningful(correction: Column | str) -> Column:
    return F.coalesce(F.abs(_col(correction)) >= MEANINGFUL_CORRECTION_SECONDS, F.lit(False))


def hash_percent(*parts: Column) -> Column:
    """A stable 0..99 from text parts; equal wherever md5 is available."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % 100


def name_contains(name: Column | str, query: str) -> Column:
    """Case-insensitive contains, at least two characters. `%` and `_` act as in LIKE."""
    if len(query) < 2:
        raise ValueError("a search needs at least two characters")
    return _col(name).ilike(f"%{query}%")


def cut_error(text: Column | str, limit: int) -> Column:
    """Long error text is cut and marked."""
    value = _col(text)
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))).otherwise(value)
