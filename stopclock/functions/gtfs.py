"""Parsing of schedule text values.

Every parser has a strict form, which fails the job naming the value, and a lenient form
(`strict=False`), which yields null so a report can count the rejects.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopclock.fixed import METRES_PER_MILE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _refuse(message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message + ", got '"), value, F.lit("'")))


def _guarded(value: Column, text: Column, valid: Column, parsed: Column, message: str, strict: bool) -> Column:
    blank = value.isNull() | (text == "")
    result = F.when(blank, F.lit(None)).when(valid, parsed)
    return result.otherwise(_refuse(message, value)) if strict else result


def optional_text(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def required(c: Column | str, source: str, name: str) -> Column:
    text = optional_text(c)
    return F.when(text.isNotNull(), text).otherwise(
        F.raise_error(F.lit(f"{source}: required column {name} is missing or empty"))
    )


def optional_int(c: Column | str, strict: bool = True) -> Column:
    value = _col(c)
    text = F.trim(value)
    parsed = text.try_cast("int")
    return _guarded(value, text, parsed.isNotNull(), parsed, "expected an integer", strict)


def optional_float(c: Column | str, strict: bool = True) -> Column:
    value = _col(c)
    text = F.trim(value)
    parsed = text.try_cast("double")
    return _guarded(value, text, parsed.isNotNull(), parsed, "expected a number", strict)


def time_to_seconds(c: Column | str, strict: bool = True) -> Column:
    """HH:MM:SS to seconds past service midnight. Hours have no upper bound."""
    value = _col(c)
    text = F.trim(value)
    valid = text.rlike(r"^[0-9]+:0*[0-5]?[0-9]:0*[0-5]?[0-9]$")
    hours, minutes, seconds = (F.split_part(text, F.lit(":"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return _guarded(
        value, text, valid, hours * 3600 + minutes * 60 + seconds, "expected HH:MM:SS", strict
    )


def miles_to_metres(c: Column | str, strict: bool = True) -> Column:
    value = _col(c).cast("string")
    miles = F.trim(value).try_cast("double")
    result = F.when(value.isNull() | (value == ""), F.lit(None)).when(
        miles >= 0, miles * F.lit(METRES_PER_MILE)
    )
    if not strict:
        return result
    return result.when(miles < 0, _refuse("distance cannot be negative", value)).otherwise(
        _refuse("expected a number of miles", value)
    )


def gtfs_date(c: Column | str, strict: bool = True) -> Column:
    """Exactly eight digits."""
    value = _col(c)
    text = F.trim(value)
    parsed = F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))
    return _guarded(value, text, parsed.isNotNull(), parsed, "expected YYYYMMDD", strict)


def service_flag(c: Column | str) -> Column:
    return F.coalesce(F.trim(_col(c)) == "1", F.lit(False))
