"""Column expressions over zone-less timestamps. None of them depends on the session time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from tidemark.settings import BusinessHours

MICROS = 1_000_000


def ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds from ``start`` to ``end``, negative when time runs backwards."""
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return (seconds * F.lit(MICROS)).cast("bigint")


def epoch_micros(ts: Column) -> Column:
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def seconds(micros: Column) -> Column:
    return micros / F.lit(float(MICROS))


def text_stamp(ts: Column, separator: str = " ") -> Column:
    """``2024-10-14 10:00:00``, followed by six fraction digits when there is a fraction."""
    text = ts.cast("string")
    padded = F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)
    return padded if separator == " " else F.concat(F.substring(padded, 1, 10), F.lit(separator), F.substring(padded, 12, 15))


def severity(micros: Column) -> Column:
    """HIGH above one hour, MEDIUM above five minutes, else LOW."""
    return (
        F.when(micros > 3600 * MICROS, "HIGH").when(micros > 300 * MICROS, "MEDIUM").otherwise("LOW")
    )


def outside_business_hours(start: Column, end: Column, hours: BusinessHours) -> Column:
    """A gap that ends before opening or starts after closing; dates in between do not matter."""
    minute = lambda ts: F.hour(ts) * 60 + F.minute(ts)
    past_the_minute = F.extract(F.lit("SECOND"), start) > 0
    outside = (
        (minute(end) < hours.open_minute)
        | (minute(start) > hours.close_minute)
        | ((minute(start) == hours.close_minute) & past_the_minute)
    )
    if hours.ignore_weekends:
        outside = ((F.weekday(start) >= 5) & (F.weekday(end) >= 5)) | outside
    return outside


def inside_any(start: Column, end: Column, intervals) -> Column:
    """True when the span lies within one of a short list of literal intervals, ends included."""
    inside = F.lit(False)
    for low, high in intervals:
        inside = inside | ((start >= ntz(low)) & (end <= ntz(high)))
    return inside


def human_duration(micros: Column) -> Column:
    """``1d 2h 3m 4s`` without its zero parts; ``0s`` for less than a second."""
    total = F.expr("cast(0 as bigint)") + (micros / F.lit(MICROS)).cast("bigint")
    part = lambda value, unit: F.when(value > 0, F.concat(value.cast("string"), F.lit(unit)))
    day = F.floor(total / 86400)
    hour = F.floor(F.pmod(total, F.lit(86400)) / 3600)
    minute = F.floor(F.pmod(total, F.lit(3600)) / 60)
    text = F.concat_ws(" ", part(day, "d"), part(hour, "h"), part(minute, "m"), part(F.pmod(total, F.lit(60)), "s"))
    return F.when(text == "", "0s").otherwise(text)
