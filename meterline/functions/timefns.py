"""Date, time and duration column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone abbreviations a scheduler prints, and their UTC offset in hours.
ZONE_OFFSET_HOURS = {
    "GMT": 0,
    "UTC": 0,
    "EST": -5,
    "EDT": -4,
    "CST": -6,
    "CDT": -5,
    "PST": -8,
    "PDT": -7,
}


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def epoch_seconds(col) -> Column:
    """Whole epoch seconds of a timestamp (with or without zone); sub-seconds are cut."""
    return F.unix_timestamp(_col(col))


def epoch_millis(col) -> Column:
    """Epoch milliseconds of a zoned timestamp."""
    return F.unix_millis(_col(col).cast("timestamp"))


def zoned_text_to_epoch(col) -> Column:
    """``Fri, 10 Aug 2018 16:10:23 EDT`` to epoch seconds.

    An abbreviation of the table alone fixes the offset (the ``D`` marks daylight saving), so
    repeated clock times in autumn stay unambiguous. Any other zone name Spark knows
    (``US/Eastern``, ``Asia/Kolkata``, ``MST``, ``+05:30``) is read by its rules; a name it does
    not know, or text of another form, gives NULL.
    """
    c = _col(col)
    clock = r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})"
    wall = F.try_to_timestamp(F.concat(F.regexp_extract(c, clock, 1), F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    zone = F.regexp_extract(c, clock + r" (\S+)\s*$", 2)
    offsets = F.create_map(*[F.lit(x) for pair in ZONE_OFFSET_HOURS.items() for x in pair])
    fixed = F.unix_timestamp(wall) - F.try_element_at(offsets, zone) * 3600
    # a cast reads zone names after the clock, and gives NULL where it cannot
    seconds = F.unix_timestamp(wall)
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    of_day = F.pmod(seconds, F.lit(86400))
    text = F.format_string("%sT%02d:%02d:%02d", days.cast("string"), F.floor(of_day / 3600), F.floor(of_day % 3600 / 60), of_day % 60)
    named = F.unix_timestamp(F.when(zone != "", F.concat_ws(" ", text, zone)).try_cast("timestamp"))
    return F.coalesce(fixed, named)


def utc_to_local(col, zone) -> Column:
    """Clock time in a zone (a name or a column of names) of a UTC timestamp."""
    return F.from_utc_timestamp(_col(col), zone)


def local_to_utc(col, zone) -> Column:
    """UTC timestamp of a clock time in a zone."""
    return F.to_utc_timestamp(_col(col), zone)


http_date_to_epoch = zoned_text_to_epoch


def iso_gmt_to_epoch(col) -> Column:
    """``2018-08-10T16:10:23.123GMT`` to epoch seconds, read as UTC."""
    text = F.regexp_replace(_col(col), "GMT$", "Z")
    return F.unix_timestamp(text.try_cast("timestamp"))


def now_iso_gmt() -> Column:
    """Current instant in the same ISO form, milliseconds then ``GMT``."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("GMT"))


def uptime_seconds(now, started) -> Column:
    """Seconds between a start timestamp and now."""
    return epoch_seconds(now) - epoch_seconds(started)


def within_lookback(time, end, interval) -> Column:
    """Closed look-back range: both ends count."""
    t, e = _col(time), _col(end)
    i = interval if isinstance(interval, Column) else F.lit(interval)
    return t.between(e - i, e)


def _elapsed_parts(col) -> tuple[Column, Column]:
    c = F.trim(_col(col))
    days = F.coalesce(F.nullif(F.regexp_extract(c, r"^(\d+)-", 1), F.lit("")).try_cast("bigint"), F.lit(0))
    clock = F.split(F.regexp_replace(c, r"^\d+-", ""), ":")
    return days, clock


def elapsed_to_seconds(col) -> Column:
    """``[dd-][hh:]mm:ss`` to seconds."""
    days, clock = _elapsed_parts(col)
    parts = F.transform(clock, lambda x: x.try_cast("bigint"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc * 60 + x) + days * 86400


def elapsed_to_minutes(col) -> Column:
    """``[dd-][hh:]mm:ss`` to minutes, the seconds part rounded to four places; NULL without a colon."""
    days, clock = _elapsed_parts(col)
    seconds = F.try_element_at(clock, F.lit(-1)).try_cast("double")
    minutes = F.try_element_at(clock, F.lit(-2)).try_cast("bigint")
    hours = F.when(F.size(clock) > 2, F.try_element_at(clock, F.lit(-3)).try_cast("bigint")).otherwise(0)
    return days * 1440 + hours * 60 + minutes + F.round(seconds / 60, 4)
