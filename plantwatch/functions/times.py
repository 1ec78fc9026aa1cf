"""Event time is an ISO text; buckets are prefixes of it and bounds are compared as text."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plantwatch.rules import WINDOWS

BUCKET_WIDTH = {"day": 10, "hour": 13, "minute": 16}
_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d")


def event_time(column=None):
    """Timestamp of the ISO text; null when it cannot be read in any of the three accepted forms."""
    column = F.col("timestamp") if column is None else column
    plain = F.substring_index(F.translate(column, "TZ", " "), ".", 1)
    return F.coalesce(*[
        F.try_to_timestamp(plain, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    ])


def parse_text(value):
    """Python twin of ``event_time`` for one bound; None when unreadable."""
    plain = str(value or "").strip().replace("Z", "").replace("T", " ").split(".")[0]
    for fmt in _FORMATS:
        try:
            return datetime.strptime(plain, fmt)
        except ValueError:
            pass
    return None


def bound_text(moment):
    """A bound as text. The millisecond part sorts before the data's ``Z``, so an upper bound excludes its own second."""
    return moment.strftime("%Y-%m-%dT%H:%M:%S.000Z")


def bound_column(timestamp_column):
    return F.concat(F.date_format(timestamp_column, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))


def time_ends(df):
    """One row: ``oldest`` and ``newest`` event text.

    Where the table has the date columns, only the first and the last day are looked into; the days themselves are found
    without reading any column of the files, if the table is partitioned by them.
    """
    oldest, newest = F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest")
    if not {"year", "month", "day"} <= set(df.columns):
        return df.agg(oldest, newest)
    day = F.struct("year", "month", "day")
    days = df.filter("year IS NOT NULL").select(day.alias("d")).agg(F.min("d").alias("first"), F.max("d").alias("last"))
    first, last = (days.select(c).scalar() for c in ("first", "last"))
    there = lambda end: (F.col("year") == end["year"]) & (F.col("month") == end["month"]) & (F.col("day") == end["day"])
    return df.filter(there(first) | there(last)).agg(oldest, newest)


def time_range(df, start, end, include_end=False):
    """Rows in ``[start, end)``; with ``include_end`` the last second counts too.

    Where the table has the partition columns the same range is stated on them, so that whole folders are skipped.
    """
    stop = end + timedelta(seconds=1) if include_end else end
    rows = df.filter((F.col("timestamp") >= bound_text(start)) & (F.col("timestamp") <= bound_text(stop)))
    if {"year", "month", "day"} <= set(df.columns):
        rows = rows.filter(_from_day(start) & _to_day(stop))
    return rows


def _from_day(moment):
    year, month, day = F.col("year"), F.col("month"), F.col("day")
    return (year > moment.year) | (
        (year == moment.year) & ((month > moment.month) | ((month == moment.month) & (day >= moment.day))))


def _to_day(moment):
    year, month, day = F.col("year"), F.col("month"), F.col("day")
    return (year < moment.year) | (
        (year == moment.year) & ((month < moment.month) | ((month == moment.month) & (day <= moment.day))))


def bucket_label(column, window):
    """Axis label of a bucket prefix: ``HH:MM``, ``HH:00`` or ``MM-DD``."""
    width = WINDOWS[window][1]
    if width == 10:
        return F.substring(column, 6, 5)
    clock = F.substring(column, 12, 5)
    return clock if width == 16 else F.concat(clock, F.lit(":00"))
