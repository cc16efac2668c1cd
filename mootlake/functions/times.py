"""Timecodes and calendar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import filled, strip


def number_or(c: Column, fallback: Column) -> Column:
    return F.coalesce(c.try_cast("double"), fallback)


def hms(seconds: Column) -> Column:
    """HH:MM:SS; NULL and negative read as zero, hours may pass 99."""
    whole = F.floor(F.greatest(F.coalesce(seconds.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600),
                           F.floor(whole / 60) % 60, whole % 60)


def seconds_of(tag: Column) -> Column:
    part = F.split(tag, ":")
    return (part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long"))


def timecode(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60)


def _plausible(day: Column, as_of: Column) -> Column:
    return (F.year(day) >= fixed.OLDEST_YEAR) & (F.datediff(day, as_of) <= fixed.MAX_FUTURE_DAYS)


def _dates(name: Column, pattern: str, year: int, month: int, day: int) -> Column:
    def build(hit: Column) -> Column:
        return F.concat_ws("-", F.regexp_extract(hit, pattern, year),
                           F.lpad(F.regexp_extract(hit, pattern, month), 2, "0"),
                           F.lpad(F.regexp_extract(hit, pattern, day), 2, "0")).try_cast("date")
    return F.transform(F.regexp_extract_all(name, F.lit(pattern), F.lit(0)), build)


def date_from_name(name: Column, as_of: Column) -> Column:
    """First plausible date in a file name, trying the three spellings in order."""
    found = F.concat(_dates(name, fixed.DATE_YEAR_FIRST, 1, 2, 3),
                     _dates(name, fixed.DATE_DAY_FIRST, 3, 2, 1),
                     _dates(name, fixed.DATE_COMPACT, 1, 2, 3))
    return F.get(F.filter(found, lambda d: d.isNotNull() & _plausible(d, as_of)), F.lit(0))


def explicit_date(value: Column, as_of: Column) -> Column:
    text = strip(value)
    day = F.when(text.rlike(r"^20\d{2}-\d{2}-\d{2}$"), text).try_cast("date")
    return F.when(_plausible(day, as_of), day)


def resolve_date(explicit: Column, stored: Column, stored_source: Column, name: Column,
                 mtime: Column, as_of: Column) -> Column:
    """struct(date, source): explicit, then stored, then file name, then file time."""
    def pick(day: Column, source: Column) -> Column:
        return F.when(day.isNotNull(), F.struct(day.alias("date"), source.alias("source")))
    return F.coalesce(
        pick(explicit_date(explicit, as_of), F.lit("explicit")),
        pick(stored, F.coalesce(filled(stored_source), F.lit("meta"))),
        pick(date_from_name(name, as_of), F.lit("filename")),
        pick(F.to_date(mtime), F.lit("mtime")),
        F.struct(as_of.alias("date"), F.lit("processing_day").alias("source")))


def next_friday(day: Column) -> Column:
    """Strictly later than the day itself, so a Friday gives the next one."""
    return F.next_day(day, "FRI")


def due_from_hint(hint: Column, meeting_day: Column) -> Column:
    """A spoken deadline becomes a date counted from the meeting day."""
    text = F.lower(F.coalesce(hint, F.lit("")))
    return (F.when(text.rlike(fixed.HINT_TOMORROW), F.date_add(meeting_day, 1))
            .when(text.rlike(fixed.HINT_WEEK), next_friday(meeting_day))
            .when(text.rlike(fixed.HINT_MONTH), F.last_day(meeting_day)))


def next_occurrence(days: Column, at: Column, now: Column) -> Column:
    """Days until the next scheduled weekday (0 = Monday), NULL without one.

    Today counts only while the scheduled minute has not passed.
    """
    minute_now = F.hour(now) * 60 + F.minute(now)
    clock = F.split(at, ":")
    planned = F.when(F.coalesce(at, F.lit("")) != "",
                     clock[0].cast("int") * 60 + clock[1].cast("int"))
    today = F.weekday(F.to_date(now))
    open_days = F.filter(
        F.sequence(F.lit(0), F.lit(7)),
        lambda add: F.array_contains(days, (today + add) % 7)
        & ~((add == 0) & planned.isNotNull() & (minute_now > planned)))
    return F.get(open_days, F.lit(0))


def occurrence_label(add: Column, at: Column, now: Column) -> Column:
    names = F.array(*[F.lit(d) for d in fixed.WEEKDAYS])
    day = (F.when(add == 0, "сегодня").when(add == 1, "завтра")
           .otherwise(F.get(names, (F.weekday(F.to_date(now)) + add) % 7)))
    return F.when(add.isNotNull(), F.concat(
        day, F.when(F.coalesce(at, F.lit("")) != "", F.concat(F.lit(" в "), at)).otherwise("")))
