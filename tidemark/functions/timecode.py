"""Millisecond times as text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timing line of a cue: optional hours, two-digit minutes and seconds, three-digit fraction.
_CLOCK = r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})"
TIMING_LINE = r"(?sU)^" + _CLOCK + r"\s+-->\s+" + _CLOCK + r"(?:\s+.*)?$"


def timecode(ms: Column, separator: str = ".") -> Column:
    """``HH:MM:SS.mmm``; captions in SRT use a comma."""
    hours = F.floor(ms / 3_600_000).cast("long")
    minutes = F.floor(ms / 60_000).cast("long") % 60
    seconds = F.floor(ms / 1000).cast("long") % 60
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", hours, minutes, seconds, ms % 1000)


def half_even(value: Column) -> Column:
    """Round to a whole number with ties to even."""
    return F.bround(value).cast("long")


def seconds_to_ms(seconds: Column) -> Column:
    """Seconds as text or number to whole milliseconds; null where it is not a finite number."""
    number = seconds.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < 9.0e15)
    return F.when(finite, half_even(number * 1000))


def clock_to_ms(line: Column, first_group: int) -> Column:
    """One clock of a timing line; null where minutes or seconds are 60 or more."""
    hours, minutes, seconds, millis = (
        F.regexp_extract(line, TIMING_LINE, first_group + i) for i in range(4)
    )
    hours = F.when(hours == "", F.lit(0)).otherwise(hours.try_cast("long"))
    minutes, seconds, millis = (c.try_cast("long") for c in (minutes, seconds, millis))
    value = ((hours * 60 + minutes) * 60 + seconds) * 1000 + millis
    return F.when((minutes < 60) & (seconds < 60), value)


def is_timing(line: Column) -> Column:
    return F.regexp_like(line, F.lit(TIMING_LINE))
