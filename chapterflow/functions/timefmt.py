"""Time, duration and money as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chapterflow.functions.text import once


def to_millis(seconds: Column) -> Column:
    return F.bround(seconds * 1000, 0).cast("long")


def _h(total: Column) -> Column:
    return F.floor(total / 3600)


def _m(total: Column) -> Column:
    return F.floor(total % 3600 / 60)


def _s(total: Column) -> Column:
    return (total % 60).cast("long")


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``; rounding happens on total milliseconds, so it carries."""
    ms = to_millis(seconds)
    total = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", _h(total), _m(total), _s(total), ms % 1000)


def clock_time(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``; zero and below print as zero."""
    ms = F.greatest(to_millis(seconds), F.lit(0).cast("long"))
    total = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%06.3f", _h(total), _m(total), (ms % 60000) / F.lit(1000.0))


def hms(seconds: Column) -> Column:
    total = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", _h(total), _m(total), _s(total))


def human_duration(seconds: Column) -> Column:
    total = seconds.cast("long")
    return F.when(
        total >= 3600, F.format_string("%dh %dm %ds", _h(total), _m(total), _s(total))
    ).otherwise(F.format_string("%dm %ds", _m(total), _s(total)))


def eta(seconds: Column) -> Column:
    total = seconds.cast("long")
    minutes = F.when(_s(total) > 0, F.format_string("%dm %ds", _m(total), _s(total))).otherwise(
        F.format_string("%dm", _m(total))
    )
    return (
        F.when(seconds.isNull(), F.lit("--"))
        .when(total < 60, F.format_string("%ds", total))
        .when(total < 3600, minutes)
        .otherwise(F.format_string("%dh %dm", _h(total), _m(total)))
    )


def usd(amount: Column) -> Column:
    return F.format_string("$%.2f", amount)


def parse_clock(text: Column) -> Column:
    """Seconds of ``HH:MM:SS.mmm``; anything malformed is 0.0."""

    def seconds(parts: Column) -> Column:
        total = (
            F.get(parts, F.lit(0)).try_cast("int") * 3600
            + F.get(parts, F.lit(1)).try_cast("int") * 60
            + F.get(parts, F.lit(2)).try_cast("double")
        )
        return F.coalesce(F.when(F.size(parts) == 3, total), F.lit(0.0))

    return once(F.split(text, ":"), seconds)
