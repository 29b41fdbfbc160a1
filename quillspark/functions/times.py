"""Time functions. ``now`` is always a parameter, so that a query gives the same result whenever it runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats that dates are read in, after a leading weekday is taken off.
DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mmXXX",
    "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy HH:mm:ss zzz", "d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d yyyy",
]


def to_utc(stored: Column, zone: str) -> Column:
    """Wall clock of the storage zone, as an instant in a UTC session."""
    return F.to_utc_timestamp(stored, zone)


def to_stored(instant: Column, zone: str) -> Column:
    """An instant as wall clock of the storage zone."""
    return F.from_utc_timestamp(instant, zone)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def day_window(now: Column, zone: str) -> tuple[Column, Column]:
    """Bounds (UTC) of the audience's calendar day at ``now``."""
    start = F.date_trunc("day", F.from_utc_timestamp(now, zone))
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(start + F.expr("INTERVAL 1 DAY"), zone)


def window_bounds(now: Column, zone: str, max_age_hours: int | None = None) -> tuple[Column, Column]:
    """Rolling [now - h, now + 1 h) where an age is given, else the calendar day."""
    if max_age_hours and max_age_hours > 0:
        return now - F.expr(f"INTERVAL {int(max_age_hours)} HOURS"), now + F.expr("INTERVAL 1 HOUR")
    return day_window(now, zone)


def is_fresh(published: Column, now: Column, zone: str = "UTC", max_age_hours: int | None = None, enabled: bool = True) -> Column:
    """Half-open window; a missing date isn't fresh; without a policy all are."""
    if not enabled:
        return F.lit(True)
    start, end = window_bounds(now, zone, max_age_hours)
    return F.coalesce((published >= start) & (published < end), F.lit(False))


def seconds_left(now: Column, zone: str, max_age_hours: int | None = None, enabled: bool = True) -> Column:
    """Seconds to the end of the day's window; null where the window isn't a day."""
    if not enabled or max_age_hours:
        return F.lit(None).cast("long")
    return F.greatest(F.lit(0), F.unix_timestamp(day_window(now, zone)[1]) - F.unix_timestamp(now))


def parse_date(text: Column, now: Column) -> Column:
    """An instant from a publish date's text; null without a year, before 2000, or over two days ahead."""
    bare = F.regexp_replace(F.trim(text), "(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\\s+", "")
    parsed = F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMATS))
    has_year = text.rlike("(?<!\\d)(19|20)\\d{2}(?!\\d)")
    return F.when(has_year & (F.year(parsed) >= 2000) & (parsed <= now + F.expr("INTERVAL 2 DAYS")), parsed)


def storage_prefix(at: Column) -> Column:
    return F.date_format(at, "yyyy/MM")


def storage_key(kind: str, at: Column, digest: Column, suffix: Column) -> Column:
    """``media/YYYY/MM/kind/digest.suffix``."""
    return F.concat(F.lit("media/"), storage_prefix(at), F.lit(f"/{kind}/"), digest, F.lit("."), suffix)
