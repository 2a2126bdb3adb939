"""Calendar and time-zone functions over columns. Day text is gated by its shape before any cast, since a cast alone
accepts more than ``YYYY-MM-DD``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DAY = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
ISO_INSTANT = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def iso_day(text: Column) -> Column:
    """The day that a text writes as YYYY-MM-DD; null for any other text and for days that do not exist."""
    return F.when(F.rlike(text, F.lit(ISO_DAY)), F.try_to_date(text, "yyyy-MM-dd"))


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(year: Column, month: Column) -> Column:
    return F.when(month == 2, F.when(is_leap_year(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31)


def is_calendar_date(year: Column, month: Column, day: Column) -> Column:
    return F.coalesce((day >= 1) & (day <= days_in_month(year, month)), F.lit(False))


def is_instant(text: Column) -> Column:
    """A day, T, time with seconds, optional fraction, and Z or an offset in -12:00..+14:00."""
    part = lambda i: F.regexp_extract(text, ISO_INSTANT, i)
    number = lambda i: part(i).try_cast("int")
    offset = part(6)
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    minutes = sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int"))
    zone = (offset == "Z") | (minutes.between(-720, 840) & (F.substring(offset, 5, 2).try_cast("int") < 60))
    ok = F.rlike(text, F.lit(ISO_INSTANT)) & iso_day(part(1)).isNotNull() & (number(2) < 24) & (number(3) < 60) & (number(4) < 60) & zone
    return F.coalesce(ok, F.lit(False))


def instant(text: Column) -> Column:
    return F.when(is_instant(text), F.try_to_timestamp(text))


def local_day(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def start_of_day(day: Column, zone: str) -> Column:
    """The first instant whose local day it is: days of 23 or 25 hours and missing midnights included."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def offset_minutes(at: Column, zone: str) -> Column:
    return ((F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)) / 60).cast("int")


def offset_text(at: Column, zone: str) -> Column:
    m = offset_minutes(at, zone)
    return F.concat(F.when(m < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(m) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(m) % 60).cast("string"), 2, "0"))


def zone_clock(at: Column, zone: str) -> Column:
    """Local ISO text with its numeric offset."""
    return F.concat(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd'T'HH:mm:ss"), offset_text(at, zone))


def human_day(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def human_instant(at: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "dd/MM/yyyy HH:mm")


def stamp(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def rfc3339(at: Column, slack_hours: int = 0) -> Column:
    """UTC text without a fraction, some hours earlier."""
    return F.concat(F.date_format(at - F.make_dt_interval(hours=F.lit(slack_hours)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def stale_by_zone(text: Column, today: Column, now: Column) -> Column:
    """A plain day is stale on its local day, an instant when it has come; null for any other text."""
    day = iso_day(text)
    return F.when(day.isNotNull(), day <= today).when(is_instant(text), instant(text) <= now)


def stale_by_utc(text: Column, now: Column) -> Column:
    """The validator's form: a plain day means UTC midnight; what cannot be read is not stale."""
    return F.coalesce(F.when(iso_day(text).isNotNull(), iso_day(text).cast("timestamp") <= now).when(is_instant(text), instant(text) <= now), F.lit(False))


def month_offset(a: Column, b: Column) -> Column:
    """Whole months from a to b with the day clamped to the month's end; null if below 1 or not whole."""
    n = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return F.when((n >= 1) & (F.add_months(a, n) == b), n)


def bucket(deadline: Column, today: Column, soon_days: int) -> Column:
    return F.when(deadline.isNull(), "undated").when(deadline < today, "overdue").when(deadline == today, "today").when(deadline <= F.date_add(today, soon_days), "upcoming").otherwise("later")


def deadline(cell: Column) -> Column:
    """From free text: the first real day written D/M/YYYY or YYYY-MM-DD, tokens that are no day, tokens without a year."""
    token = r"(?<![0-9/-])(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9/-])"
    tokens = F.regexp_extract_all(cell, F.lit(token), F.lit(0))
    day = lambda x: F.when(F.contains(x, F.lit("/")), F.try_to_date(x, "d/M/yyyy")).otherwise(F.try_to_date(x, "yyyy-MM-dd"))
    real = F.filter(tokens, lambda x: day(x).isNotNull())
    return F.struct(
        day(F.get(real, F.lit(0))).alias("day"),
        F.filter(tokens, lambda x: day(x).isNull()).alias("invalid"),
        F.regexp_extract_all(cell, F.lit(r"(?<![0-9/-])[0-9]{1,2}/[0-9]{1,2}(?![0-9/-])"), F.lit(0)).alias("yearless"),
        F.slice(real, F.lit(2), F.greatest(F.size(real) - 1, F.lit(0))).alias("others"),
    )


def next_fire_times(now: Column, clock: str, n: int) -> Column:
    """The next n local instants at HH:MM."""
    first = F.to_timestamp(F.concat_ws(" ", F.to_date(now).cast("string"), F.lit(f"{clock}:00")))
    start = F.when(first > now, F.to_date(now)).otherwise(F.date_add(F.to_date(now), 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.to_timestamp(F.concat_ws(" ", F.date_add(start, i).cast("string"), F.lit(f"{clock}:00"))))


def same_clock(at: Column, a: str, b: str) -> Column:
    """Equal offsets now and half a year on."""
    later = at + F.make_dt_interval(days=F.lit(182))
    return (offset_minutes(at, a) == offset_minutes(at, b)) & (offset_minutes(later, a) == offset_minutes(later, b))
