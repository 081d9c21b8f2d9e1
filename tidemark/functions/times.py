"""Times as columns: slots, editions, peak hours, relative labels, stamps inside urls. Instants are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes of the Beijing day from which the editions after the morning one count, and the peak minutes of a working day. Fixed values.
EDITIONS = ((9 * 60 + 30, "midday"), (15 * 60, "close"), (20 * 60 + 30, "us_premarket"))
PEAK = ((9 * 60, 12 * 60), (14 * 60, 18 * 60))
#: Unit of a relative label: seconds, and the greatest number it comes with. Fixed values.
OFFSETS = {"s": (1, 59), "m": (60, 59), "h": (3600, 23)}


def slot(ts: Column, minutes: int = 30) -> Column:
    """Number of the slot since the epoch."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / (60 * minutes))


def beijing(ts: Column) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), "Asia/Shanghai")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def edition(ts: Column) -> Column:
    """The edition by the minute of the Beijing day, the morning one first."""
    m = minute_of_day(beijing(ts))
    out = F.lit("morning")
    for start, name in EDITIONS:
        out = F.when(m >= start, name).otherwise(out)
    return out


def peak(ts: Column, holidays: list[str]) -> Column:
    """Whether it is a working day in Beijing, in the peak minutes."""
    local = beijing(ts)
    day, m = F.date_format(local, "yyyy-MM-dd"), minute_of_day(local)
    inside = F.lit(False)
    for start, end in PEAK:
        inside = inside | ((m >= start) & (m < end))
    return ~F.dayofweek(local).isin(1, 7) & ~day.isin(holidays) & inside


def next_off_peak(ts: Column, holidays: list[str]) -> Column:
    """The instant itself if it isn't at peak, else the end of its peak span, in UTC."""
    local = beijing(ts)
    hour = F.when(F.hour(local) < 12, 12).otherwise(18)
    ends = F.to_utc_timestamp(F.date_trunc("day", local) + F.make_interval(hours=hour), "Asia/Shanghai")
    return F.when(peak(ts, holidays), ends).otherwise(ts.cast("timestamp"))


def next_due(last: Column, ts: Column, peak_minutes: int, off_minutes: int, holidays: list[str]) -> Column:
    """Whether a check is due: so many minutes since the last one, by the kind of the hour."""
    gap = F.unix_seconds(ts.cast("timestamp")) - F.unix_seconds(last.cast("timestamp"))
    return last.isNull() | (gap >= 60 * F.when(peak(ts, holidays), peak_minutes).otherwise(off_minutes))


def relative(label: Column, now: Column) -> Column:
    """The older edge of a label such as `5m` or `2h`: a number up to its unit's limit and s, m or h; null for anything else."""
    plain = F.lower(F.trim(label))
    number, unit = F.regexp_extract(plain, r"^([0-9]{1,2})\s*[smh]$", 1), F.regexp_extract(plain, r"^[0-9]{1,2}\s*([smh])$", 1)
    n = number.try_cast("int")
    seconds = F.lit(None).cast("int")
    for name, (size, most) in OFFSETS.items():
        seconds = F.when((unit == name) & (n <= most), (n + 1) * size).otherwise(seconds)
    return F.timestamp_seconds(F.unix_seconds(now.cast("timestamp")) - seconds)


def url_stamp(url: Column) -> Column:
    """The UTC instant of the Beijing time yyyyMMddHHmmss that stands, perhaps with more digits, between slashes of a url; null if there is none."""
    digits = F.regexp_extract(url, r"/([0-9]{14})[0-9]*/", 1)
    return F.when(digits != "", F.to_utc_timestamp(F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")), "Asia/Shanghai"))
