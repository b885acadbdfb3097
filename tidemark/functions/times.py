"""Column functions on timestamps: parsing, New York session logic, calendar features, grids. The session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def _minute(text: str) -> int:
    h, m = text.split(":")
    return int(h) * 60 + int(m)


def micros(ts: Column | str) -> Column:
    return F.unix_micros(ts)


def parse_ts(text: Column | str) -> Column:
    """ISO-8601 text as TIMESTAMP; text without a zone is UTC; null if unparseable."""
    return F.try_to_timestamp(text)


def parse_post_ts(text: Column | str, fallback: Column) -> Column:
    """A post's time as `yyyy-MM-ddTHH:mm:ss.SSSZ`: the fraction is cut to 6 digits; unparseable text gives the fallback."""
    whole = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)", 1)
    fraction = F.substring(F.regexp_extract(text, r"^\S{19}\.(\d+)", 1), 1, 6)
    zone = F.regexp_extract(text, r"(Z|[+-]\d\d:\d\d)$", 1)
    joined = F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.when(zone == "", "Z").otherwise(zone))
    return F.date_format(F.coalesce(F.try_to_timestamp(joined), fallback), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_epoch(seconds: Column | str) -> Column:
    return F.timestamp_seconds(seconds)


def ny(ts: Column | str) -> Column:
    """New York wall-clock time, as a timestamp to read fields from."""
    return F.from_utc_timestamp(ts, NEW_YORK)


def month_label(ts: Column | str) -> Column:
    return F.date_format(ts, "yy-MM")


def seconds_of_day(local: Column) -> Column:
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def in_session(ts: Column | str, start: str = "09:30", end: str = "16:00", closed: bool = False, weekdays: bool = True) -> Column:
    """Whether New York time is in [start, end), or with `closed` in [start, end] to the microsecond."""
    local = ny(ts)
    at = seconds_of_day(local)
    first, last = _minute(start) * 60, _minute(end) * 60
    inside = (at >= first) & (at < last)
    if closed:
        inside = inside | (local == F.date_trunc("DAY", local) + F.expr(f"INTERVAL {last} SECONDS"))
    return inside & (F.weekday(local) < 5) if weekdays else inside


def in_warmup(ts: Column | str) -> Column:
    """Weekdays [09:29, 09:34) in New York."""
    return in_session(ts, "09:29", "09:34")


def minutes_since_open(ts: Column | str, mode: str) -> Column:
    """Stream: whole minutes after 09:30, minus whole minutes until it before, 390 and more after the close. Batch: floored at 0."""
    late = seconds_of_day(ny(ts)) - _minute("09:30") * 60
    if mode == "batch":
        return F.greatest(F.floor(late / 60), F.lit(0)).cast("int")
    # The fraction of a second counts while the open is still to come.
    ahead = F.ceil(late / 60).cast("int")
    part = F.when(F.date_format(ny(ts), "SSSSSS") != "000000", F.ceil((late + 0.5) / 60).cast("int")).otherwise(ahead)
    return F.when(late < 0, part).otherwise(F.floor(late / 60).cast("int"))


def calendar_features(ts: str, mode: str = "stream") -> list[Column]:
    """minutes_since_open, day_of_week (Monday 0), day_of_month, week_of_year, month_of_year and the two session flags.

    Stream: calendar of the New York date, flags [09:30,09:35) and [15:55,16:00). Batch: UTC date, flags [09:30:00,09:34:00] and [15:56:00,16:00:00].
    """
    date = ny(ts) if mode == "stream" else F.col(ts)
    if mode == "stream":
        flags = in_session(ts, "09:30", "09:35", weekdays=False), in_session(ts, "15:55", "16:00", weekdays=False)
    else:
        flags = in_session(ts, "09:30", "09:34", closed=True, weekdays=False), in_session(ts, "15:56", "16:00", closed=True, weekdays=False)
    return [
        minutes_since_open(ts, mode).alias("minutes_since_open"),
        F.weekday(date).alias("day_of_week"), F.dayofmonth(date).alias("day_of_month"), F.weekofyear(date).alias("week_of_year"), F.month(date).alias("month_of_year"),
        flags[0].cast("int").alias("market_open_spike_flag"), flags[1].cast("int").alias("market_close_spike_flag"),
    ]


def next_grid(ts: Column | str, step: int = 10) -> Column:
    """The next multiple of `step` seconds strictly after ts."""
    return F.timestamp_seconds((F.floor(F.unix_micros(ts) / (step * 1_000_000)) + 1) * step)


def on_grid(ts: Column | str, step: int = 10) -> Column:
    return F.second(ts) % step == 0


def iso_year(ts: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), F.col(ts) if isinstance(ts, str) else ts)
