"""The trading session's clock: session date, boundaries, elapsed slots and regimes, as column expressions.

A session runs from 17:00 to 16:00 the next day, Chicago time, and is named by the day it ends on. Every boundary is a
wall-clock time converted on its own, so daylight-saving changes move it correctly."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Chicago"
SESSION_MINUTES = 1380


def session_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE) + F.expr("INTERVAL 7 HOURS"))


def session_time(session: Column, minutes: int) -> Column:
    """The instant of a wall-clock time, in minutes from the session date's midnight (negative: the day before)."""
    return F.to_utc_timestamp(F.to_timestamp(session) + F.make_dt_interval(mins=F.lit(minutes)), ZONE)


def session_open(session: Column) -> Column:
    return session_time(session, -7 * 60)


def session_close(session: Column) -> Column:
    return session_time(session, 16 * 60)


def minutes_since_open(ts: Column, session: Column) -> Column:
    return ((F.unix_micros(ts) - F.unix_micros(session_open(session))) / 60_000_000).cast("int")


def regimes(ts: Column) -> dict[str, Column]:
    """Flags by the local minute of a decision; none is set from 16:00 to before 17:00."""
    local = F.from_utc_timestamp(ts, ZONE)
    m = F.hour(local) * 60 + F.minute(local)
    flags = {
        "asia_flag": (m >= 17 * 60) | (m < 2 * 60),
        "europe_flag": (m >= 2 * 60) & (m < 8 * 60 + 30),
        "us_flag": (m >= 8 * 60 + 30) & (m < 16 * 60),
        "us_rth_flag": (m >= 8 * 60 + 30) & (m < 15 * 60),
    }
    return {name: flag.cast("smallint") for name, flag in flags.items()}


def time_of_day(slot: Column) -> dict[str, Column]:
    angle = slot * F.lit(2 * math.pi / SESSION_MINUTES)
    return {"time_of_day_sin": F.sin(angle), "time_of_day_cos": F.cos(angle)}
