"""Identifiers and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flight_id(icao24: str, callsign: str, firstseen: str) -> Column:
    """CALLSIGN_icao24_epoch; a null or blank callsign is NOCALL."""
    call = F.coalesce(F.nullif(F.replace(F.col(callsign), F.lit(" "), F.lit("")), F.lit("")), F.lit("NOCALL"))
    return F.concat_ws("_", call, F.col(icao24), F.unix_timestamp(F.col(firstseen).cast("timestamp")).cast("string"))


def parse_time(text: str) -> Column:
    """An ISO date and time, in UTC where no zone is given; null if it cannot be read."""
    return F.try_to_timestamp(F.col(text))


def minute(ts: str) -> Column:
    return F.date_trunc("minute", F.col(ts))


def seconds(ts: Column | str) -> Column:
    """Seconds of a timestamp, as a double with microseconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def from_epoch(s: str) -> Column:
    """Timestamp of epoch seconds."""
    return F.timestamp_micros((F.col(s) * 1e6).cast("bigint"))


def first_known(*names: str, present: list[str]) -> Column:
    """First non-null of the named columns, those that are absent skipped."""
    have = [F.col(n).cast("double") for n in names if n in present]
    return F.coalesce(*have) if have else F.lit(None).cast("double")
