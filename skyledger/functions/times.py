"""Time expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def iso_utc(ts: Column) -> Column:
    """ISO text with offset; the fraction appears only when it is not zero.

    Instants are shown in UTC whatever the session's zone; values without a
    zone are UTC already.
    """
    ts = F.when(F.typeof(ts) == "timestamp", F.to_utc_timestamp(ts, F.current_timezone())).otherwise(ts)
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def ts_literal(value: dt.datetime) -> Column:
    """Literal of the session's zone-less type for naive values, else an instant."""
    if value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def bound(value: str | dt.datetime | None, end_of_day: bool = False) -> dt.datetime | None:
    """Parse an ISO bound; a bare date as upper bound means 23:59:59 of that day.

    Values are read as UTC and returned without a zone.
    """
    if not value:
        return None
    if isinstance(value, dt.datetime):
        parsed = value
    else:
        parsed = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
        if end_of_day and len(value) == 10:
            parsed = parsed.replace(hour=23, minute=59, second=59)
    if parsed.tzinfo is not None:
        parsed = parsed.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return parsed
