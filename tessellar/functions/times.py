"""Instants from the several notations of ISO-8601 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A zone at the end of an ISO-8601 time: Z or an offset.
ZONE = r"(?i)(z|[+-]\d{2}:?\d{2})$"


def instant_micros(text: Column | str) -> Column:
    """Microseconds since 1970 of ISO-8601 text; text without a zone is UTC; null where it is no time."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    zoned = F.when(c.rlike(ZONE), c).otherwise(F.concat(c, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def clock_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC whatever the session's zone is."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(F.concat(F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).try_cast("timestamp"))
