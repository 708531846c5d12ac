"""Time expressions that don't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(at: Column, zone: str) -> Column:
    """A timestamp as read in ``zone``, like ``Sat Nov 28, 9:06 AM``; null for null."""
    there = F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz"))
    return F.date_format(there, "EEE MMM dd, h:mm a")
