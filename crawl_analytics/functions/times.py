"""Time columns that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CRAWL_TIME_ZONE


def epoch_micros(seconds_text: Column) -> Column:
    """Epoch seconds as text to whole microseconds."""
    return F.round(seconds_text.try_cast("double") * 1000000).cast("bigint")


def utc_wall_clock(micros: Column) -> Column:
    """Microseconds since the epoch as a zone-less UTC timestamp."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    seconds = (micros.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def wall_clock(seconds_text: Column, zone: str = CRAWL_TIME_ZONE) -> Column:
    """Epoch seconds as text to the wall clock of a zone, without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_wall_clock(epoch_micros(seconds_text)))


def micros_of(ntz: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp read as UTC."""
    day = F.datediff(ntz.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = day * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60
    return seconds * 1000000 + (F.date_part(F.lit("SECOND"), ntz) * 1000000).cast("bigint")


def hours_between(later: Column, earlier: Column) -> Column:
    """Difference of two zone-less timestamps in hours."""
    return (micros_of(later) - micros_of(earlier)) / F.lit(3.6e9)
