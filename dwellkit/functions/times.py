"""Zone-free time arithmetic on timestamps without time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of the wall-clock value, whatever the session time zone."""
    ts = ts.cast("timestamp_ntz")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (F.unix_date(ts.cast("date")).cast("bigint") * DAY_MICROS + seconds.cast("bigint") * 1_000_000
            + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint"))


def instant(ts: Column) -> Column:
    """The wall-clock value read as UTC."""
    return F.timestamp_micros(epoch_micros(ts))
