"""ISO 8601 texts and times, in UTC whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_text(time: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.ffffff+00:00 of a timestamp."""
    micros = F.unix_micros(time.cast("timestamp"))
    seconds = F.floor(micros / F.lit(1_000_000))
    days = F.floor(seconds / F.lit(86_400))
    of_day = (seconds - days * 86_400).cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    date = F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")
    fraction = F.lpad((micros - seconds * 1_000_000).cast("string"), 6, "0")
    return F.concat(date, F.lit("T"), two(F.floor(of_day / F.lit(3600))), F.lit(":"), two(F.floor(of_day / F.lit(60)) % 60), F.lit(":"), two(of_day % 60), F.lit("."), fraction, F.lit("+00:00"))


def iso_time(text: Column) -> Column:
    """The timestamp of an ISO text with an offset; null where it is none."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)$"), text))
