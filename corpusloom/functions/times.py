"""Times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?\d{1,12}(\.\d*)?$"
ISO = r"^(\d{4}-\d{2}-\d{2})(?:[Tt ]\s*(\d{2}:\d{2}(?::\d{2})?)(\.\d+)?\s*([Zz]|UTC|[+-]\d{2}(?::?\d{2})?)?)?$"


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 UTC of a time written in ISO form or as Unix seconds, else null.

    A time without an offset is UTC, whatever the session's time zone; a date alone is its
    midnight. Digits beyond microseconds are cut.
    """
    t = F.btrim(text, F.lit(" \t\r\n"))
    seconds = F.when(t.rlike(NUMBER), t.try_cast("decimal(24,6)"))
    part = lambda i: F.regexp_extract(t, ISO, i)
    clock = F.when(part(2) == "", "00:00:00").when(F.length(part(2)) == 5, F.concat(part(2), F.lit(":00"))).otherwise(part(2))
    zone = F.upper(part(4))
    offset = (
        F.when(zone.isin("", "Z", "UTC"), "+00:00")
        .when(F.length(zone) == 3, F.concat(zone, F.lit(":00")))
        .when(F.length(zone) == 5, F.concat(zone.substr(1, 3), F.lit(":"), zone.substr(4, 2)))
        .otherwise(zone)
    )
    stamp = F.concat(part(1), F.lit(" "), clock, F.substring(part(3), 1, 7), offset).try_cast("timestamp")
    return F.coalesce((seconds * 1000000).cast("long"), F.when(t.rlike(ISO), F.unix_micros(stamp)))
