"""The three time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern of each format in a line, its Spark format and its length.
FORMATS = {
    "SQL": (r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", "yyyy-MM-dd HH:mm:ss", 19),
    "ORACLE": (r"[0-9]{4}-\w{3}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", "yyyy-MMM-dd HH:mm:ss", 20),
    "ISO8601": (r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}", "yyyy-MM-dd'T'HH:mm:ss", 19),
}


def to_epoch(text: Column, fmt: str) -> Column:
    """Seconds since 1970 of a text that starts with a timestamp of the session's time zone; null if it doesn't."""
    _, spark_format, length = FORMATS[fmt]
    return F.unix_timestamp(F.try_to_timestamp(F.left(text, F.lit(length)), F.lit(spark_format)))


_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def fixed_epoch(stamp: Column, fmt: str) -> Column:
    """The same of a text that has the format's shape, from its parts: no parsing of patterns."""
    part = lambda at, size: F.substring(stamp, at, size).try_cast("int")
    if fmt == "ORACLE":
        name = F.instr(F.lit(_MONTHS), F.substring(stamp, 6, 3))
        month, rest = F.when(name % 3 == 1, (F.floor(name / 3) + 1).cast("int")), 10
    else:
        month, rest = part(6, 2), 9
    return F.unix_timestamp(F.try_make_timestamp(part(1, 4), month, part(rest, 2), part(rest + 3, 2), part(rest + 6, 2), part(rest + 9, 2)))


def first_epoch(line: Column, fmt: str) -> Column:
    """The same of the first timestamp anywhere in a line."""
    return to_epoch(F.regexp_substr(line, F.lit(FORMATS[fmt][0])), fmt)
