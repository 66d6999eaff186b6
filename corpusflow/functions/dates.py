"""Dates out of text, and report dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import rx

#: English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


def month_number(name: Column) -> Column:
    """1 to 12 from a name or number; null if neither."""
    short = F.lower(F.substring(rx.trim(name), 1, 3))
    by_name = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), short).cast("int"), F.lit(0))
    number = F.expr("null").cast("int") if name is None else name.try_cast("int")
    return F.coalesce(by_name, F.when(number.between(1, 12), number))


def made(year: Column, month: Column, day: Column) -> Column:
    """A timestamp at midnight UTC, or null if there is no such day."""
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year.try_cast("int"), month.try_cast("int"), day.try_cast("int")), F.lit("yyyy-MM-dd"))


def numeric(text: Column) -> Column:
    """The first y-m-d of a text, also with Chinese marks; null if there is none or no such day."""
    return made(*[rx.extract(text, rules.NUMERIC_DATE, g) for g in (1, 2, 3)])


def from_text(text: Column) -> Column:
    """The first of: y-m-d (also with Chinese marks), D Month YYYY, Month D, YYYY; null if none."""
    ymd = r"(20\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})"
    dmy = rf"\b(\d{{1,2}})\s+({_NAME})\.?,?\s+(20\d{{2}})\b"
    mdy = rf"\b({_NAME})\.?\s+(\d{{1,2}}),?\s+(20\d{{2}})\b"
    get = lambda p, g: rx.extract(text, p, g)
    return F.coalesce(
        made(get(ymd, 1), get(ymd, 2), get(ymd, 3)),
        made(get(dmy, 3), month_number(get(dmy, 2)), get(dmy, 1)),
        made(get(mdy, 3), month_number(get(mdy, 1)), get(mdy, 2)),
    )


def from_block(year: Column, month: Column, day: Column) -> Column:
    """Year with month and day defaulting to 1; a month may be a name."""
    return F.when(year.isNotNull(), made(year, F.coalesce(month_number(month), F.lit(1)), F.coalesce(day.try_cast("int"), F.lit(1))))


def parsed(text: Column) -> Column:
    """ISO 8601, else RFC 822 (weekday left out); null if neither."""
    bare = rx.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},\s*", ""))
    forms = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z", "d MMM yyyy")
    return F.coalesce(text.try_cast("timestamp"), *[F.try_to_timestamp(bare, F.lit(f)) for f in forms])


def day_key(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """YYYY-MM-DD in the report's zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")
