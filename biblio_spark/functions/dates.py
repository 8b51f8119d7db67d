"""Dates as they come: partial, with month names, as ranges of years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblio_spark.functions.text import col, filled

# Fixed values.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
FIRST_YEAR = 1900

_FORMS = ((r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"), (r"^[0-9]{4}-[0-9]{1,2}$", "yyyy-M"), (r"^[0-9]{4}$", "yyyy"))


def parse_partial_date(c: Column | str) -> Column:
    """First day of "2023-05-17", "2023-05" or "2023"; null for anything else."""
    c = col(c)
    return F.coalesce(*(F.when(c.rlike(pattern), F.try_to_timestamp(c, F.lit(form)).cast("date")) for pattern, form in _FORMS))


def is_valid_date(c: Column | str) -> Column:
    return parse_partial_date(c).isNotNull()


def _month_number(c: Column, upper: bool = False) -> Column:
    table = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m.upper() if upper else m, f"{i + 1:02d}")))
    return F.coalesce(F.try_element_at(table, c), c)


def _two(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def iso_date(year, month=None, day=None, hour=None, minute=None) -> Column:
    """ISO text from parts: year, year-month, year-month-day or with a time of day; parts after a missing one are left out,
    months may be names ("Jan") or digits. Null without a year."""
    y, m, d, h, mi = (F.lit(None).cast("string") if x is None else col(x) for x in (year, month, day, hour, minute))
    out = F.concat(y, F.lit("-"), _two(_month_number(m)))
    full = F.concat(out, F.lit("-"), _two(d))
    timed = F.concat(full, F.lit("T"), _two(h), F.lit(":"), _two(mi), F.lit(":00"))
    return (
        F.when(~filled(y), F.lit(None).cast("string"))
        .when(~filled(m), y)
        .when(~filled(d), out)
        .when(filled(h) & filled(mi), timed)
        .otherwise(full)
    )


def wos_pub_date(year: Column | str, month: Column | str) -> Column:
    """First day of the month as ISO text, from a year and "NOV", "11" or a span like "NOV-DEC" (its first month). Null if
    either is missing or no month."""
    m = F.split(F.upper(col(month)), "-")[0]
    return parse_partial_date(F.concat(col(year).cast("string"), F.lit("-"), _month_number(m, upper=True))).cast("string")


def year_range(text: Column | str, current_year: int) -> Column:
    """struct(start, end) of "2020", "2020-2023", "2020-" or "-2023"; fields are null where the text is no such range, starts
    before 1900, ends beyond next year or runs backwards."""
    t = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    start = F.regexp_extract(t, r"^([0-9]{4})(-[0-9]{4}|-)?$", 1)
    end = F.regexp_extract(t, r"^(?:[0-9]{4})?-([0-9]{4})$", 1)
    shape = t.rlike(r"^[0-9]{4}$|^[0-9]{4}-$|^-[0-9]{4}$|^[0-9]{4}-[0-9]{4}$")
    a = F.when(start != "", start.cast("int")).otherwise(F.lit(FIRST_YEAR))
    b = F.when(end != "", end.cast("int")).when(t.rlike("-$"), F.lit(current_year)).otherwise(a)
    ok = F.coalesce(shape & (a >= FIRST_YEAR) & (b <= current_year + 1) & (a <= b), F.lit(False))
    return F.struct(F.when(ok, a).alias("start"), F.when(ok, b).alias("end"))


def parse_year_range(text: str, current_year: int) -> tuple[int, int]:
    """The same for an argument; ValueError where it is no range."""
    import re

    m = re.fullmatch(r"\s*(?:(\d{4})|(\d{4})-(\d{4})|(\d{4})-|-(\d{4}))\s*", text)
    if not m:
        raise ValueError(f"not a range of years: {text!r}")
    one, low, high, since, until = (int(x) if x else None for x in m.groups())
    start = one or low or since or FIRST_YEAR
    end = one or high or until or current_year
    if not FIRST_YEAR <= start <= end <= current_year + 1:
        raise ValueError(f"not a range of years: {text!r}")
    return start, end
