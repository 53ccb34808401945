"""Date columns: printed dates, statement years and card calendars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Spanish month names as printed on the statements.
MONTH_ABBR = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
MONTH_FULL = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)


def month_number(name: Column) -> Column:
    """Spanish month name, short or full, any case -> 1..12, else NULL."""
    low = F.lower(F.trim(name))
    short = F.array_position(F.array(*[F.lit(m) for m in MONTH_ABBR]), low)
    full = F.array_position(F.array(*[F.lit(m) for m in MONTH_FULL]), low)
    return F.nullif(F.greatest(short, full), F.lit(0)).cast("int")


def full_year(year: Column) -> Column:
    """Two-digit years belong to this century."""
    y = year.try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often it is named."""
    return F.transform(F.array(value), use)[0]


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Date of three numbers, NULL when there is no such day.

    Years of four digits are cast, which reads a date without a formatter."""
    m, d = month.cast("string"), day.cast("string")

    def read(y: Column) -> Column:
        near = F.concat(y.cast("string"), F.lit("-"), m, F.lit("-"), d).try_cast("date")
        far = F.try_to_date(F.concat_ws("-", y.cast("string"), m, d), "y-M-d")
        return F.when(y.between(1000, 9999), near).otherwise(far)

    return _bound(year, read)


# Fixed formats: printed date tokens, as (pattern, order of the three parts).
DATE_TOKENS = {
    "dd-mmm-y": (r"^(\d{2})-([A-Za-zé]{3})-(\d{4}|\d{2})$", "dby"),
    "dd/MM/y": (r"^(\d{2})/(\d{2})/(\d{4}|\d{2})$", "dmy"),
    "dd-MM-yyyy": (r"^(\d{2})-(\d{2})-(\d{4})$", "dmy"),
    "d mmm yyyy": (r"^(\d{1,2}) ([A-Za-zé]{3}) (\d{4})$", "dby"),
    "M/d/y": (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", "mdy"),
    "mmm dd yyyy": (r"^([A-Za-zé]{3})[A-Za-zé]* (\d{1,2}) (\d{4})$", "bdy"),
}


# Fixed format: what separates the parts of a token, and the ends of a line that ``$`` lets pass.
DATE_SEPARATORS = {"dd-mmm-y": "-", "dd/MM/y": "/", "dd-MM-yyyy": "-", "d mmm yyyy": " ", "M/d/y": "/", "mmm dd yyyy": " "}
LINE_ENDS = "\n\r\u0085\u2028\u2029"


def parse_date_token(text: Column, kind: str) -> Column:
    """Read one printed date token; anything else gives NULL.

    The pattern is matched once; the parts of a token that fits are cut at their separators."""
    pattern, order = DATE_TOKENS[kind]
    sep = DATE_SEPARATORS[kind]

    def read(token: Column) -> Column:
        cut = (
            F.substring_index(token, sep, 1),
            F.substring_index(F.substring_index(token, sep, 2), sep, -1),
            F.rtrim(F.substring_index(token, sep, -1), F.lit(LINE_ENDS)),
        )
        part = dict(zip(order, cut))
        month = month_number(F.substring(part["b"], 1, 3)) if "b" in part else part["m"].try_cast("int")
        return F.when(token.rlike(pattern), date_of(full_year(part["y"]), month, part["d"].try_cast("int")))

    return _bound(F.trim(text), read)


def resolve_year(month: Column, period_start: Column, period_end: Column) -> Column:
    """Year of a day printed without one: the start's year in the start's month,
    otherwise the end's year."""
    return F.when(month == F.month(period_start), F.year(period_start)).otherwise(F.year(period_end))


def resolve_day_month(day: Column, month: Column, period_start: Column, period_end: Column) -> Column:
    return date_of(resolve_year(month, period_start, period_end), month, day)


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_span(year: Column, month: Column) -> tuple[Column, Column]:
    """First and last day of a calendar month."""
    first = F.make_date(year, month, F.lit(1))
    return first, F.last_day(first)


def period_start_from_days(period_end: Column, days: Column) -> Column:
    """A period of ``days`` days that ends on ``period_end`` (both included)."""
    return F.date_sub(period_end, days.cast("int") - 1)


def _clamped(first_of_month: Column, day: Column) -> Column:
    return F.date_add(first_of_month, F.least(day, F.day(F.last_day(first_of_month))) - 1)


def next_cutoff(as_of: Column, cutoff_day: Column) -> Column:
    """Next statement cutoff on or after ``as_of``; the day is clamped to the month."""
    first = F.trunc(as_of, "month")
    here = _clamped(first, cutoff_day)
    return F.when(as_of <= here, here).otherwise(
        _clamped(F.add_months(first, 1), cutoff_day)
    )


def add_business_days(start: Column, days: Column) -> Column:
    """``days`` Monday-to-Friday days after ``start``; no holidays.

    A weekend start counts from its Friday, then whole weeks add two days each.
    """
    weekday = F.weekday(start)
    base = F.when(weekday == 5, F.date_sub(start, 1)).when(weekday == 6, F.date_sub(start, 2)).otherwise(start)
    w = F.least(weekday, F.lit(4))
    step = days + F.floor((w + days) / 5).cast("int") * 2
    return F.when(days > 0, F.date_add(base, step)).otherwise(start)


def due_date(cutoff: Column, offset_days: Column, offset_type: Column) -> Column:
    """Payment date: ``natural`` counts calendar days, ``habil`` business days."""
    return F.when(offset_type == "natural", F.date_add(cutoff, offset_days)).when(
        offset_type == "habil", add_business_days(cutoff, offset_days)
    )


def months_to_year_end(as_of: Column, year: Column) -> Column:
    """Whole months after ``as_of``'s month up to December of ``year``; may be negative."""
    return (year - F.year(as_of)) * 12 + (12 - F.month(as_of))
