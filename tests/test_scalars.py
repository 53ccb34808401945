from __future__ import annotations

import unicodedata
from datetime import date, timedelta
from decimal import Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import dates as d, money as m, text as t


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_parse_money_styles(spark):
    cases = [
        ("1,234.50", "plain", "1234.50"),
        ("1,234.50 USD", "plain", "1234.50"),
        ("$1,234.50", "plain", "1234.50"),
        ("+$10.00", "signed", "10.00"),
        ("-$10.00", "signed", "-10.00"),
        ("($3.25)", "paren", "-3.25"),
        ("3.25", "paren", "3.25"),
        ("7.00-", "trailing", "-7.00"),
        ("7.00-", "unsigned", "7.00"),
        ("2 38,964", "spaced", "238964.00"),
        ("-", "spaced", "0.00"),
        ("", "spaced", "0.00"),
        ("$ -", "dash_zero", "0.00"),
        ("nothing", "dash_zero", "0.00"),
        ("total $ 5.10", "dash_zero", "5.10"),
        ("n/a", "plain", None),
    ]
    for text, style, expected in cases:
        got = one(spark, m.parse_money(F.lit(text), style))
        assert got == (None if expected is None else Decimal(expected)), (text, style, got)


def test_foreign_amount(spark):
    got = one(spark, m.foreign_amount(F.lit(" 1,089.52 USD ")))
    assert (got["amount"], got["currency"]) == (Decimal("1089.52"), "USD")
    assert one(spark, m.foreign_amount(F.lit("  "))) is None


def test_rounding_is_half_up_on_decimals(spark):
    assert one(spark, F.round(F.lit(Decimal("2.675")), 2)) == Decimal("2.68")


def test_date_tokens(spark):
    cases = [
        ("08-jun-24", "dd-mmm-y", date(2024, 6, 8)),
        ("08-JUL-2026", "dd-mmm-y", date(2026, 7, 8)),
        ("31/12/99", "dd/MM/y", date(2099, 12, 31)),
        ("31/02/2024", "dd/MM/y", None),
        ("01-02-2024", "dd-MM-yyyy", date(2024, 2, 1)),
        ("5 dic 2023", "d mmm yyyy", date(2023, 12, 5)),
        ("2/9/24", "M/d/y", date(2024, 2, 9)),
        ("Ago 31 2025", "mmm dd yyyy", date(2025, 8, 31)),
        ("no date", "dd/MM/y", None),
    ]
    for text, kind, expected in cases:
        assert one(spark, d.parse_date_token(F.lit(text), kind)) == expected, text


def test_month_names(spark):
    assert one(spark, d.month_number(F.lit("SEP"))) == 9
    assert one(spark, d.month_number(F.lit("Septiembre"))) == 9
    assert one(spark, d.month_number(F.lit("xyz"))) is None


def test_resolve_year_across_new_year(spark):
    start, end = F.lit(date(2024, 12, 20)), F.lit(date(2025, 1, 19))
    assert one(spark, d.resolve_year(F.lit(12), start, end)) == 2024
    assert one(spark, d.resolve_year(F.lit(1), start, end)) == 2025
    assert one(spark, d.resolve_year(F.lit(6), start, end)) == 2025


def add_business(start: date, days: int) -> date:
    while days > 0:
        start += timedelta(days=1)
        days -= start.weekday() < 5
    return start


def test_business_days_equal_counting(spark):
    starts = [date(2024, 2, 26) + timedelta(days=i) for i in range(14)]
    cases = [(s, n) for s in starts for n in range(16)]
    df = spark.createDataFrame(cases, "s date, n int").select(
        "s", "n", d.add_business_days(F.col("s"), F.col("n")).alias("v")
    )
    for r in df.collect():
        assert r["v"] == add_business(r["s"], r["n"]), r


def test_next_cutoff(spark):
    cases = [
        (date(2023, 2, 10), 31, date(2023, 2, 28)),
        (date(2024, 2, 29), 31, date(2024, 2, 29)),
        (date(2024, 1, 31), 30, date(2024, 2, 29)),
        (date(2024, 12, 31), 4, date(2025, 1, 4)),
        (date(2024, 5, 4), 4, date(2024, 5, 4)),
    ]
    for as_of, day, expected in cases:
        assert one(spark, d.next_cutoff(F.lit(as_of), F.lit(day))) == expected


def test_months_to_year_end_may_be_negative(spark):
    as_of = F.lit(date(2026, 8, 12))
    assert one(spark, d.months_to_year_end(as_of, F.lit(2026))) == 4
    assert one(spark, d.months_to_year_end(as_of, F.lit(2025))) == -8


def test_fold_accents_equals_decomposition(spark):
    letters = [chr(c) for c in (*range(0x20, 0x250), *range(0x1E00, 0x1F00), 0xFB01, 0xFF21, 0x301, *map(ord, "йάёΐ"))]
    df = spark.createDataFrame([(c,) for c in letters], "c string").select("c", t.fold_accents(F.col("c")).alias("v"))
    for r in df.collect():
        bare = "".join(x for x in unicodedata.normalize("NFKD", r["c"]) if not unicodedata.combining(x))
        assert r["v"] == bare, hex(ord(r["c"]))


@settings(max_examples=15, deadline=None)
@given(st.decimals(min_value=-999999, max_value=999999, places=2))
def test_printed_money_reads_back(spark, value):
    printed = f"{value:,.2f}"
    assert one(spark, m.parse_money(F.lit(printed), "signed")) == value
    wrapped = f"(${-value:,.2f})" if value < 0 else f"${value:,.2f}"
    assert one(spark, m.parse_money(F.lit(wrapped), "paren")) == value


def test_word_boundary_is_unicode_aware(spark):
    assert not one(spark, t.matches(F.lit("cafés"), r"caf\b"))
    assert one(spark, t.matches(F.lit("PAGO RENTA mayo"), r"(?<![A-Za-z])renta\b"))
    assert not one(spark, t.matches(F.lit("PAGO XRENTA"), r"(?<![A-Za-z])renta\b"))


def test_file_parts_and_references(spark):
    assert one(spark, t.file_extension(F.lit("/a.b/Stmt.PDF"))) == ".pdf"
    assert one(spark, t.file_extension(F.lit("/a.b/plain"))) == ""
    assert one(spark, t.file_name(F.lit("/a.b/Stmt.PDF"))) == "Stmt.PDF"
    assert one(spark, t.reference_after(F.lit("x Referencia 1234567 y"))) == "1234567"
    assert one(spark, t.reference_after(F.lit("x Referencia 12345 y"))) is None
    assert one(spark, t.reference_slash(F.lit("a /REFAB12 c"))) == "AB12"
    assert one(spark, t.unquoted(F.lit(" 'AT26' "))) == "AT26"
    assert one(spark, t.unquoted(F.lit(" "))) is None


def test_date_token_is_worked_out_once(spark):
    """The text of a token is named once in the plan, however many parts are read from it."""
    df = spark.range(1).select(d.parse_date_token(F.reverse(F.col("id").cast("string")), "dd-mmm-y").alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1


def test_date_tokens_at_the_edges(spark):
    cases = [
        ("01-ene-1999\n", "dd-mmm-y", date(1999, 1, 1)),
        ("01-ENE-99\u2028", "dd-mmm-y", date(2099, 1, 1)),
        ("29/02/1999", "dd/MM/y", None),
        ("29/02/2000", "dd/MM/y", date(2000, 2, 29)),
        ("01/01/0999", "dd/MM/y", date(999, 1, 1)),
        ("00/01/1999", "dd/MM/y", None),
        (" 3 Dic 2001 ", "d mmm yyyy", date(2001, 12, 3)),
        ("3 xyz 2001", "d mmm yyyy", None),
        ("12/31/04", "M/d/y", date(2004, 12, 31)),
        ("diciembre 31 2004", "mmm dd yyyy", date(2004, 12, 31)),
        ("1-1-1999", "dd-MM-yyyy", None),
        (None, "dd-MM-yyyy", None),
    ]
    for text, kind, expected in cases:
        assert one(spark, d.parse_date_token(F.lit(text).cast("string"), kind)) == expected, (text, kind)
    none = F.lit(None).cast("int")
    assert one(spark, d.date_of(F.lit(1999), F.lit(5), none)) is None
    assert one(spark, d.date_of(none, F.lit(5), F.lit(1))) is None
