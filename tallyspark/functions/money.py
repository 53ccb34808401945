"""Money columns: parsing, rounding and tolerance comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(14,2)"
UNITS = "decimal(14,4)"
SUM = "decimal(24,2)"


def parse_money(text: Column, style: str = "plain", to: str = MONEY) -> Column:
    """Parse printed money into a decimal; unreadable text gives NULL.

    Styles:
      plain      thousands commas, optional currency code or ``$`` around it
      signed     as plain, with a leading ``+`` or ``-`` before the ``$``
      paren      ``(x)`` is negative
      trailing   a trailing ``-`` is negative
      unsigned   any minus is dropped (the column, not the text, has the sign)
      spaced     embedded spaces are dropped; empty or ``-`` is zero
      dash_zero  the number after the first ``$``; ``$ -`` or none is zero
    """
    if style == "dash_zero":
        digits = F.regexp_extract(text, r"\$\s*(-|[\d,]+\.\d{2})", 1)
        bare = F.regexp_replace(digits, ",", "")
        return F.when(text.isNull(), F.lit(None)).otherwise(
            F.when(bare.isin("", "-"), F.lit("0")).otherwise(bare)
        ).try_cast(to)
    bare = F.regexp_replace(F.trim(text), r"[,\s$]|\b[A-Z]{3}\b|^[A-Z]{3}|[A-Z]{3}$", "")
    if style == "plain" or style == "signed":
        out = bare
    elif style == "paren":
        inner = F.regexp_replace(bare, r"[()]", "")
        out = F.when(bare.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), inner)).otherwise(inner)
    elif style == "trailing":
        out = F.regexp_replace(bare, r"^([\d.]+)-$", "-$1")
    elif style == "unsigned":
        out = F.regexp_replace(bare, "-", "")
    elif style == "spaced":
        out = F.when(bare.isin("", "-"), F.lit("0")).otherwise(bare)
    else:
        raise ValueError(f"unknown money style {style!r}")
    return out.try_cast(to)


def foreign_amount(text: Column) -> Column:
    """``'89.52 USD'`` -> struct(amount, currency); NULL text stays NULL."""
    clean = F.nullif(F.trim(text), F.lit(""))
    return F.when(
        clean.isNotNull(),
        F.struct(
            F.regexp_replace(F.regexp_extract(clean, r"^(-?[\d,]+(?:\.\d+)?)", 1), ",", "")
            .try_cast(MONEY)
            .alias("amount"),
            F.nullif(F.regexp_extract(clean, r"([A-Z]{3})$", 1), F.lit("")).alias("currency"),
        ),
    )


def within(a: Column, b: Column, tolerance: str) -> Column:
    """True when two decimals differ by at most ``tolerance``."""
    return F.abs(a - b) <= F.lit(tolerance).cast("decimal(6,2)")


def as_double(c: Column) -> Column:
    return c.cast("double")


def net_out(amount: Column) -> Column:
    """Signed ledger sum (negative = out) shown as spending (positive = out)."""
    return -F.sum(amount)
