"""Table schemas, accepted values and additive schema evolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Codes that the tables may hold.
ACCOUNT_KINDS = ("transactional", "investment_formal", "investment_informal", "equity_compensation")
CATEGORY_KINDS = ("expense", "income", "transfer")
NATURES = ("basico", "necesario", "estilo_de_vida")
FREQUENCIES = ("fijo", "variable")
OFFSET_TYPES = ("natural", "habil")


ACCOUNT = (
    "account_id long, owner_id long, name string, institution string, kind string, currency string,"
    " parent_account_id long, is_credit_card boolean, statement_cutoff_day int,"
    " payment_due_offset_days int, payment_due_offset_type string, principal decimal(14,2), notes string"
)
CATEGORY = ("category_id long, name string, kind string, nature string, parent_id long")
TRANSACTION = (
    "id long, account_id long, date date, amount decimal(14,2), currency string, description string,"
    " category_id long, spend_frequency string, benefit_tag string, external_ref string,"
    " source_file string, source_row int, raw_description string, quantity decimal(24,8)"
)
HOLDING_SNAPSHOT = (
    "id long, account_id long, date date, sub_portfolio string, market_value decimal(14,2),"
    " net_contribution_period decimal(14,2), currency string, source_file string, notes string"
)
STATEMENT_SUMMARY = (
    "account_id long, source_file string, period_start date, period_end date,"
    " opening_balance decimal(14,2), closing_balance decimal(14,2)"
)
EQUITY_ENTRY = (
    "id long, account_id long, date date, own_contribution decimal(14,2), company_match decimal(14,2),"
    " market_value decimal(14,2), vested_units decimal(14,4), currency string"
)
ALTERNATIVE_ENTRY = (
    "account_id long, period_start date, period_end date, revenue decimal(14,2), expenses decimal(14,2),"
    " net_income decimal(14,2), participation_pct decimal(6,4), proportional_income decimal(14,2),"
    " currency string"
)
WORDS = ("source_file string, page int, word_no int, text string, x0 double, x1 double, top double")
LINES = ("source_file string, line_no long, text string")
STG_MOVEMENT = (
    "feed string, account_id long, source_file string, source_row int, op_date date, charge_date date,"
    " description string, raw_description string, amount decimal(14,2), currency string,"
    " external_ref string, is_disclosure boolean"
)
STG_STATEMENT = (
    "account_id long, source_file string, period_start date, period_end date, cutoff_date date,"
    " opening decimal(14,2), closing decimal(14,2), printed_charges decimal(14,2),"
    " printed_credits decimal(14,2), n_charges int, n_credits int, regular_charges decimal(14,2),"
    " instalments decimal(14,2), interest decimal(14,2), fees decimal(14,2), tax decimal(14,2),"
    " payments decimal(14,2)"
)
STATEMENT_CHECK = (
    "account_id long, source_file string, check string, expected decimal(24,2), actual decimal(24,2),"
    " tolerance decimal(6,2), ok boolean"
)


def accepted(column: Column, values: tuple[str, ...]) -> Column:
    """True where the value is NULL or one of the accepted codes."""
    return column.isNull() | column.isin(*values)


def fields(schema: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat schema text."""
    return [tuple(part.strip().split(" ", 1)) for part in re.split(r",\s+", schema)]


def align_schema(df: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Bring an older table to ``schema``: a missing column is added with its
    default (NULL without one), an existing column keeps its values."""
    defaults = defaults or {}
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(defaults.get(name))).cast(kind).alias(name)
            for name, kind in fields(schema)
        ]
    )


def union_evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two generations of a table; columns one of them lacks are NULL."""
    return old.unionByName(new, allowMissingColumns=True)
