"""Fields, rows and records out of statement text.

Inputs are ``docs`` (source_file, text: the whole text of one file) or ``lines``
(source_file, line_no, text). Work that stays inside a line or a text is a plain
projection. Work that depends on earlier lines uses chunked running sums, so one
very long file is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.functions.dates import month_number, month_span, parse_date_token, period_start_from_days
from tallyspark.functions.money import SUM, parse_money
from tallyspark.functions.text import fold_accents
from tallyspark.plans.ordered import BLOCK, block_of, carry_forward, running_sum

FILE = ["source_file"]


def split_lines(docs: DataFrame) -> DataFrame:
    """Whole texts -> numbered lines (from 0)."""
    parts = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    return docs.select("source_file", F.posexplode(parts).alias("line_no", "text")).withColumn(
        "line_no", F.col("line_no").cast("long")
    )


def _blocked(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    return lines.withColumn("_block", block_of(F.col("line_no"), block))


def _whole_file() -> Window:
    """The lines of a file up to and including each."""
    return Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i))


def extract_regex_rows(lines: DataFrame, pattern: str, names: list[str], money: list[str] = ()) -> DataFrame:
    """Lines that match ``pattern`` as table rows, one column per group.

    Columns named in ``money`` become decimals.
    """
    trimmed = F.trim("text")
    hit = lines.filter(trimmed.rlike(pattern))
    out = []
    for i, name in enumerate(names, start=1):
        value = F.trim(F.regexp_extract(trimmed, pattern, i))
        out.append((parse_money(value, "plain", "decimal(18,4)") if name in money else value).alias(name))
    return hit.select("source_file", "line_no", *out)


# Fixed format: a sign token, then an amount token.
SIGNED_AMOUNT = r"(?:^|\s)([+-])\s(\$[\d,]+\.\d{2})(?=\s|$)"


def extract_signed_rows(lines: DataFrame) -> DataFrame:
    """Rows whose amount carries a separate sign token.

    A lone + or - counts only right before an amount. The statement's plus is a
    charge, so the ledger amount has the opposite sign.
    """
    text = F.trim("text")
    start = F.regexp_instr(text, F.lit(SIGNED_AMOUNT))
    value = parse_money(F.regexp_extract(text, SIGNED_AMOUNT, 2))
    return lines.filter(text.rlike(SIGNED_AMOUNT)).select(
        "source_file",
        "line_no",
        F.trim(F.substring(text, F.lit(1), start - 1)).alias("description"),
        F.when(F.regexp_extract(text, SIGNED_AMOUNT, 1) == "+", -value).otherwise(value).alias("amount"),
    )


def extract_scoped_rows(
    lines: DataFrame,
    start: str,
    header: str,
    row: str,
    end: str,
    groups: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Sum detail rows under the header they follow.

    The section runs from the first line that contains ``start`` to the next one
    that contains ``end``. ``header`` captures the group, ``row`` captures the
    amount as its last group. Headers that ``groups`` (source_file, code) does not
    list are no headers.
    """
    text = F.trim("text")
    first = lines.filter(F.contains("text", F.lit(start))).groupBy(*FILE).agg(F.min("line_no").alias("_from"))
    last = (
        lines.filter(F.contains(text, F.lit(end)))
        .join(first, FILE)
        .filter(F.col("line_no") > F.col("_from"))
        .groupBy(*FILE)
        .agg(F.min("line_no").alias("_to"))
    )
    bounds = first.join(last, FILE, "left")
    inside = (
        lines.join(bounds, FILE)
        .filter((F.col("line_no") > F.col("_from")) & (F.col("_to").isNull() | (F.col("line_no") < F.col("_to"))))
        .drop("_from", "_to")
    )
    inside = inside.withColumn("_code", _group(text, header, 1))
    if groups is not None:
        listed = groups.select("source_file", F.col("code").alias("_code"), F.lit(True).alias("_listed")).distinct()
        inside = inside.join(listed, ["source_file", "_code"], "left").withColumn(
            "_code", F.when(F.col("_listed"), F.col("_code"))
        )
    scoped = carry_forward(_blocked(inside, block), FILE, "_block", ["line_no"], F.col("_code"), "code")
    n_groups = row.count("(") - row.count("(?") - row.count("\\(")
    amount = parse_money(F.regexp_extract(text, row, n_groups))
    return (
        scoped.filter(F.col("_code").isNull() & text.rlike(row) & F.col("code").isNotNull())
        .groupBy("source_file", "code")
        .agg(F.sum(amount).cast(SUM).alias("amount"))
    )


# Fixed formats: activity rows of an equity plan.
ACTIVITY_ROW = r"^(\d{1,2}/\d{1,2}/\d{2})\s+(.+)$"
ACTIVITY_NUMBER = r"\(?\$?(-?[\d,]+\.\d+)\)?"


def extract_activity_rows(lines: DataFrame) -> DataFrame:
    """Own contribution, released units and their value per file.

    A payroll row counts its last number; a release row has quantity and price.
    """
    text = F.trim("text")
    rest = F.regexp_extract(text, ACTIVITY_ROW, 2)
    numbers = F.regexp_extract_all(rest, F.lit(ACTIVITY_NUMBER), F.lit(1))
    pay = rest.contains("Payroll Credit")
    tokens = F.split(F.trim(F.regexp_replace(rest, "Release", "")), r"\s+")
    release = ~pay & rest.contains("Release") & (F.size(tokens) >= 2)
    quantity = F.when(release, tokens[0].try_cast("decimal(14,4)"))
    price = F.when(release, F.regexp_replace(tokens[1], r"^\$+", "").try_cast("decimal(14,4)"))
    paid = F.when(pay, F.regexp_replace(F.try_element_at(numbers, F.lit(-1)), ",", "").try_cast("decimal(14,2)"))
    rows = lines.filter(text.rlike(ACTIVITY_ROW)).select(
        "source_file", paid.alias("p"), quantity.alias("q"), (quantity * price).alias("v")
    )
    zero = F.lit(0)
    return rows.groupBy(*FILE).agg(
        F.coalesce(F.sum("p"), zero).cast(SUM).alias("own_contribution"),
        F.coalesce(F.sum("q"), zero).cast("decimal(24,4)").alias("vested_units"),
        F.coalesce(F.sum("v"), zero).cast("decimal(28,8)").alias("company_match"),
    )


def extract_fields(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Labelled fields of a text (first group of each pattern) and the names of
    those that are missing; a file with missing names belongs in quarantine."""
    found = {n: _group(F.col("text"), p, 1) for n, p in patterns.items()}
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in found.items()]))
    return docs.select("source_file", *[c.alias(n) for n, c in found.items()], missing.alias("missing"))


# Fixed format: a dollar token followed by number tokens.
SPLIT_AMOUNT = r"(?:^|\s)\$((?:\s+-?[\d,]+\.?\d*(?=\s|$))*)(?=\s|$)"


def extract_label_amount(lines: DataFrame, label: str) -> DataFrame:
    """Amount of the first line that starts with ``label`` (accents and case do
    not matter). Number tokens after the dollar are joined; none is zero; files
    without the label are absent."""
    folded = F.lower(fold_accents(F.col("text")))
    target = F.lower(fold_accents(F.lit(label)))
    first = lines.filter(F.startswith(folded, target)).groupBy(*FILE).agg(F.min_by("text", "line_no").alias("text"))
    digits = F.regexp_replace(F.regexp_extract("text", SPLIT_AMOUNT, 1), r"\s", "")
    return first.select("source_file", parse_money(digits, "spaced").alias("amount"))


def detect_template(docs: DataFrame, markers: dict[str, str]) -> DataFrame:
    """The one template whose marker a file contains; several or none give NULL
    (a file for quarantine)."""
    names = list(markers)
    hits = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(markers[n])), F.lit(n)) for n in names]))
    found = docs.groupBy(*FILE).agg(F.array_distinct(F.flatten(F.collect_set(hits))).alias("_hits"))
    return found.select("source_file", F.when(F.size("_hits") == 1, F.col("_hits")[0]).alias("template"))


def assemble_records(lines: DataFrame, is_start: Column, sep: str = "\n", block: int | None = BLOCK) -> DataFrame:
    """Join each start line with the lines up to the next start.

    ``record_no`` counts from 0 in a file; lines before the first start are no
    part of any record. With ``block`` None a file is one chunk.
    """
    starts = F.coalesce(is_start.cast("long"), F.lit(0))
    if block is None:
        numbered = lines.withColumn("_n", F.sum(starts).over(_whole_file()))
    else:
        numbered = running_sum(_blocked(lines, block), FILE, ["_block"], ["line_no"], starts, "_n")
    return (
        numbered.filter(F.col("_n") > 0)
        .groupBy("source_file", (F.col("_n") - 1).alias("record_no"))
        .agg(
            F.min("line_no").alias("first_line"),
            F.count("*").alias("n_lines"),
            F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_l"),
        )
        .select(
            "source_file",
            "record_no",
            "first_line",
            "n_lines",
            F.col("_l")[0]["text"].alias("start_text"),
            F.array_join(F.transform("_l", lambda s: s["text"]), sep).alias("raw_text"),
        )
    )


def table_region(
    lines: DataFrame, is_on: Column, is_off: Column, once: bool = False, block: int | None = BLOCK
) -> DataFrame:
    """Lines between an on and an off marker; markers themselves are left out.

    With ``once`` the table ends for good at the first off marker after an on. With
    ``block`` None a file is one chunk.
    """
    rows = lines.withColumn("_mark", F.when(is_on, F.lit("on")).when(is_off, F.lit("off")))
    if block is None:
        state = rows.withColumn("_state", F.last("_mark", ignorenulls=True).over(_whole_file()))
    else:
        state = carry_forward(_blocked(rows, block), FILE, "_block", ["line_no"], F.col("_mark"), "_state")
    if once:
        begun = state.filter(F.col("_mark") == "on").groupBy(*FILE).agg(F.min("line_no").alias("_on"))
        ended = (
            state.filter(F.col("_mark") == "off")
            .join(begun, FILE)
            .filter(F.col("line_no") > F.col("_on"))
            .groupBy(*FILE)
            .agg(F.min("line_no").alias("_off"))
        )
        state = state.join(ended, FILE, "left").filter(
            F.col("_off").isNull() | (F.col("line_no") < F.col("_off"))
        )
    return state.filter((F.col("_state") == "on") & F.col("_mark").isNull()).select(*lines.columns)


def end_at_headerless_page(words: DataFrame, labels: list[str]) -> DataFrame:
    """Words of the unbroken run of pages that carry all header labels."""
    page = words.groupBy("source_file", "page").agg(
        *[F.max(F.col("text") == l).alias(f"_h{i}") for i, l in enumerate(labels)]
    )
    has = F.lit(True)
    for i in range(len(labels)):
        has = has & F.col(f"_h{i}")
    page = page.select("source_file", "page", has.alias("_has"))
    first = page.filter("_has").groupBy(*FILE).agg(F.min("page").alias("_first"))
    stop = (
        page.filter(~F.col("_has"))
        .join(first, FILE)
        .filter(F.col("page") > F.col("_first"))
        .groupBy(*FILE)
        .agg(F.min("page").alias("_stop"))
    )
    bounds = first.join(stop, FILE, "left")
    return (
        words.join(bounds, FILE)
        .filter((F.col("page") >= F.col("_first")) & (F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))))
        .select(*words.columns)
    )


def fill_dates(
    rows: DataFrame, group: list[str], row_no: str, date: Column, block: int = BLOCK, ties: list[str] | None = None
) -> DataFrame:
    """Add ``filled_date``: the row's date, else the last one before it; rows with
    none at all keep NULL and belong in quarantine. ``ties`` order rows of one number."""
    blocked = rows.withColumn("_block", block_of(F.col(row_no), block))
    return carry_forward(blocked, group, "_block", [row_no, *(ties or [])], date, "filled_date").drop("_block")


def period_from_labels(docs: DataFrame, pattern: str, kind: str) -> DataFrame:
    """Period printed as two date tokens (groups 1 and 2 of ``pattern``)."""
    text = F.col("text")
    return docs.select(
        "source_file",
        parse_date_token(_group(text, pattern, 1), kind).alias("period_start"),
        parse_date_token(_group(text, pattern, 2), kind).alias("period_end"),
    )


def period_from_days(docs: DataFrame, end_pattern: str, kind: str, days_pattern: str) -> DataFrame:
    """Period printed as its last day and its number of days."""
    text = F.col("text")
    end = parse_date_token(_group(text, end_pattern, 1), kind)
    days = _group(text, days_pattern, 1).try_cast("int")
    return docs.select(
        "source_file", period_start_from_days(end, days).alias("period_start"), end.alias("period_end")
    )


def period_from_file_name(docs: DataFrame, month_pattern: str, year_pattern: str = r"de (\d{4})") -> DataFrame:
    """Whole month named in the file's name, with the year from the text."""
    month = month_number(_group(F.col("source_file"), "(?i)(" + month_pattern + ")", 1))
    year = _group(F.col("text"), year_pattern, 1).try_cast("int")
    first, last = month_span(year, month)
    return docs.select("source_file", first.alias("period_start"), last.alias("period_end"))
