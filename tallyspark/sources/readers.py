"""File readers: raw scan first, then a pure projection to staged rows.

Every ``stage_*`` function works on an already loaded DataFrame, so the same
projection serves files, tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.functions.dates import parse_date_token
from tallyspark.functions.money import MONEY, foreign_amount, parse_money
from tallyspark.functions.text import file_name, unquoted
from tallyspark.plans.ordered import running_sum

# Fixed format: header of the card CSV.
CARD_COLUMNS = (
    "Fecha", "Fecha de Compra", "Descripción", "Titular de la Tarjeta", "Cuenta", "Importe",
    "Monto en moneda extranjera", "Tipo de Cambio", "Información Adicional",
    "Aparece en su Estado de Cuenta como", "Dirección", "Población/Provincia", "Código postal",
    "País", "Referencia",
)


def with_file_name(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", file_name(F.col("_metadata.file_path")))


def read_card_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw rows of card CSV files (UTF-8, header, all columns as text), numbered
    from 0 in the order of each file.

    With ``multi_line`` a quoted field may hold line breaks, and a file is one
    task. Without it big files are cut into splits; a row's number is then its
    place in its split plus the rows of the splits before it.
    """
    schema = ", ".join(f"`{c}` string" for c in CARD_COLUMNS)
    raw = (
        spark.read.option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("multiLine", multi_line)
        .schema(schema)
        .csv(path)
    )
    placed = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
    )
    numbered = running_sum(placed, ["_path"], ["_split"], ["_id"], F.lit(1), "_n")
    return (
        numbered.withColumn("source_file", file_name(F.col("_path")))
        .withColumn("source_row", (F.col("_n") - 1).cast("int"))
        .drop("_path", "_split", "_id", "_n")
    )


def stage_card_rows(raw: DataFrame) -> DataFrame:
    """Card rows as staged movements: a printed charge is positive, so the sign is
    turned; the whole row is kept as text because rules search it."""
    printed = [c for c in CARD_COLUMNS if c in raw.columns]
    amount = -F.regexp_replace(F.trim("Importe"), ",", "").try_cast(MONEY)
    return raw.select(
        "source_file",
        "source_row",
        F.try_to_date(F.trim(F.col("`Fecha de Compra`")), "dd MMM yyyy").alias("date"),
        F.try_to_date(F.trim("Fecha"), "dd MMM yyyy").alias("post_date"),
        amount.alias("amount"),
        F.trim("Descripción").alias("description"),
        foreign_amount(F.col("`Monto en moneda extranjera`")).alias("foreign_amount"),
        unquoted(F.col("Referencia")).alias("external_ref"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in printed])).alias("raw_description"),
    )


def read_texts(spark: SparkSession, path: str, glob: str, encoding: str = "UTF-8") -> DataFrame:
    """Whole files as (source_file, text), one statement each."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select(file_name(F.col("path")).alias("source_file"), F.decode("content", encoding).alias("text"))


def _csv_fields(line: Column) -> Column:
    """Fields of one CSV line; quotes may wrap a field that holds commas.

    A comma put in front gives every field one of its own, the first included.
    """
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(
        found,
        lambda f: F.when(
            F.startswith(f, F.lit('"')), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(f),
    )


def _text_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def _positions(lines: Column, pattern: str) -> Column:
    """Positions (from 1) of the lines that match."""
    return F.filter(F.transform(lines, lambda l, i: F.when(l.rlike(pattern), i + 1)), lambda x: x.isNotNull())


def _cell(row: Column, i: int) -> Column:
    return F.try_element_at(row, F.lit(i + 1))


# Sections are found on raw lines, so only the rows that are kept are split into fields.
_BALANCE_HEADER = r'^[^,]*,"?Activo"?(,|$)'
_DATED = r'^"?\d{2}/\d{2}/\d{4}"?(,|$)'


def section_period_end(text: Column) -> Column:
    """End of the period in the cell after ``Periodo``: ``Mmm dd yyyy - Mmm dd yyyy``."""
    cell = F.regexp_extract(text, r'(?m)(?:^|,)"?Periodo"?,"?([^",\n]*)', 1)
    return parse_date_token(F.try_element_at(F.split(cell, " - "), F.lit(2)), "mmm dd yyyy")


def stage_sectioned_balances(texts: DataFrame) -> DataFrame:
    """Balances: rows after the header whose second cell is ``Activo`` up to the
    first short row or empty name."""
    lines = _text_lines(F.col("text"))
    placed = texts.select(
        "source_file",
        section_period_end(F.col("text")).alias("date"),
        lines.alias("lines"),
    )
    first = F.try_element_at(_positions(F.col("lines"), _BALANCE_HEADER), F.lit(1))
    after = placed.select("source_file", "date", F.slice("lines", first + 1, F.size("lines")).alias("after"))
    rows = after.select("source_file", "date", F.transform("after", lambda l: _csv_fields(l)).alias("rows"))
    stops = F.filter(
        F.transform(
            "rows", lambda r, i: F.when((F.size(r) < 9) | F.coalesce(_cell(r, 1) == "", F.lit(True)), i)
        ),
        lambda x: x.isNotNull(),
    )
    kept = rows.select(
        "source_file",
        "date",
        F.explode(F.slice("rows", F.lit(1), F.coalesce(F.try_element_at(stops, F.lit(1)), F.size("rows")))).alias("r"),
    )
    r = F.col("r")
    return kept.select(
        "source_file",
        "date",
        _cell(r, 1).alias("sub_portfolio"),
        _cell(r, 6).try_cast("decimal(24,8)").alias("units"),
        parse_money(_cell(r, 8)).alias("market_value"),
        F.lit("USD").alias("currency"),
    )


def stage_sectioned_movements(texts: DataFrame, sentinel: str) -> DataFrame:
    """Movements: date-shaped rows between the first and the second row whose first
    cell is ``sentinel``; ``source_row`` counts the kept rows."""
    placed = texts.select("source_file", _text_lines(F.col("text")).alias("lines"))
    marks = placed.select(
        "source_file", "lines", _positions(F.col("lines"), rf'^"?{sentinel}"?(,|$)').alias("marks")
    )
    first = F.try_element_at("marks", F.lit(1))
    last = F.coalesce(F.try_element_at("marks", F.lit(2)), F.size("lines") + 1)
    dated = F.filter(F.slice("lines", first + 1, last - first - 1), lambda l: l.rlike(_DATED))
    rows = marks.select("source_file", F.posexplode(dated).alias("source_row", "line"))
    fields = rows.select("source_file", "source_row", _csv_fields(F.col("line")).alias("r"))
    r = F.col("r")
    return fields.select(
        "source_file",
        "source_row",
        parse_date_token(_cell(r, 0), "dd/MM/y").alias("date"),
        F.concat_ws(": ", _cell(r, 1), _cell(r, 3)).alias("description"),
        _cell(r, 4).alias("currency"),
        _cell(r, 5).try_cast("decimal(24,8)").alias("units"),
        parse_money(_cell(r, 7)).alias("fiat_value"),
    )


def stage_xml_block(texts: DataFrame, element: str = "Movimientos") -> DataFrame:
    """Comma lines inside one XML element: first field, description, and the last
    three fields (amount, date, id). The description may hold commas itself."""
    block = F.xpath_string("text", F.lit(f"(//{element}[text()])[1]/text()"))
    lines = F.transform(F.split(block, "\r?\n"), lambda l: F.trim(l))
    data = F.filter(
        lines, lambda l: (l != "") & ~F.startswith(l, F.lit(element)) & ~F.startswith(l, F.lit("Contrato,"))
    )
    rows = texts.select("source_file", F.posexplode(data).alias("line_no", "_l"))
    parts = rows.select(
        "source_file", "line_no", F.transform(F.split("_l", ","), lambda p: F.trim(p)).alias("p")
    ).filter(F.size("p") >= 5)
    p = F.col("p")
    return parts.select(
        "source_file",
        "line_no",
        p[0].alias("contract"),
        F.array_join(F.slice(p, F.lit(2), F.size(p) - 4), ", ").alias("description"),
        F.try_element_at(p, F.lit(-3)).try_cast(MONEY).alias("amount"),
        parse_date_token(F.try_element_at(p, F.lit(-2)), "dd-MM-yyyy").alias("date"),
        F.try_element_at(p, F.lit(-1)).alias("external_ref"),
    )
