"""Statement text and positioned words, rendered by Spark from the given tables.

The extraction operators need printed statements. These functions print the rows
of the tables the way the feeds do (thousands commas, Spanish months, split
numbers), row by row, so the amount of text grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.functions.dates import MONTH_ABBR, MONTH_FULL
from tallyspark.functions.money import MONEY
from tallyspark.plans.small import spread
from tallyspark.sources.bindings import ledger, money, statement_name, statements, table


def printed(amount: Column) -> Column:
    """Two decimals and thousands commas."""
    return F.format_number(amount, 2)


def month_name(date: Column, names: tuple[str, ...] = MONTH_ABBR) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.month(date) - 1)


def order_file() -> Column:
    return F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".txt"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the columns that the renderers print."""
    return spread(table(spark, sf_dir, "orders")).select(
        order_file().alias("source_file"),
        F.col("o_orderkey").alias("key"),
        F.col("o_custkey").alias("account_id"),
        money("o_totalprice").alias("total"),
        F.col("o_orderdate").cast("date").alias("date"),
    )


def portfolio_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary line per part: code, name and four numbers.

    Every 37th value is 1.00 too high, every 5th line has no numbers.
    """
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    units = F.col("p_size").cast("decimal(14,4)")
    price = F.col("p_retailprice").cast(MONEY)
    value = F.round(units * price, 2) + F.when(key % 37 == 0, 1).otherwise(0)
    code = F.concat(F.lpad((key % 1000).cast("string"), 3, "0"), F.upper(F.substring("p_name", 1, 3)))
    numbers = F.concat_ws(" ", printed(price), F.format_number(units, 4), printed(price), printed(value))
    return part.select(
        F.concat("p_brand", F.lit(".txt")).alias("source_file"),
        key.alias("line_no"),
        F.when(key % 5 == 0, F.concat_ws(" ", code, F.col("p_name")))
        .otherwise(F.concat_ws(" ", code, F.col("p_name"), numbers))
        .alias("text"),
    )


# Line numbers of the scoped statement: a header per group, then its rows.
GROUP_STEP = 10**15


def scoped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier: a detail section with a header per line number and a dated row
    per line item, an end mark and a repeated header behind it."""
    item = table(spark, sf_dir, "lineitem")
    supplier, line = F.col("l_suppkey"), F.col("l_linenumber")
    file = F.concat(F.lit("i"), supplier.cast("string"), F.lit(".txt")).alias("source_file")
    code = F.concat(F.lpad(line.cast("string"), 3, "0"), F.lit("FND"))
    place = (F.col("l_orderkey") * 8 + line) * 1048576 + (F.col("l_partkey") * 509 + supplier) % 1048576
    rows = item.select(
        file,
        (line.cast("long") * GROUP_STEP + 1 + place).alias("line_no"),
        F.concat_ws(
            " ", F.date_format("l_shipdate", "dd/MM/yyyy"), F.lit("Contribution"), printed(money("l_extendedprice"))
        ).alias("text"),
    )
    headers = (
        item.select(file, line.alias("_l"), code.alias("_c"))
        .distinct()
        .select("source_file", (F.col("_l").cast("long") * GROUP_STEP).alias("line_no"), F.concat("_c", F.lit(" Growth fund")).alias("text"))
    )
    frame = F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), F.lit("2. Detail of contributions").alias("text")),
        F.struct((F.lit(8) * F.lit(GROUP_STEP)).alias("line_no"), F.lit("Agent: none").alias("text")),
        F.struct((F.lit(8) * F.lit(GROUP_STEP) + 1).alias("line_no"), F.lit("001FND Growth fund").alias("text")),
        F.struct((F.lit(8) * F.lit(GROUP_STEP) + 2).alias("line_no"), F.lit("01/01/2000 Repeated 9.99").alias("text")),
    )
    frames = item.select(file).distinct().select("source_file", F.inline(frame))
    return rows.unionByName(headers).unionByName(frames)


def activity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity-plan activity per user: payroll credits, releases and other rows."""
    events = table(spark, sf_dir, "events")
    value = money("value")
    price = (F.col("event_id") % 50 + F.lit("0.25").cast("decimal(4,2)")).cast(MONEY)
    kind = F.col("event_type")
    body = (
        F.when(kind == "purchase", F.concat(F.lit("Payroll Credit $1.00 $"), printed(value)))
        .when(kind == "signup", F.concat_ws(" ", F.lit("Release"), value.cast("string"), price.cast("string")))
        .otherwise(F.concat(F.lit("Dividend $"), printed(value)))
    )
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".txt")).alias("source_file"),
        F.col("event_id").alias("line_no"),
        F.concat_ws(" ", F.date_format("ts", "M/d/yy"), body).alias("text"),
    )


def total_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per order with printed totals; every 31st lacks the closing one."""
    o = orders(spark, sf_dir)
    lines = F.array(
        F.concat(F.lit("Saldo Anterior "), printed(F.col("total"))),
        F.when(F.col("key") % 31 != 0, F.concat(F.lit("Saldo Final "), printed(F.col("total") + 10))),
        F.concat(
            F.lit("SUMA DE CARGOS "), printed(F.col("total") + F.col("key") % 90),
            F.lit("\nRENGLONES DE CARGOS "), (F.col("key") % 90).cast("string"),
        ),
    )
    return o.select("source_file", F.array_join(lines, "\n").alias("text"))


def income_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labelled lines per order; the amount has a stray space inside.

    13th: a dash for nothing; 17th: no dollar at all; 19th: no such line.
    """
    o = orders(spark, sf_dir)
    key, text = F.col("key"), printed(F.col("total"))
    split = F.concat(F.substring(text, 1, 1), F.lit(" "), F.substring(text, F.lit(2), F.length(text)))
    amount = F.when(key % 13 == 0, F.lit("$ -")).when(key % 17 == 0, F.lit("none")).otherwise(F.concat(F.lit("$ "), split))
    lines = F.array_compact(
        F.array(
            F.lit("Estado de resultados"),
            F.when(key % 19 != 0, F.concat(F.lit("UTILIDAD DE OPERACION neta "), amount, F.lit(" MXN"))),
            F.concat(F.lit("Utilidad de operación $ 1.00")),
        )
    )
    return o.select("source_file", F.posexplode(lines).alias("line_no", "text")).withColumn(
        "line_no", F.col("line_no").cast("long")
    )


def signed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card rows with a sign token; the merchant's name holds a lone hyphen."""
    o = orders(spark, sf_dir)
    sign = F.when(F.col("key") % 4 == 0, "-").otherwise("+")
    return o.select(
        "source_file",
        F.col("key").alias("line_no"),
        F.concat(F.lit("CLUB - "), F.col("account_id").cast("string"), F.lit(" "), sign, F.lit(" $"), printed(F.col("total"))).alias("text"),
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").cast("string").alias("source_file"), "text")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents on pages of 40 lines, with heights that wander:
    within a line they are 0, 2 or 4 points below its base."""
    from tallyspark.operators.extract import split_lines

    lines = split_lines(document_texts(spark, sf_dir))
    words = lines.select("source_file", "line_no", F.posexplode(F.split("text", " ")).alias("w", "text")).filter(
        F.col("text") != ""
    )
    return words.select(
        "source_file",
        F.floor(F.col("line_no") / 40).cast("int").alias("page"),
        (F.col("line_no") * 100_000 + F.col("w")).alias("word_no"),
        "text",
        (F.col("w") * 10.0).alias("x0"),
        (F.col("w") * 10.0 + 8.0).alias("x1"),
        ((F.col("line_no") % 40) * 10.0 + (F.length("text") % 3) * 2.0).alias("top"),
    )


COLUMN_LABELS = ["CHARGES", "CREDITS", "BALANCE"]


def header_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header words of each supplier's statement on two pages; the left edges
    differ by supplier, and the first page lacks the last label."""
    supplier = table(spark, sf_dir, "supplier")
    shift = (F.col("s_suppkey") % 7).cast("double")
    cells = []
    for page in (1, 2):
        for i, label in enumerate(COLUMN_LABELS):
            if page == 1 and label == COLUMN_LABELS[-1]:
                continue
            cells.append(
                F.struct(
                    F.lit(page).alias("page"),
                    F.lit(i).cast("long").alias("word_no"),
                    F.lit(label).alias("text"),
                    (shift + 100.0 * (i + 1) + 5.0 * (page - 1)).alias("x0"),
                )
            )
    return supplier.select(statement_of(F.col("s_suppkey")).alias("source_file"), F.inline(F.array(*cells)))


def statement_of(supplier: Column) -> Column:
    return F.concat(F.lit("w"), supplier.cast("string"), F.lit(".txt"))


def amount_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as number words somewhere between x1 = 80 and 459."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        statement_of(F.col("l_suppkey")).alias("source_file"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("word_no"),
        printed(money("l_extendedprice")).alias("text"),
        (80.0 + (F.col("l_partkey") * 13 + F.col("l_orderkey")) % 380).alias("x1"),
    )


def label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per account and its orders as dollar words to the left and right,
    up to 20 points above or below."""
    customer = table(spark, sf_dir, "customer")
    o = orders(spark, sf_dir)
    file = F.concat(F.lit("p"), F.col("account_id").cast("string"), F.lit(".txt")).alias("source_file")
    labels = customer.select(F.col("c_custkey").alias("account_id")).select(
        file,
        F.lit(1).alias("page"),
        F.lit(-1).cast("long").alias("word_no"),
        F.lit("TOTAL:").alias("text"),
        F.lit(40.0).alias("x0"),
        F.lit(90.0).alias("x1"),
        F.lit(100.0).alias("top"),
    )
    values = o.select(
        file,
        F.lit(1).alias("page"),
        F.col("key").alias("word_no"),
        F.concat(F.lit("$"), printed(F.col("total"))).alias("text"),
        F.when(F.col("key") % 5 == 0, 10.0).otherwise(200.0).alias("x0"),
        F.lit(260.0).alias("x1"),
        (F.lit(80.0) + (F.col("key") % 41)).alias("top"),
    )
    return labels.unionByName(values)


def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows as raw card CSV columns, all text; a charge is printed positive."""
    rows = ledger(spark, sf_dir, text=True)
    day = F.date_format("date", "dd MMM yyyy")
    return rows.select(
        "source_file",
        F.col("id").alias("source_row"),
        day.alias("Fecha"),
        F.concat(day, F.lit(" ")).alias("Fecha de Compra"),
        F.concat(F.lit(" "), F.col("description")).alias("Descripción"),
        printed(-F.col("amount")).alias("Importe"),
        F.when(F.col("currency") != "MXN", F.concat_ws(" ", printed(F.abs("amount")), F.col("currency"))).alias(
            "Monto en moneda extranjera"
        ),
        F.coalesce(F.concat(F.lit("'"), "external_ref", F.lit("'")), F.lit("")).alias("Referencia"),
    )


def xml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small XML statement per order with two movements and a short line."""
    o = orders(spark, sf_dir)
    day = F.date_format("date", "dd-MM-yyyy")
    key = F.col("key").cast("string")
    line = F.concat(
        F.lit("C"), F.col("account_id").cast("string"), F.lit(", Interest, net, "), F.col("total").cast("string"),
        F.lit(", "), day, F.lit(", F"), key,
    )
    fee = F.concat(
        F.lit("C"), F.col("account_id").cast("string"), F.lit(", Fee, -"), (F.col("key") % 100).cast("string"),
        F.lit(".50, "), day, F.lit(", G"), key,
    )
    text = F.concat(
        F.lit("<Doc><Addenda><Movimientos>\nMovimientos:\nContrato, Descripcion, Monto, Fecha, Folio\n"),
        line, F.lit("\n\n"), fee, F.lit("\nshort, line\n</Movimientos></Addenda></Doc>"),
    )
    return o.select(
        "source_file",
        F.when(F.col("key") % 10 == 0, F.lit("<Doc><Other>x</Other></Doc>")).otherwise(text).alias("text"),
    )


def sectioned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sectioned CSV report per order: period, balances, two movement sections."""
    o = orders(spark, sf_dir)
    day = F.date_format("date", "dd/MM/yyyy")
    end = F.concat_ws(" ", F.initcap(month_name(F.col("date"))), F.date_format("date", "dd"), F.date_format("date", "yyyy"))
    total = F.concat(F.lit('"'), printed(F.col("total")), F.lit(' USD"'))
    units = (F.col("key") % 1000).cast("string")
    text = F.concat(
        F.lit("Reporte,,\n,Periodo,Ene 01 1995 - "), end, F.lit("\n,Activo,a,b,c,d,Saldo,e,Valor\n"),
        F.lit(",Bitcoin,a,b,c,d,"), units, F.lit(".5,e,"), total, F.lit("\n"),
        F.lit(",Ether,a,b,c,d,2,e,1.00 USD\n,,,,,,,,\n,Late,a,b,c,d,9,e,9.00 USD\n"),
        F.lit("Fecha,Op,x,Activo,Simbolo,Unidades,y,Fiat\n"),
        day, F.lit(",Compra,x,Bitcoin,BTC,"), units, F.lit(".25,y,"), total, F.lit("\nnota\n"),
        day, F.lit(",Venta,x,Ether,ETH,-1,y,1.00 USD\n"),
        F.lit("Fecha,Op,x,Activo,Simbolo,Unidades,y,Fiat\n"), day, F.lit(",Otra,x,Ether,ETH,-1,y,1.00 USD\n"),
    )
    return o.select("source_file", text.alias("text"))


def period_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that print one period in three ways."""
    o = orders(spark, sf_dir)
    date, end = F.col("date"), F.date_add("date", 29)

    def token(d: Column, year: str) -> Column:
        return F.concat_ws("-", F.date_format(d, "dd"), month_name(d), F.date_format(d, year))

    return o.select(
        F.concat("source_file", F.lit("-"), F.initcap(month_name(date, MONTH_FULL))).alias("source_file"),
        F.concat(
            F.lit("Periodo: "), token(date, "yyyy"), F.lit(" al "), token(end, "yyyy"),
            F.lit("\nCorte: "), token(end, "yyyy"), F.lit("\nDias del periodo: 30\nperiodo de "), F.date_format(date, "yyyy"),
        ).alias("text"),
    )


def card_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a card feed with many repeats: amounts in whole ten thousands,
    dates moved to the first of the month, five references."""
    item = table(spark, sf_dir, "lineitem")
    supplier, line = F.col("l_suppkey"), F.col("l_linenumber")
    day = F.col("l_shipdate").cast("date")
    return item.select(
        supplier.alias("account_id"),
        F.trunc(day, "month").alias("date"),
        (-F.floor(F.col("l_extendedprice") / 10000) * 10000).cast(MONEY).alias("amount"),
        F.when(line % 3 != 0, F.concat(F.lit("R"), (F.col("l_orderkey") % 5).cast("string"))).alias("external_ref"),
        F.concat(
            F.lit("c"), F.year(day).cast("string"), F.lit("-"), (F.col("l_orderkey") % 3).cast("string"),
            F.when(F.col("l_linestatus") == "O", ".CSV").otherwise(".pdf"),
        ).alias("source_file"),
        ((F.col("l_orderkey") * 8 + line) * 1048576 + (F.col("l_partkey") * 509 + supplier) % 1048576).alias("source_row"),
        day.alias("ship_date"),
    )


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of ``bindings.statements`` as printed lines.

    A head with the account, the period and the opening balance, a table with two
    lines per ledger row, and a foot with the printed totals. Every 31st account
    leaves its closing balance out, every 37th its number, and every 41st prints no
    end of the period in some months.
    """
    slash = lambda c: F.date_format(c, "dd/MM/yyyy")
    key = F.col("account_id")
    foot = 2**62
    no_end = (key % 41 == 0) & (F.month("period_start") % 5 == 0)

    def line(no: int, *text: Column) -> Column:
        return F.struct(F.lit(no).cast("long").alias("line_no"), F.concat(*text).alias("text"))

    frame = F.array(
        line(0, F.lit("Cuenta: "), F.when(key % 37 == 0, F.lit("sin numero")).otherwise(key.cast("string"))),
        line(1, F.lit("Periodo: "), slash("period_start"), F.lit(" al "), F.when(no_end, F.lit("--/--/----")).otherwise(slash("period_end"))),
        line(2, F.lit("Saldo Anterior "), printed(F.col("opening"))),
        line(3, F.lit("DETALLE DE MOVIMIENTOS")),
        line(foot, F.lit("TOTAL DE MOVIMIENTOS")),
        line(foot + 1, F.lit("Cargos "), printed(F.col("printed_charges")), F.lit(" en "), F.col("n_charges").cast("string")),
        line(foot + 2, F.lit("Abonos "), printed(F.col("printed_credits")), F.lit(" en "), F.col("n_credits").cast("string")),
        line(foot + 3, F.when(key % 31 == 0, F.lit("Sin saldo")).otherwise(F.concat(F.lit("Saldo Final "), printed(F.col("closing"))))),
    )
    framed = statements(spark, sf_dir).select("source_file", F.inline(frame))
    rows = ledger(spark, sf_dir, text=True)
    day = F.concat_ws("/", F.date_format("date", "dd"), F.upper(month_name(F.col("date"))))
    sign = F.when(F.col("amount") < 0, "+").otherwise("-")
    first = F.concat_ws(" ", day, day, F.col("description"), sign, F.concat(F.lit("$"), printed(F.abs("amount"))))
    second = F.concat(
        F.lit("nota "), F.coalesce(F.concat(F.lit("Referencia "), F.lpad("external_ref", 12, "0")), F.lit("sin clave"))
    )
    pair = F.array(
        F.struct((F.col("id") * 2 + 10).alias("line_no"), first.alias("text")),
        F.struct((F.col("id") * 2 + 11).alias("line_no"), second.alias("text")),
    )
    return framed.unionByName(rows.select(statement_name().alias("source_file"), F.inline(pair)))
