"""Every registered query: a name and a function of (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tallyspark import rulebook, schema
from tallyspark.functions import dates, money as m, text as t
from tallyspark.operators import (
    calendar,
    card_statements as cs,
    classify as cl,
    dedupe as dd,
    extract as ex,
    goals,
    ingest,
    layout,
    reconcile as rc,
    reports as rp,
    statements as st,
    wealth as wl,
)
from tallyspark.session import checkpoint_dir, in_rounds, scratch, written
from tallyspark.sources import bindings as b, feeds, readers, rendered as r, rendered_cards as rcards
from tallyspark.streaming.ingest import ingest_stream, read_table

AS_OF = "2001-06-15"
LOADED_BEFORE = "1998-01-01"
MONTH = "1997-05"
# Every month of the test tables.
MONTHS = [f"{year}-{month:02d}" for year in range(1992, 2003) for month in range(1, 13)]
# Ids of the test tables leave wide gaps: about 16,000 orders per block.
ID_BLOCK = 2**37

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its function's name; money leaves as double."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.select(
            *[
                F.col(f"`{f.name}`").cast("double").alias(f.name)
                if isinstance(f.dataType, T.DecimalType)
                else F.col(f"`{f.name}`")
                for f in df.schema.fields
            ]
        )

    QUERIES[fn.__name__] = run
    return run


def _fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for what a query writes and reads back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _base(spark: SparkSession, sf: str, **kw: object) -> DataFrame:
    return rp.monthly_base(b.ledger(spark, sf), b.accounts(spark, sf), b.categories(spark), **kw)


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return rp.monthly_summary(_base(spark, sf))


def _balances(spark: SparkSession, sf: str, mode: str = "reference") -> DataFrame:
    return wl.account_balance(
        b.ledger(spark, sf),
        b.snapshots(spark, sf),
        b.equity(spark, sf),
        b.alternatives(spark, sf),
        b.accounts(spark, sf),
        mode,
    )


# --- Reports -----------------------------------------------------------------


@query
def monthly_summary(spark, sf):
    return _monthly(spark, sf)


@query
def monthly_summary_categories(spark, sf):
    out = rp.monthly_summary(_base(spark, sf), with_categories=True)
    return out.select("owner_id", "currency", "month", F.posexplode("categories").alias("position", "c")).select(
        "owner_id", "currency", "month", "position", "c.category", "c.nature", "c.amount"
    )


@query
def monthly_category(spark, sf):
    return rp.monthly_category(_base(spark, sf))


@query
def spending_by_category(spark, sf):
    return rp.spending_by_category(b.ledger(spark, sf), b.accounts(spark, sf), b.categories(spark))


@query
def spending_by_category_range(spark, sf):
    return rp.spending_by_category(
        b.ledger(spark, sf), b.accounts(spark, sf), b.categories(spark), "1996-03-01", "1998-02-28", "MXN"
    )


@query
def month_breakdown(spark, sf):
    return rp.month_breakdown(_base(spark, sf), MONTH)


@query
def category_month_matrix(spark, sf):
    return rp.category_month_matrix(_base(spark, sf, currency="MXN"), b.categories(spark))


@query
def category_month_view(spark, sf):
    return rp.category_month_view(
        _base(spark, sf, currency="MXN"), b.categories(spark), MONTHS
    )


@query
def category_month_lookup(spark, sf):
    base = _base(spark, sf, currency="MXN")
    owners = b.accounts(spark, sf).select("owner_id").distinct()
    wanted = owners.select(
        "owner_id",
        F.lit("MXN").alias("currency"),
        F.explode(F.array(F.lit("Housing"), F.lit("Travel"), F.lit("Missing"))).alias("category"),
        F.lit(MONTH).alias("month"),
    )
    return rp.category_month_lookup(wanted, rp.category_month_cells(base, b.categories(spark)))


@query
def expense_ratio(spark, sf):
    return rp.expense_ratio(_monthly(spark, sf))


@query
def tag_surplus(spark, sf):
    return rp.tag_surplus(_monthly(spark, sf))


@query
def kpi_tiles(spark, sf):
    return rp.kpi_tiles(_monthly(spark, sf), wl.net_worth(_balances(spark, sf)))


@query
def search_transactions(spark, sf):
    return rp.search_transactions(
        b.ledger(spark, sf, text=True), b.accounts(spark, sf), b.categories(spark),
        date_from="1996-01-01", date_to="2000-12-31",
    )


@query
def search_by_category(spark, sf):
    return rp.search_transactions(
        b.ledger(spark, sf, text=True), b.accounts(spark, sf), b.categories(spark),
        account="Customer#000000042", category="Travel",
    )


@query
def export_ledger(spark, sf):
    return rp.export_ledger(b.ledger(spark, sf, text=True), b.accounts(spark, sf), b.categories(spark))


@query
def write_export(spark, sf):
    """The export as a file set, read back."""
    path = _fresh_folder(spark, "export")
    rp.write_export(rp.export_ledger(b.ledger(spark, sf, text=True), b.accounts(spark, sf), b.categories(spark)), path)
    return spark.read.parquet(path).groupBy("month", "kind", "frequency").agg(
        F.count("*").alias("rows"), F.sum("amount").alias("amount"), F.max("account").alias("last_account")
    )


@query
def account_calendar(spark, sf):
    return calendar.account_calendar(b.accounts(spark, sf), AS_OF)


@query
def accounts_with_parent(spark, sf):
    return rp.with_parent(b.accounts(spark, sf)).select("account_id", "name", "parent_account_id", "parent")


# --- Classification ----------------------------------------------------------


def _unclassified(spark: SparkSession, sf: str) -> DataFrame:
    return b.ledger(spark, sf, text=True).withColumn("category_id", F.lit(None).cast("long"))


@query
def classify_transfers(spark, sf):
    rows = cl.classify_transfers(
        _unclassified(spark, sf), b.accounts(spark, sf), rulebook.HOLDER_PATTERNS,
        rulebook.TRANSFER_CATEGORY, b.categories(spark), rulebook.HOLDER_EXCLUDED,
    )
    return rows.select("id", "category_id")


@query
def classify_rules(spark, sf):
    return cl.classify(_unclassified(spark, sf), rulebook.RULES, b.categories(spark)).select("id", "category_id")


@query
def classify_keeps_known(spark, sf):
    rows = cl.classify(b.ledger(spark, sf, text=True), rulebook.RULES, b.categories(spark))
    return rows.groupBy("category_id").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))


@query
def classify_dated_rules(spark, sf):
    name = cl.matched_category(rulebook.DATED_RULES)
    rows = cl.with_text(_unclassified(spark, sf), rulebook.DATED_RULES)
    return rows.select("id", name.alias("category")).filter(F.col("category").isNotNull())


@query
def spend_frequency(spark, sf):
    untagged = b.ledger(spark, sf, text=True).withColumn("spend_frequency", F.lit(None).cast("string"))
    return cl.tag_frequency(untagged, b.categories(spark), rulebook.FIXED_PATTERNS).select("id", "spend_frequency")


def _classified(spark: SparkSession, sf: str, trace: bool = False) -> DataFrame:
    return cl.classify_all(
        b.ledger(spark, sf, text=True), b.accounts(spark, sf), b.categories(spark), rulebook.HOLDER_PATTERNS,
        rulebook.TRANSFER_CATEGORY, rulebook.RULES, rulebook.FIXED_PATTERNS, rulebook.HOLDER_EXCLUDED, trace,
    )


@query
def classify_all(spark, sf):
    return _classified(spark, sf).select("id", "category_id", "spend_frequency")


@query
def classification_counts(spark, sf):
    return cl.classification_counts(_classified(spark, sf, trace=True))


@query
def rule_audit(spark, sf):
    return cl.rule_audit(_unclassified(spark, sf), rulebook.RULES)


@query
def classify_many_rules(spark, sf):
    out = cl.classify(b.ledger(spark, sf, text=True).withColumn("category_id", F.lit(None).cast("long")), rulebook.MANY_RULES, b.categories(spark))
    return out.select("id", "category_id")


@query
def rule_audit_many(spark, sf):
    return cl.rule_audit(_unclassified(spark, sf), rulebook.MANY_RULES)


# --- Dedupe and ingest -------------------------------------------------------


def _feed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The whole card feed as a batch, and its older part as the loaded ledger."""
    feed = r.card_feed(spark, sf)
    return feed, feed.filter(F.col("ship_date") < F.lit(LOADED_BEFORE).cast("date"))


_FEED_OUT = ["account_id", "source_file", "source_row", "external_ref", "amount"]


@query
def dedupe_positional(spark, sf):
    return dd.dedupe_positional(*_feed(spark, sf)).select(*_FEED_OUT)


@query
def dedupe_by_reference(spark, sf):
    return dd.dedupe_by_reference(*_feed(spark, sf)).select(*_FEED_OUT)


@query
def dedupe_cross_format(spark, sf):
    return dd.dedupe_cross_format(*_feed(spark, sf)).select(*_FEED_OUT)


@query
def dedupe_card_feed(spark, sf):
    return dd.dedupe_card_feed(*_feed(spark, sf)).select(*_FEED_OUT)


@query
def dedupe_by_id(spark, sf):
    batch, loaded = _feed(spark, sf)
    mark = F.concat_ws("/", "external_ref", F.date_format("date", "yyyyMM"))
    batch = batch.withColumn("external_ref", F.when(F.col("external_ref").isNotNull(), mark))
    loaded = loaded.withColumn("external_ref", F.when(F.col("external_ref").isNotNull(), mark))
    return dd.dedupe_by_id(batch, loaded).select(*_FEED_OUT)


def _snapshot_batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Valuations moved to the first of their month, so keys repeat."""
    snap = b.snapshots(spark, sf).withColumn("source_file", F.coalesce("source_file", F.lit("manual")))
    moved = snap.withColumn("day", F.col("date")).withColumn("date", F.trunc("date", "month"))
    return moved, moved.filter(F.col("day") < F.lit(LOADED_BEFORE).cast("date"))


@query
def dedupe_snapshots(spark, sf):
    return dd.dedupe_snapshots(*_snapshot_batch(spark, sf)).select("id", "account_id", "date", "sub_portfolio")


@query
def dedupe_periods(spark, sf):
    entries = b.alternatives(spark, sf)
    loaded = entries.filter(F.col("period_start") < F.lit(LOADED_BEFORE).cast("date"))
    fresh = dd.dedupe_periods(entries, loaded, ["account_id", "period_start", "period_end"])
    return fresh.select("account_id", "period_start", "period_end", "net_income")


@query
def dedupe_equity(spark, sf):
    entries = b.equity(spark, sf)
    loaded = entries.filter(F.col("date") < F.lit("2024-01-15").cast("date"))
    return dd.dedupe_periods(entries, loaded, ["account_id", "date"]).select("id", "account_id", "date")


@query
def append_statements(spark, sf):
    all_rows = b.statements(spark, sf)
    loaded = all_rows.filter(F.col("period_end") < F.lit(LOADED_BEFORE).cast("date"))
    return dd.append_statements(all_rows, loaded).select("account_id", "source_file", "opening", "closing")


@query
def append_new(spark, sf):
    rows = b.ledger(spark, sf)
    loaded = rows.filter(F.col("date") < F.lit(LOADED_BEFORE).cast("date"))
    path = _fresh_folder(spark, "ledger")
    added = ingest.append_new(dd.dedupe_positional(rows, loaded), path)
    written = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    return written.groupBy("month").agg(
        F.count("*").alias("rows"), F.sum("amount").alias("amount"), F.lit(added).cast("long").alias("added")
    )


def _card_folder(spark: SparkSession, sf: str) -> str:
    """Card rows as CSV files of the feed's layout, some of which hold a date that is none."""
    rows, path = r.card_rows(spark, sf), _fresh_folder(spark, "cards")
    printed = [c if c in rows.columns else None for c in readers.CARD_COLUMNS]
    cells = [F.col(f"`{c}`") if c else F.lit("").alias(n) for c, n in zip(printed, readers.CARD_COLUMNS)]
    rows.select(*cells).write.option("header", True).option("emptyValue", "").csv(path)
    broken = b.table(spark, sf, "region").select(
        *[(F.col("r_name") if c == "Fecha de Compra" else F.lit("1.00")).alias(c) for c in readers.CARD_COLUMNS]
    )
    broken.coalesce(1).write.mode("append").option("header", True).csv(path)
    return path


@query
def ingest_feed_rows(spark, sf):
    rows, _ = feeds.ingest_feed(spark, "card", _card_folder(spark, sf))
    return rows.groupBy("date").agg(
        F.count("*").alias("rows"), F.sum("amount").alias("amount"), F.count("external_ref").alias("with_reference")
    )


@query
def ingest_feed_status(spark, sf):
    """Files are named by the writer, so they are added up by their state."""
    _, status = feeds.ingest_feed(spark, "card", _card_folder(spark, sf))
    return status.groupBy("status", "error").agg(F.sum("rows").alias("rows"))


def _streamed_twice(spark: SparkSession, staged: DataFrame) -> DataFrame:
    """Staged rows as a stream of files, loaded twice: the second time adds nothing."""
    inbox, path = _fresh_folder(spark, "inbox"), _fresh_folder(spark, "stream")
    staged.write.parquet(inbox)
    for run in ("first", "second"):
        source = spark.readStream.schema(staged.schema).parquet(inbox)
        ingest_stream(source, path, f"{path}-{run}", dd.dedupe_by_reference).awaitTermination()
    return read_table(spark, path).groupBy("account_id").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))


@query
def ingest_stream_rows(spark, sf):
    """Rows with a reference only; ``ingest_stream_ledger`` streams the whole ledger."""
    staged = schema.align_schema(b.ledger(spark, sf), schema.TRANSACTION)
    return _streamed_twice(spark, staged.filter(F.col("external_ref").isNotNull()))


@query
def ingest_stream_ledger(spark, sf):
    """The whole ledger; rows without a reference are known by file and row."""
    return _streamed_twice(spark, schema.align_schema(b.ledger(spark, sf), schema.TRANSACTION))


@query
def upsert_dimension(spark, sf):
    known = b.accounts(spark, sf)
    key = F.col("s_suppkey")
    incoming = b.table(spark, sf, "supplier").select(
        F.concat(F.lit("Customer#"), F.lpad((key * 20).cast("string"), 9, "0")).alias("name"),
        (key + 1_000_000).alias("account_id"),
        F.lit("New bank").alias("institution"),
        (key % 28 + 1).cast("int").alias("statement_cutoff_day"),
        (key % 2 == 0).alias("is_credit_card"),
    )
    out = ingest.upsert_dimension(
        known, incoming, ["name"],
        ["is_credit_card", "statement_cutoff_day", "payment_due_offset_days", "payment_due_offset_type"],
    )
    return out.select(
        "account_id", "name", "institution", "statement_cutoff_day", "is_credit_card", "payment_due_offset_days"
    )


@query
def overlay_manual(spark, sf):
    snap = b.snapshots(spark, sf)
    odd = F.col("id") % 2
    manual = snap.select(
        (-F.col("id") - 1).alias("id"),
        "account_id",
        F.date_add("date", odd.cast("int")).alias("date"),
        "sub_portfolio",
        "market_value",
        "currency",
        F.lit(None).cast("string").alias("source_file"),
    )
    out = ingest.overlay_manual(snap, manual, ["account_id", "date", "sub_portfolio"])
    return out.select("id", "account_id", "date", "sub_portfolio", "market_value", "source_file")


@query
def resolve_account(spark, sf):
    rows = readers.stage_xml_block(r.xml_texts(spark, sf))
    code = F.when(F.col("external_ref").endswith("77"), F.lit("C-unknown")).otherwise(F.col("contract"))
    out = ingest.resolve_account(rows.withColumn("contract", code), b.accounts(spark, sf))
    return out.select("source_file", "line_no", "contract", "account_id", "rejected")


# --- Reconciliation ----------------------------------------------------------


@query
def check_totals(spark, sf):
    return rc.check_totals(b.statement_movements(spark, sf), b.statements(spark, sf))


@query
def check_delta(spark, sf):
    return rc.check_delta(b.statement_movements(spark, sf), b.statements(spark, sf))


def _card_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as card statements whose balance equation breaks for some keys."""
    o = r.orders(spark, sf)
    key, total = F.col("key"), F.col("total")
    cents = lambda e: e.cast("decimal(14,2)")
    rows = o.select(
        "account_id",
        "source_file",
        "key",
        F.col("date").alias("cutoff_date"),
        cents(total - 100).alias("opening"),
        cents(total * F.lit("0.5").cast("decimal(2,1)")).alias("regular_charges"),
        cents(F.lit(25)).alias("instalments"),
        cents(key % 7).alias("interest"),
        cents(key % 5).alias("fees"),
        cents(key % 3).alias("tax"),
        cents(key % 400).alias("payments"),
    )
    closing = sum((F.col(c) for c in ("regular_charges", "instalments", "interest", "fees", "tax")), F.col("opening"))
    fault = F.when(key % 41 == 0, F.lit("0.02").cast("decimal(4,2)")).when(key % 43 == 0, F.lit("0.01").cast("decimal(4,2)"))
    return rows.withColumn(
        "closing", cents(closing - F.col("payments") + F.coalesce(fault, F.lit("0.00").cast("decimal(4,2)")))
    )


def _card_movements(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as rows of those statements: fees, disclosures and purchases."""
    item = b.table(spark, sf, "lineitem")
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = item.join(orders, item.l_orderkey == orders.o_orderkey)
    line = F.col("l_linenumber")
    fee = line == 1
    return rows.select(
        F.col("o_custkey").alias("account_id"),
        r.order_file().alias("source_file"),
        F.when(fee, "RECARGO ZETA POR PAGO TARDIO")
        .when(line == 2, "TIENDA A 03 MESES S/I")
        .when(line == 3, "02 DE 03 ANUALIDAD")
        .otherwise("COMPRA")
        .alias("description"),
        F.when(fee, F.lit("-1.00").cast("decimal(14,2)")).otherwise(-b.money("l_extendedprice")).alias("amount"),
    )


@query
def check_equation(spark, sf):
    return rc.check_equation(_card_statements(spark, sf))


FEE = "RECARGO ZETA"


@query
def check_totals_excluding_fees(spark, sf):
    fee = t.matches(F.col("description"), FEE)
    return rc.movement_totals(_card_movements(spark, sf), fee).select("account_id", "source_file", "charges", "charge_count")


@query
def check_fee_remainder(spark, sf):
    return rc.check_fee_remainder(_card_statements(spark, sf), _card_movements(spark, sf), FEE)


@query
def synthesize_costs(spark, sf):
    return rc.synthesize_costs(
        _card_statements(spark, sf), _card_movements(spark, sf), FEE, "Costos del resumen"
    )


@query
def drop_disclosures(spark, sf):
    flagged = rc.flag_disclosures(_card_movements(spark, sf), f"{rc.ENROLMENT}|{rc.DISCLOSURE}")
    kept = rc.drop_disclosures(flagged)
    return kept.groupBy("description").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))


@query
def check_components(spark, sf):
    """Line items as parts of their order; the order's printed total is their sum
    with a fault for some keys."""
    item = b.table(spark, sf, "lineitem")
    parts = item.select(
        F.col("l_suppkey").alias("account_id"),
        F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("source_file"),
        b.money("l_extendedprice").alias("value"),
    )
    printed = parts.groupBy("account_id", "source_file").agg(F.sum("value").alias("total"))
    wrong = F.col("account_id") % 13 == 0
    printed = printed.withColumn("total", F.col("total") + F.when(wrong, 1).otherwise(0))
    return rc.check_components(parts, printed)


@query
def check_product(spark, sf):
    rows = ex.extract_regex_rows(
        r.portfolio_lines(spark, sf), PORTFOLIO_ROW, PORTFOLIO_COLUMNS, PORTFOLIO_COLUMNS[2:]
    ).withColumnRenamed("line_no", "account_id")
    return rc.check_product(rows, F.col("units"), F.col("unit_value"), F.col("market_value"), "0.05")


@query
def check_share(spark, sf):
    rows = b.alternatives(spark, sf).select(
        "account_id",
        F.date_format("period_start", "yyyy-MM").alias("source_file"),
        "net_income",
        "participation_pct",
        F.round(F.col("proportional_income") + F.when(F.col("account_id") % 9 == 0, 2).otherwise(0), 0).alias("printed"),
    )
    return rc.check_product(rows, F.col("net_income"), F.col("participation_pct"), F.col("printed"), "1.00", "share")


@query
def previous_statement(spark, sf):
    return rc.previous_statement(b.statements(spark, sf)).select(
        "account_id", "source_file", "opening", "previous_file", "previous_closing"
    )


@query
def check_chain(spark, sf):
    return rc.check_chain(b.statements(spark, sf))


@query
def check_chain_known_gaps(spark, sf):
    rows = b.statements(spark, sf)
    gaps = rc.previous_statement(rows.select(*rc.CHAIN)).filter((F.col("account_id") % 46 == 0) & F.col("previous_closing").isNotNull())
    return rc.check_chain(rows, gaps.select("account_id", "previous_closing", "opening"))


@query
def check_chain_full(spark, sf):
    return rc.check_chain(b.statements(spark, sf), full=True)


@query
def next_statement(spark, sf):
    return rc.next_statement(b.statements(spark, sf)).select("account_id", "source_file", "closing", "next_file", "next_opening")


def _all_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of all statements. The statements are made once, and what one check shuffles is removed before the next."""
    with scratch(spark) as keep:
        rows = written(b.statements(spark, sf))
        chain = in_rounds(rc.check_chain, "account_id", rows, write=keep)
        own = in_rounds(rc.check_statement, "account_id", b.statement_movements(spark, sf), rows, write=keep)
    return own.unionByName(chain)


@query
def import_report(spark, sf):
    return rc.import_report(b.statement_movements(spark, sf), _all_checks(spark, sf))


@query
def accepted_movements(spark, sf):
    kept = rc.accept(b.statement_movements(spark, sf), _all_checks(spark, sf))
    return kept.groupBy("account_id").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))


@query
def quarantined_movements(spark, sf):
    held = rc.quarantine(b.statement_movements(spark, sf), _all_checks(spark, sf))
    return held.groupBy("account_id").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))


# Fixed formats of the rendered statement.
STATEMENT = st.Layout(
    feed="checking",
    fields={
        "account_id": r"^Cuenta: (\d+)$",
        "period_start": r"^Periodo: (\S+) al \S+$",
        "period_end": r"^Periodo: \S+ al (\S+)$",
        "opening": r"^Saldo Anterior (-?[\d,]+\.\d{2})$",
        "closing": r"^Saldo Final (-?[\d,]+\.\d{2})$",
        "printed_charges": r"^Cargos ([\d,]+\.\d{2}) en \d+$",
        "n_charges": r"^Cargos [\d,]+\.\d{2} en (\d+)$",
        "printed_credits": r"^Abonos ([\d,]+\.\d{2}) en \d+$",
        "n_credits": r"^Abonos [\d,]+\.\d{2} en (\d+)$",
    },
    date_kind="dd/MM/y",
    table_on=r"^DETALLE DE MOVIMIENTOS$",
    table_off=r"^TOTAL DE MOVIMIENTOS$",
    row=r"^(\d{2})/([A-Z]{3})\s+(\d{2})/([A-Z]{3})\s+(.*?)\s([+-])\s\$([\d,]+\.\d{2})$",
)


def _imported(spark: SparkSession, sf: str) -> st.Imported:
    """All statements as a batch; those before the cut are registered already."""
    cut = F.lit(LOADED_BEFORE).cast("date")
    known = b.statements(spark, sf).filter(F.col("period_end") < cut)
    # The rows of the registered files are loaded, and those of every seventh account.
    in_file = Window.partitionBy("account_id", "source_file").orderBy("source_row")
    rows = b.statement_movements(spark, sf).withColumn("source_row", F.row_number().over(in_file) - 1)
    loaded = rows.filter((F.last_day("op_date") < cut) | (F.col("account_id") % 7 == 3))
    return st.import_statements(r.statement_lines(spark, sf), STATEMENT, loaded, known, block=2 * ID_BLOCK)


@query
def import_statement_report(spark, sf):
    return _imported(spark, sf).report


@query
def import_statement_rows(spark, sf):
    rows = _imported(spark, sf).movements
    return rows.groupBy("account_id", "op_date").agg(
        F.count("*").alias("rows"),
        F.sum("amount").alias("amount"),
        F.count("external_ref").alias("with_reference"),
        F.max("description").alias("last_description"),
    )


@query
def registered_statements(spark, sf):
    return _imported(spark, sf).statements.select("account_id", "source_file", "period_start", "period_end", "opening", "closing")


_NEW_MONEY, _OLD_MONEY = r"(\$-?[\d,]+\.\d{2})$", r"(\$ -?[\d,]+\.\d{2})$"
# Fixed formats of the two rendered card layouts.
NEW_CARD = cs.CardLayout(
    name="nova",
    marker="TARJETA NOVA",
    fields={
        "account_id": r"^Cuenta: (\d+)$",
        "period_start": r"^Periodo: (\S+) al \S+$",
        "period_end": r"^Periodo: \S+ al (\S+)$",
        "cutoff_date": r"^Corte: (\S+)$",
        "opening": r"^Deuda previa " + _NEW_MONEY,
        "regular": r"^Consumos del mes " + _NEW_MONEY,
        "instalments": r"^Consumos a plazos " + _NEW_MONEY,
        "interest": r"^Interes del mes " + _NEW_MONEY,
        "fees": r"^Comision del mes " + _NEW_MONEY,
        "tax": r"^Impuesto del mes " + _NEW_MONEY,
        "payments": r"^Abonos del mes " + _NEW_MONEY,
        "closing": r"^Deuda al corte " + _NEW_MONEY,
        "table_charges": r"^SUMA CONSUMOS " + _NEW_MONEY,
        "table_credits": r"^SUMA ABONOS " + _NEW_MONEY,
    },
    date_kind="dd-mmm-y",
    table_on=r"^MOVIMIENTOS NOVA$",
    table_off=r"^SUMA CONSUMOS ",
    row=r"^(\d{2}-[a-z]{3}-\d{4}) (\d{2}-[a-z]{3}-\d{4}) (.*?) ([+-]) (\$[\d,]+\.\d{2})$",
    disclosure=rc.ENROLMENT,
    disclosures_counted=True,
    fee=r"RECARGO ZETA",
)
OLD_CARD = cs.CardLayout(
    name="azul",
    marker="TARJETA AZUL",
    fields={
        "account_id": r"^Cuenta: (\d+)$",
        "period_start": r"^Periodo: (\S+) al \S+$",
        "period_end": r"^Periodo: \S+ al (\S+)$",
        "cutoff_date": r"^Corte: (\S+)$",
        "opening": r"^Inicio " + _OLD_MONEY,
        "bought": r"^Compras mes " + _OLD_MONEY,
        "other_charges": r"^Cargos varios " + _OLD_MONEY,
        "instalments": r"^Compras plazos " + _OLD_MONEY,
        "interest": r"^Interes " + _OLD_MONEY,
        "fees": r"^Comision " + _OLD_MONEY,
        "tax": r"^Impuesto " + _OLD_MONEY,
        "paid": r"^Pagos " + _OLD_MONEY,
        "other_credits": r"^Abonos varios " + _OLD_MONEY,
        "closing": r"^Saldo corte " + _OLD_MONEY,
    },
    parts={"regular": ("bought", "other_charges"), "payments": ("paid", "other_credits")},
    date_kind="dd/MM/y",
    table_on=r"^Movimientos Azul$",
    table_off=r"^TOTAL AZUL",
    row=r"^(\d{2}/\d{2}/\d{4}) (\d{2}/\d{2}/\d{4}) (.*?) ()(\$ [\d,]+\.\d{2})$",
    disclosure=rc.DISCLOSURE,
    disclosures_counted=False,
    tolerance="0.02",
)


def _cards(spark: SparkSession, sf: str) -> st.Imported:
    """All card statements as a batch. Those before the cut are registered and their rows
    loaded already, as are the rows of every eleventh key."""
    heads = written(rcards.card_heads(spark, sf))
    cut = F.col("period_end") < F.lit(LOADED_BEFORE).cast("date")
    place = Window.partitionBy("key").orderBy("line_no")
    rows = rcards.card_rows(spark, sf).withColumn("source_row", (F.row_number().over(place) - 1).cast("int"))
    loaded = rows.join(heads.filter(cut | (F.col("key") % 11 == 0)).select("key", "account_id", "source_file"), "key")
    lines = rcards.card_lines(spark, sf, heads)
    return cs.import_cards(lines, [NEW_CARD, OLD_CARD], loaded, heads.filter(cut), block=2**33)


@query
def import_card_report(spark, sf):
    return _cards(spark, sf).report


@query
def import_card_rows(spark, sf):
    return _cards(spark, sf).movements.groupBy("account_id", "op_date").agg(
        F.count("*").alias("rows"),
        F.sum("amount").alias("amount"),
        F.count_if(F.col("description") == cs.COSTS).alias("from_summary"),
        F.max("description").alias("last_description"),
    )


@query
def evolved_ledger(spark, sf):
    """A table that gained a column: its old part has no tag column at all."""
    rows = b.ledger(spark, sf)
    cut = F.col("date") < F.lit(LOADED_BEFORE).cast("date")
    both = schema.union_evolved(rows.filter(cut).drop("spend_frequency"), rows.filter(~cut))
    full = schema.align_schema(both, schema.TRANSACTION, {"benefit_tag": "none"})
    return full.groupBy("spend_frequency", "benefit_tag").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))


# --- Wealth ------------------------------------------------------------------


@query
def latest_snapshot(spark, sf):
    return wl.latest_snapshot(b.snapshots(spark, sf)).select(
        "account_id", "sub_portfolio", "id", "date", "market_value", "currency"
    )


@query
def latest_equity(spark, sf):
    return wl.latest_equity(b.equity(spark, sf)).select("account_id", "id", "date", "market_value")


@query
def account_balance(spark, sf):
    return _balances(spark, sf).select("account_id", "owner_id", "balance", "currency", "manual")


@query
def account_balance_by_currency(spark, sf):
    return _balances(spark, sf, "by_currency").select("account_id", "currency", "balance", "manual")


@query
def net_worth(spark, sf):
    return wl.net_worth(_balances(spark, sf))


@query
def net_worth_by_currency(spark, sf):
    return wl.net_worth(_balances(spark, sf, "by_currency"))


@query
def net_worth_by_account(spark, sf):
    out = wl.net_worth_by_account(_balances(spark, sf))
    return out.withColumn("caveats", F.array_join("caveats", "|"))


@query
def distribution_return(spark, sf):
    """Suppliers as fixed-principal accounts."""
    principal = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("account_id"), (F.abs(b.money("s_acctbal")) + 1000).alias("principal")
    )
    return wl.distribution_return(b.alternatives(spark, sf), principal)


def _running(spark: SparkSession, sf: str, anchors: DataFrame | None = None) -> DataFrame:
    return wl.running_balance(b.ledger(spark, sf), anchors, ID_BLOCK).select("id", "account_id", "date", "amount", "balance")


@query
def running_balance(spark, sf):
    return _running(spark, sf)


@query
def running_balance_anchored(spark, sf):
    opening = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"), b.money("c_acctbal").alias("opening")
    )
    return _running(spark, sf, opening)


# --- Goals -------------------------------------------------------------------


@query
def savings_goal(spark, sf):
    return goals.savings_goal(_monthly(spark, sf))


@query
def savings_goal_summary(spark, sf):
    return goals.savings_goal_summary(goals.savings_goal(_monthly(spark, sf)))


@query
def current_streak(spark, sf):
    return goals.current_streak(goals.savings_goal(_monthly(spark, sf)))


@query
def trailing_window(spark, sf):
    return goals.trailing_window(_monthly(spark, sf), AS_OF).select("owner_id", "currency", "month", "income", "fijo_total")


@query
def projection_basis(spark, sf):
    return goals.projection_basis(_monthly(spark, sf), AS_OF)


def _projection(spark: SparkSession, sf: str) -> DataFrame:
    worth = wl.net_worth(_balances(spark, sf)).filter(F.col("currency") == "MXN")
    years = (2001, 2002, 2000)
    return goals.savings_projection(
        _monthly(spark, sf), worth.select("owner_id", F.col("total").alias("current_net_worth")), AS_OF, years=years
    )


@query
def savings_projection(spark, sf):
    return _projection(spark, sf)


@query
def scenario_budget(spark, sf):
    return goals.scenario_budget(_projection(spark, sf))


@query
def scenario_matrix(spark, sf):
    return goals.scenario_matrix(_projection(spark, sf))


# --- Extraction --------------------------------------------------------------

# Fixed formats: rows of an investment summary and its detail section.
PORTFOLIO_ROW = r"^(\d{3}[A-Z]{3})\s+(.+?)\s+([\d,]+\.\d+)\s+([\d,]+\.\d+)\s+([\d,]+\.\d+)\s+([\d,]+\.\d+)$"
PORTFOLIO_COLUMNS = ["code", "name", "contributions", "units", "unit_value", "market_value"]
GROUP_HEADER = r"^(\d{3}[A-Z]{3})\s+([A-Za-zÀ-ÿ\s]+)$"
DETAIL_ROW = r"^(\d{2})/(\d{2})/(\d{4})\s+(.+?)\s+([\d,]+\.\d+)$"


@query
def extract_regex_rows(spark, sf):
    return ex.extract_regex_rows(
        r.portfolio_lines(spark, sf), PORTFOLIO_ROW, PORTFOLIO_COLUMNS, PORTFOLIO_COLUMNS[2:]
    )


@query
def extract_signed_rows(spark, sf):
    return ex.extract_signed_rows(r.signed_lines(spark, sf))


@query
def extract_scoped_rows(spark, sf):
    return ex.extract_scoped_rows(
        r.scoped_lines(spark, sf), "Detail of contributions", GROUP_HEADER, DETAIL_ROW, "Agent:", block=ID_BLOCK
    )


@query
def extract_activity_rows(spark, sf):
    return ex.extract_activity_rows(r.activity_lines(spark, sf))


TOTAL_FIELDS = {
    "opening": r"Saldo Anterior\s+([\d,]+\.\d{2})",
    "closing": r"Saldo Final\s+([\d,]+\.\d{2})",
    "charges": r"SUMA DE CARGOS\s+([\d,]+\.\d{2})\s+RENGLONES DE CARGOS\s+\d+",
    "n_charges": r"SUMA DE CARGOS\s+[\d,]+\.\d{2}\s+RENGLONES DE CARGOS\s+(\d+)",
}


@query
def extract_fields(spark, sf):
    f = ex.extract_fields(r.total_docs(spark, sf), TOTAL_FIELDS)
    return f.select(
        "source_file",
        m.parse_money(F.col("opening")).alias("opening"),
        m.parse_money(F.col("closing")).alias("closing"),
        m.parse_money(F.col("charges")).alias("charges"),
        F.col("n_charges").try_cast("int").alias("n_charges"),
        F.array_join("missing", ",").alias("missing"),
    )


@query
def extract_label_amount(spark, sf):
    return ex.extract_label_amount(r.income_lines(spark, sf), "Utilidad de operación")


TEMPLATES = {"modern": "é", "legacy": " the "}


@query
def detect_template(spark, sf):
    return ex.detect_template(r.document_texts(spark, sf), TEMPLATES)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return ex.split_lines(r.document_texts(spark, sf))


START, ON, OFF = r"^[AEIOU]", r"^[AEIOU]", r"^[RST]"


@query
def assemble_records(spark, sf):
    out = ex.assemble_records(_lines(spark, sf), F.col("text").rlike(START))
    return out.select(
        "source_file", "record_no", "first_line", "n_lines", "start_text", F.md5("raw_text").alias("raw_md5")
    )


@query
def table_region(spark, sf):
    kept = ex.table_region(_lines(spark, sf), F.col("text").rlike(ON), F.col("text").rlike(OFF))
    return kept.select("source_file", "line_no", F.md5("text").alias("text_md5"))


@query
def table_region_once(spark, sf):
    kept = ex.table_region(_lines(spark, sf), F.col("text").rlike(ON), F.col("text").rlike(OFF), once=True)
    return kept.groupBy("source_file").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"))


@query
def fill_dates(spark, sf):
    rows = b.ledger(spark, sf).withColumn("printed", F.when(~F.col("source_row").isin(2, 5), F.col("date")))
    filled = ex.fill_dates(rows, ["account_id"], "id", F.col("printed"), ID_BLOCK, ["date", "amount"])
    return filled.select("id", "account_id", "printed", "filled_date")


@query
def statement_period(spark, sf):
    docs = r.period_docs(spark, sf)
    token = r"(\d{2}-[a-zé]{3}-\d{4})"
    kinds = {
        "labels": ex.period_from_labels(docs, rf"Periodo:\s*{token}\s+al\s+{token}", "dd-mmm-y"),
        "days": ex.period_from_days(docs, rf"Corte:\s*{token}", "dd-mmm-y", r"Dias del periodo:\s*(\d+)"),
        "file_name": ex.period_from_file_name(docs, "|".join(dates.MONTH_FULL)),
    }
    out = None
    for kind, df in kinds.items():
        rows = df.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def words_to_lines(spark, sf):
    out = layout.words_to_lines(r.document_words(spark, sf))
    return out.select("source_file", "page", F.col("anchor").alias("top"), "n_words", F.md5("text").alias("text_md5"))


@query
def words_to_rounded_lines(spark, sf):
    words = r.document_words(spark, sf).withColumn("top", F.col("top") + 0.5)
    return layout.words_to_rounded_lines(words).select(
        "source_file", "page", "line_top", "n_words", F.md5("text").alias("text_md5")
    )


@query
def column_bounds(spark, sf):
    return layout.column_bounds(r.header_words(spark, sf), r.COLUMN_LABELS)


@query
def classify_columns(spark, sf):
    bounds = layout.column_bounds(r.header_words(spark, sf), r.COLUMN_LABELS)
    out = layout.classify_columns(r.amount_words(spark, sf), bounds, r.COLUMN_LABELS)
    return out.groupBy("source_file", "column").agg(
        F.count("*").alias("n"), F.sum(m.parse_money(F.col("text"))).alias("amount")
    )


@query
def column_streams(spark, sf):
    out = layout.column_streams(r.document_words(spark, sf), {"left": (0, 40), "mid": (40, 90), "right": (90, 1e9)})
    return out.select("source_file", "page", "stream", F.md5("text").alias("text_md5"))


@query
def headerless_page_end(spark, sf):
    words = r.document_words(spark, sf).withColumn("text", F.lower("text"))
    kept = ex.end_at_headerless_page(words, ["the", "of"])
    return kept.groupBy("source_file").agg(F.count("*").alias("n_words"), F.max("page").alias("last_page"))


@query
def nearest_value(spark, sf):
    words = r.label_words(spark, sf)
    labels = layout.first_labels(words, ["TOTAL:"])
    out = layout.nearest_value(words, labels, F.startswith("text", F.lit("$")))
    return out.select("source_file", m.parse_money(F.col("value"), "dash_zero").alias("value"))


@query
def stage_card_rows(spark, sf):
    out = readers.stage_card_rows(r.card_rows(spark, sf))
    return out.select(
        "source_file",
        "source_row",
        "date",
        "post_date",
        "amount",
        "description",
        F.col("foreign_amount.amount").alias("foreign_amount"),
        F.col("foreign_amount.currency").alias("foreign_currency"),
        "external_ref",
    )


@query
def stage_sectioned_balances(spark, sf):
    return readers.stage_sectioned_balances(r.sectioned_texts(spark, sf))


@query
def stage_sectioned_movements(spark, sf):
    return readers.stage_sectioned_movements(r.sectioned_texts(spark, sf), "Fecha")


@query
def stage_xml_block(spark, sf):
    return readers.stage_xml_block(r.xml_texts(spark, sf))


# --- Scalars -----------------------------------------------------------------


@query
def parse_money(spark, sf):
    o = r.orders(spark, sf)
    text, total = r.printed(F.col("total")), F.col("key")
    return o.select(
        "key",
        m.parse_money(F.concat(text, F.lit(" USD"))).alias("suffix"),
        m.parse_money(F.concat(F.when(total % 2 == 0, "-$").otherwise("+$"), text), "signed").alias("signed"),
        m.parse_money(F.concat(F.lit("($"), text, F.lit(")")), "paren").alias("paren"),
        m.parse_money(F.concat(text, F.lit("-")), "trailing").alias("trailing"),
        m.parse_money(F.concat(text, F.lit("-")), "unsigned").alias("unsigned"),
        m.parse_money(F.concat(F.substring(text, 1, 1), F.lit(" "), F.substring(text, F.lit(2), F.length(text))), "spaced").alias("spaced"),
        m.parse_money(F.when(total % 3 == 0, "$ -").otherwise(F.concat(F.lit("$ "), text)), "dash_zero").alias("dash_zero"),
        m.parse_money(F.when(total % 5 == 0, F.lit("n/a")).otherwise(text)).alias("unreadable"),
    )


@query
def parse_dates(spark, sf):
    o = r.orders(spark, sf)
    d, mon = F.col("date"), r.month_name(F.col("date"))
    day, year = F.date_format(d, "dd"), F.date_format(d, "yyyy")
    return o.select(
        "key",
        dates.parse_date_token(F.concat_ws("-", day, F.upper(mon), year), "dd-mmm-y").alias("dashed"),
        dates.parse_date_token(F.date_format(d, "dd/MM/yyyy"), "dd/MM/y").alias("slashed"),
        dates.parse_date_token(F.date_format(d, "dd-MM-yyyy"), "dd-MM-yyyy").alias("numeric"),
        dates.parse_date_token(F.concat_ws(" ", F.date_format(d, "d"), mon, year), "d mmm yyyy").alias("spaced"),
        dates.parse_date_token(F.date_format(d, "M/d/yyyy"), "M/d/y").alias("us"),
        dates.parse_date_token(F.concat_ws("/", F.lit("31"), F.date_format(d, "MM"), year), "dd/MM/y").alias("day_31"),
        dates.month_number(r.month_name(d, dates.MONTH_FULL)).alias("month_number"),
    )


@query
def resolve_year(spark, sf):
    o = r.orders(spark, sf)
    d = F.col("date")
    start, end = F.date_sub(d, (F.col("key") % 25).cast("int")), F.date_add(d, (F.col("key") % 28).cast("int"))
    out = dates.resolve_day_month(F.day(d), dates.month_number(r.month_name(d)), start, end)
    return o.select("key", out.alias("resolved"))


@query
def card_dates(spark, sf):
    o = r.orders(spark, sf)
    key = F.col("key")
    cutoff = dates.next_cutoff(F.col("date"), (1 + key % 31).cast("int"))
    days = (key % 23).cast("int")
    return o.select(
        "key",
        cutoff.alias("cutoff"),
        dates.add_business_days(F.col("date"), days).alias("business"),
        dates.due_date(cutoff, days, F.when(key % 2 == 0, "natural").otherwise("habil")).alias("due"),
        dates.months_to_year_end(F.col("date"), F.lit(1998)).alias("months_left"),
    )


@query
def fold_accents(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(t.fold_accents(F.col("text"))).alias("folded_md5"))


@query
def text_functions(spark, sf):
    rows = b.ledger(spark, sf, text=True)
    text = F.concat(F.lit("Pago Referencia "), F.coalesce(F.lpad("external_ref", 8, "0"), F.lit("123")), F.lit(" fin /REFA"), F.col("source_file"))
    return rows.select(
        "id",
        t.haystack(F.col("raw_description"), F.col("description")).alias("haystack"),
        t.file_extension(F.concat(F.lit("/in.box/"), F.upper("source_file"))).alias("extension"),
        t.file_name(F.concat(F.lit("/in.box/"), "source_file")).alias("base_name"),
        t.reference_after(text).alias("reference"),
        t.reference_slash(text).alias("slash_reference"),
        t.labelled(F.col("spend_frequency"), t.FREQUENCY_LABEL).alias("frequency"),
    )
