from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark import schema
from tallyspark.operators import dedupe as dd, ingest, reconcile as rc, reports
from tallyspark.sources import feeds, readers
from tallyspark.streaming.ingest import ingest_stream, read_table, related

ROW = "account_id long, date date, amount decimal(14,2), external_ref string, source_file string, source_row int"


def D(x):
    return Decimal(x)


def staged(spark, rows):
    return spark.createDataFrame([(1, date(2024, 1, d), D(a), r, f, n) for d, a, r, f, n in rows], ROW)


def places(df):
    return sorted((r["source_file"], r["source_row"]) for r in df.collect())


def import_in_turn(batch, ledger):
    """Files by name, row by row: what a sequential import would insert."""
    refs = {(r[2], r[0], r[1]) for r in ledger if r[2]}
    rows = {(r[3], r[4]) for r in ledger if not r[2]}
    formats = {}
    for r in ledger:
        formats.setdefault((r[0], r[1]), set()).add(r[3].rsplit(".", 1)[1].lower())
    out = []
    for r in sorted(batch, key=lambda r: (r[3], r[4])):
        day, amount, ref, file, row = r
        ext = file.rsplit(".", 1)[1].lower()
        if (ref and (ref, day, amount) in refs) or (not ref and (file, row) in rows):
            continue
        if formats.get((day, amount), set()) - {ext}:
            continue
        if ref:
            refs.add((ref, day, amount))
        formats.setdefault((day, amount), set()).add(ext)
        out.append((file, row))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_card_feed_equals_sequential_import(spark, seed):
    rng = random.Random(seed)

    def make(n, files):
        seen, out = set(), []
        for _ in range(n):
            key = (rng.choice(files), rng.randint(0, 40))
            if key in seen:
                continue
            seen.add(key)
            out.append((rng.randint(1, 4), str(rng.choice([-5, -7, 9])), rng.choice([None, "A", "B"]), *key))
        return out

    ledger = make(12, ["a.csv", "b.pdf", "old.CSV"])
    batch = make(60, ["a.csv", "b.pdf", "c.csv", "d.PDF"])
    got = dd.dedupe_card_feed(staged(spark, batch).repartition(5), staged(spark, ledger))
    assert places(got) == import_in_turn(batch, ledger)


def test_reference_rules(spark):
    batch = [
        (1, "-10", "R", "a.csv", 0),
        (2, "-10", "R", "a.csv", 1),
        (2, "-2", "R", "a.csv", 2),
        (3, "-10", "R", "a.csv", 3),
        (3, "10", "R", "a.csv", 4),
        (4, "-1", None, "a.csv", 5),
        (4, "-1", None, "a.csv", 6),
        (1, "-10", "R", "b.csv", 0),
    ]
    empty = staged(spark, [])
    assert len(places(dd.dedupe_by_reference(staged(spark, batch), empty))) == 7
    assert places(dd.dedupe_by_reference(staged(spark, batch), staged(spark, batch[:5]))) == [("a.csv", 5), ("a.csv", 6)]


def test_second_import_adds_nothing(spark):
    batch = staged(spark, [(1, "-1", None, "a.csv", 0), (1, "-1", None, "a.csv", 1), (2, "-3", "Q", "a.csv", 2)])
    first = dd.dedupe_card_feed(batch, staged(spark, []))
    assert first.count() == 3
    assert dd.dedupe_card_feed(batch, first).count() == 0
    assert dd.dedupe_positional(batch, first).count() == 0


def test_rows_without_number_escape_the_positional_key(spark):
    row = staged(spark, [(1, "-1", None, "a.xml", None)])
    assert dd.dedupe_positional(row, row).count() == 1


def test_snapshots_without_sub_portfolio(spark):
    ddl = "id long, account_id long, date date, sub_portfolio string, source_file string"
    new = spark.createDataFrame(
        [(1, 1, date(2024, 1, 1), None, "a"), (2, 1, date(2024, 1, 1), None, "b"), (3, 1, date(2024, 1, 1), "x", "a")], ddl
    )
    assert {r["id"] for r in dd.dedupe_snapshots(new, new.limit(0)).collect()} == {1, 3}
    assert {r["id"] for r in dd.dedupe_snapshots(new, new.filter("id = 2")).collect()} == {3}


def test_periods_are_never_overwritten(spark):
    ddl = "account_id long, period_start date, period_end date, net int"
    old = spark.createDataFrame([(1, date(2024, 1, 1), date(2024, 1, 31), 5)], ddl)
    new = spark.createDataFrame([(1, date(2024, 1, 1), date(2024, 1, 31), 6), (1, date(2024, 2, 1), date(2024, 2, 29), 7)], ddl)
    out = dd.dedupe_periods(new, old, ["account_id", "period_start", "period_end"]).collect()
    assert [r["net"] for r in out] == [7]


@pytest.mark.parametrize("seed", range(3))
def test_period_entries_equal_sequential_import(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(1, 3), date(2024, 1, rng.randint(1, 4)), f"f{rng.randint(1, 3)}") for i in range(40)]
    known = rows[:5]
    seen, kept = {(r[1], r[2]) for r in known}, []
    for r in sorted(rows[5:], key=lambda r: (r[3], r[0])):
        if (r[1], r[2]) not in seen:
            seen.add((r[1], r[2]))
            kept.append(r[0])
    ddl = "id long, account_id long, date date, source_file string"
    out = dd.dedupe_periods(spark.createDataFrame(rows[5:], ddl), spark.createDataFrame(known, ddl), ["account_id", "date"])
    assert sorted(r["id"] for r in out.collect()) == sorted(kept)


def test_upsert_refreshes_only_listed_columns(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "name string, bank string, day int")
    new = spark.createDataFrame([("a", "z", 9), ("c", "w", 3)], "name string, bank string, day int")
    out = {r["name"]: (r["bank"], r["day"]) for r in ingest.upsert_dimension(old, new, ["name"], ["day"]).collect()}
    assert out == {"a": ("x", 9), "b": ("y", 2), "c": ("w", 3)}


def test_overlay_is_idempotent(spark):
    ddl = "account_id long, date date, sub_portfolio string, source_file string"
    base = spark.createDataFrame([(1, date(2024, 1, 1), None, "a.pdf")], ddl)
    manual = spark.createDataFrame([(1, date(2024, 1, 1), None, None), (2, date(2024, 1, 1), None, None)], ddl)
    keys = ["account_id", "date", "sub_portfolio"]
    once = ingest.overlay_manual(base, manual, keys)
    assert once.count() == 2 and ingest.overlay_manual(once, manual, keys).count() == 2


def test_align_schema_adds_defaults(spark):
    old = spark.createDataFrame([(1, "A")], "account_id long, name string")
    out = schema.align_schema(old, schema.ACCOUNT, {"is_credit_card": False}).first()
    assert out["is_credit_card"] is False and out["statement_cutoff_day"] is None
    both = schema.union_evolved(old, spark.createDataFrame([(2, "B", 5)], "account_id long, name string, day int"))
    assert {r["day"] for r in both.collect()} == {None, 5}


STATEMENT = "account_id long, source_file string, period_start date, period_end date, opening decimal(14,2), closing decimal(14,2), printed_charges decimal(14,2), printed_credits decimal(14,2), n_charges int, n_credits int"


@pytest.fixture
def books(spark):
    statements = spark.createDataFrame(
        [
            (1, "jan.pdf", date(2024, 1, 1), date(2024, 1, 31), D("100"), D("95"), D("15"), D("10"), 2, 1),
            (1, "feb.pdf", date(2024, 1, 31), date(2024, 2, 29), D("95"), D("90"), D("5"), D("0"), 1, 0),
            (1, "mar.pdf", date(2024, 3, 1), date(2024, 3, 31), D("80"), D("80"), D("0"), D("0"), 0, 0),
        ],
        STATEMENT,
    )
    movements = spark.createDataFrame(
        [(1, "jan.pdf", D("-10")), (1, "jan.pdf", D("-5")), (1, "jan.pdf", D("10")), (1, "feb.pdf", D("-5"))],
        "account_id long, source_file string, amount decimal(14,2)",
    )
    return movements, statements


def failed(checks):
    return sorted((r["source_file"], r["check"]) for r in checks.filter("not ok").collect())


def test_clean_statements_pass(books):
    assert failed(rc.check_statement(*books)) == []
    assert failed(rc.check_totals(*books)) == [] and failed(rc.check_delta(*books)) == []


def test_one_missing_row_quarantines_only_its_file(books):
    movements, statements = books
    torn = movements.filter("amount <> -10")
    checks = rc.check_statement(torn, statements)
    assert failed(checks) == [("jan.pdf", "charge_count"), ("jan.pdf", "charges"), ("jan.pdf", "delta")]
    assert {r["source_file"] for r in rc.accept(torn, checks).collect()} == {"feb.pdf"}
    assert rc.quarantine(torn, checks).count() == 2
    report = {r["source_file"]: (r["status"], r["rows"], r["error"]) for r in rc.import_report(torn, checks).collect()}
    assert report["jan.pdf"] == ("error", 0, "charge_count; charges; delta")
    assert report["feb.pdf"] == ("ok", 1, None) and report["mar.pdf"] == ("ok", 0, None)


def test_tolerance_is_a_cent(books):
    movements, statements = books
    near = statements.withColumn("printed_charges", F.col("printed_charges") + F.lit(D("0.01")))
    far = statements.withColumn("printed_charges", F.col("printed_charges") + F.lit(D("0.02")))
    assert failed(rc.check_totals(movements, near)) == []
    assert len(failed(rc.check_totals(movements, far))) == 3


def test_chain_and_known_gap(spark, books):
    _, statements = books
    assert failed(rc.check_chain(statements)) == [("mar.pdf", "chain")]
    gap = spark.createDataFrame([(1, D("90"), D("80"))], "account_id long, previous_closing decimal(14,2), opening decimal(14,2)")
    assert failed(rc.check_chain(statements, gap)) == []
    previous = {r["source_file"]: r["previous_file"] for r in rc.previous_statement(statements).collect()}
    assert previous == {"jan.pdf": None, "feb.pdf": "jan.pdf", "mar.pdf": "feb.pdf"}


def test_synthetic_costs_and_fees(spark):
    statements = spark.createDataFrame(
        [(1, "a", date(2024, 1, 31), D("10"), D("5"), D("1")), (1, "b", date(2024, 1, 31), D("0"), D("3"), D("0")), (1, "c", date(2024, 1, 31), D("0"), D("1"), D("0"))],
        "account_id long, source_file string, cutoff_date date, interest decimal(14,2), fees decimal(14,2), tax decimal(14,2)",
    )
    movements = spark.createDataFrame(
        [(1, "a", D("-4"), "LATE FEE"), (1, "a", D("-9"), "SHOP"), (1, "b", D("-3"), "late fee"), (1, "c", D("-2"), "LATE FEE")],
        "account_id long, source_file string, amount decimal(14,2), description string",
    )
    out = rc.synthesize_costs(statements, movements, "late fee", "costs").collect()
    assert [(r["source_file"], r["source_row"], r["amount"]) for r in out] == [("a", 2, D("-12"))]
    assert failed(rc.check_fee_remainder(statements, movements, "late fee")) == [("c", "fee_remainder")]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


CARD_HEADER = ",".join(readers.CARD_COLUMNS)


def card_line(day, text, amount, ref, foreign=""):
    cells = {"Fecha": day, "Fecha de Compra": day, "Descripción": text, "Importe": amount, "Monto en moneda extranjera": foreign, "Referencia": ref}
    return ",".join('"' + cells.get(c, "").replace('"', '""') + '"' for c in readers.CARD_COLUMNS)


def test_card_feed_folder(spark, tmp_path):
    good = [card_line("02 Jan 2024", f"SHOP {i}", "1,000.50", f"'R{i}'", "5.00 USD") for i in range(3)]
    write(tmp_path / "a.csv", "﻿" + "\n".join([CARD_HEADER, *good]))
    write(tmp_path / "b.CSV", "\n".join([CARD_HEADER, card_line("03 Jan 2024", "two\nlines", "-7.00", "")]))
    write(tmp_path / "bad.csv", "\n".join([CARD_HEADER, card_line("not a date", "x", "1", ""), good[0]]))
    write(tmp_path / "note.txt", "ignored")
    write(tmp_path / "none.csv", CARD_HEADER)
    rows, status = feeds.ingest_feed(spark, "card", str(tmp_path))
    got = {(r["source_file"], r["source_row"]): r for r in rows.collect()}
    assert sorted(got) == [("a.csv", 0), ("a.csv", 1), ("a.csv", 2), ("b.CSV", 0)]
    first = got[("a.csv", 1)]
    assert (first["date"], first["amount"], first["external_ref"]) == (date(2024, 1, 2), D("-1000.50"), "R1")
    assert got[("b.CSV", 0)]["amount"] == D("7.00") and got[("b.CSV", 0)]["external_ref"] is None
    assert "SHOP 1" in first["raw_description"]
    assert [(r["source_file"], r["status"], r["rows"]) for r in status.collect()] == [
        ("a.csv", "ok", 3), ("b.CSV", "ok", 1), ("bad.csv", "error", 0), ("none.csv", "ok", 0),
    ]


def test_units_keep_eight_decimals(spark, tmp_path):
    text = "\r\n".join(["Fecha,Op,,Activo,Sim,Uni,,Fiat", "05/08/2024,Compra,,Bitcoin,BTC,0.00123456,,1.00 USD", "Fecha,Op"])
    write(tmp_path / "r.csv", text, "latin-1")
    rows, status = feeds.ingest_feed(spark, "exchange", str(tmp_path))
    assert [(r["quantity"], r["currency"]) for r in rows.collect()] == [(D("0.00123456"), "BTC")]
    assert [(r["status"], r["rows"]) for r in status.collect()] == [("ok", 1)]


def test_card_rows_keep_their_number_when_a_file_is_split(spark, tmp_path):
    lines = [card_line("02 Jan 2024", f"SHOP {i}", f"{i}.00", "") for i in range(400)]
    write(tmp_path / "big.csv", "\n".join([CARD_HEADER, *lines]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        raw = readers.read_card_rows(spark, str(tmp_path), multi_line=False)
        got = {r["source_row"]: r["Importe"] for r in raw.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: f"{i}.00" for i in range(400)}


def test_unknown_feed(spark, tmp_path):
    with pytest.raises(KeyError):
        feeds.stage_feed(spark, "nope", str(tmp_path))


def test_sectioned_report_in_latin_1(spark, tmp_path):
    text = "\r\n".join(
        [
            "Reporte,,", "x,Periodo,Jul 01 2024 - Ago 31 2024", "n,Activo,2,3,4,5,Saldo,7,Valor",
            'n,"Bitcoin, BTC",2,3,4,5,0.5,7,"1,200.50 USD"', "n,Añil,2,3,4,5,2,7,3.00 USD", ",,,,,,,,", "n,Late,2,3,4,5,9,7,9 USD",
            "Fecha,Op,,Activo,Sim,Uni,,Fiat", '05/08/2024,Compra,,Bitcoin,BTC,0.25,,"$1,000.00 USD"', "total,,,", "06/08/2024,Venta,,Añil,AN,-1,,2.00 USD",
            "Fecha,Op,,Activo,Sim,Uni,,Fiat", "07/08/2024,Otra,,X,X,1,,1.00 USD",
        ]
    )
    write(tmp_path / "r.csv", text, "latin-1")
    texts = readers.read_texts(spark, str(tmp_path), "*.csv", "ISO-8859-1")
    balances = readers.stage_sectioned_balances(texts).collect()
    assert [(r["sub_portfolio"], r["units"], r["market_value"], r["date"]) for r in balances] == [
        ("Bitcoin, BTC", D("0.5"), D("1200.50"), date(2024, 8, 31)), ("Añil", D("2"), D("3.00"), date(2024, 8, 31)),
    ]
    moves = readers.stage_sectioned_movements(texts, "Fecha").orderBy("source_row").collect()
    assert [(r["source_row"], r["description"], r["currency"], r["units"], r["fiat_value"]) for r in moves] == [
        (0, "Compra: Bitcoin", "BTC", D("0.25"), D("1000.00")), (1, "Venta: Añil", "AN", D("-1"), D("2.00")),
    ]


def test_xml_block(spark, tmp_path):
    write(
        tmp_path / "s.xml",
        "<C><Addenda><Movimientos>\nMovimientos:\nContrato, Descripción, Monto, Fecha, Folio\n"
        "K1, Interés, neto, 10.50, 05-01-2024, F1\nK2, Pago, -3, 06-01-2024, F2\na, b\n</Movimientos></Addenda></C>",
    )
    write(tmp_path / "none.xml", "<C><Other/></C>")
    rows = readers.stage_xml_block(readers.read_texts(spark, str(tmp_path), "*.xml")).orderBy("line_no").collect()
    assert [(r["contract"], r["description"], r["amount"], r["date"], r["external_ref"]) for r in rows] == [
        ("K1", "Interés, neto", D("10.50"), date(2024, 1, 5), "F1"), ("K2", "Pago", D("-3.00"), date(2024, 1, 6), "F2"),
    ]


def test_unknown_contract_rejects_its_file(spark):
    rows = spark.createDataFrame([("f1", "K1"), ("f1", "K9"), ("f2", "K1")], "source_file string, contract string")
    accounts = spark.createDataFrame([(7, "Contract K1"), (8, "other")], "account_id long, notes string")
    out = {(r["source_file"], r["contract"]): (r["account_id"], r["rejected"]) for r in ingest.resolve_account(rows, accounts).collect()}
    assert out == {("f1", "K1"): (7, True), ("f1", "K9"): (None, True), ("f2", "K1"): (7, False)}


LEDGER_ROW = "id long, account_id long, date date, amount decimal(14,2), external_ref string, source_file string, source_row int"


def test_append_counts_and_partitions(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = schema.align_schema(
        spark.createDataFrame([(i, 1, date(2024, 1 + i % 2, 1), D(i), None, "a.csv", i) for i in range(10)], LEDGER_ROW),
        schema.TRANSACTION,
    )
    assert ingest.append_new(rows, path) == 10
    fresh = dd.dedupe_positional(rows, read_table(spark, path))
    assert ingest.append_new(fresh, path) == 0
    assert read_table(spark, path).count() == 10
    assert sorted(p.name for p in (tmp_path / "ledger").glob("month=*")) == ["month=2024-01", "month=2024-02"]


def test_stream_loads_each_row_once(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "ledger")
    inbox.mkdir()

    def drop(name, rows):
        spark.createDataFrame(rows, LEDGER_ROW).coalesce(1).write.parquet(str(inbox / name))

    def run(checkpoint):
        source = spark.readStream.schema(LEDGER_ROW).option("recursiveFileLookup", True).parquet(str(inbox))
        ingest_stream(source, table, str(tmp_path / checkpoint)).awaitTermination()
        return read_table(spark, table).count()

    drop("one", [(i, 1, date(2024, 1, 1 + i), D(-i), "R", "a.csv", i) for i in range(5)])
    assert run("c1") == 5
    drop("two", [(9, 1, date(2024, 1, 3), D(-2), "R", "b.csv", 0), (10, 1, date(2024, 2, 1), D(-1), None, "b.csv", 1)])
    assert run("c1") == 6
    # A new checkpoint reads every file again; nothing is loaded twice.
    assert run("c2") == 6


def test_related_rows_cover_months_and_files(spark):
    ddl = f"{LEDGER_ROW}, month string"
    known = spark.createDataFrame(
        [
            (1, 1, date(2024, 1, 1), D(1), "R", "old.csv", 0, "2024-01"),
            (2, 1, date(2023, 5, 1), D(1), None, "a.csv", 0, "2023-05"),
            (3, 1, date(2023, 5, 1), D(1), None, "other.csv", 0, "2023-05"),
        ],
        ddl,
    )
    batch = spark.createDataFrame([(9, 1, date(2024, 1, 9), D(1), None, "a.csv", 0)], LEDGER_ROW)
    assert sorted(r["id"] for r in related(known, batch).collect()) == [1, 2]
    assert related(known, batch.withColumn("date", F.lit(None).cast("date"))).count() == 3


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_export_is_written_whole(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    export = spark.createDataFrame([(1, date(2024, 1, 1), "a,b"), (2, date(2024, 1, 2), "Básico")], "id int, date date, description string")
    reports.write_export(export, path, fmt)
    back = spark.read.option("header", True).format(fmt).load(path)
    assert sorted(r["description"] for r in back.collect()) == ["Básico", "a,b"]


def test_registered_stream_takes_rows_without_a_reference(spark):
    from tallyspark.catalog import QUERIES
    from tallyspark.sources import bindings

    sf = "/root/testdata/sf0.001"
    keys = bindings.ledger(spark, sf).filter("external_ref is null").select("account_id", "source_file", "source_row").distinct()
    loaded = {n: QUERIES[n](spark, sf).agg(F.sum("rows")).first()[0] for n in ("ingest_stream_rows", "ingest_stream_ledger")}
    assert keys.count() > 0 and loaded["ingest_stream_ledger"] == loaded["ingest_stream_rows"] + keys.count()


def test_resolve_account_makes_its_rows_once(spark):
    rows = spark.createDataFrame(
        [("a", "C1"), ("a", "C?"), ("b", "C1"), (None, "C?"), ("c", None)], "source_file string, contract string"
    )
    accounts = spark.createDataFrame([(1, "Contract C1"), (2, "other")], "account_id long, notes string")
    out = ingest.resolve_account(rows.withColumn("contract", F.reverse(F.reverse("contract"))), accounts)
    got = sorted(((r.source_file or "", r.contract or "", r.account_id, r.rejected) for r in out.collect()), key=str)
    assert got == sorted(
        [("", "C?", None, False), ("a", "C1", 1, True), ("a", "C?", None, True), ("b", "C1", 1, False), ("c", "", None, True)],
        key=str,
    )
    assert out._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") == 1


def test_rows_of_one_reference_are_picked_whole(spark):
    """Of rows alike in all that orders them the least stays, whatever order they come in."""
    ddl = ROW + ", description string"
    day = date(2024, 1, 1)
    rows = [
        (1, day, D("1.00"), "x", "a.csv", 0, "two"), (1, day, D("1.00"), "x", "a.csv", 0, "one"), (1, day, D("1.00"), "x", None, 9, "no file"),
        (1, day, D("3.00"), None, "a.csv", 1, "dear"), (1, day, D("2.00"), None, "a.csv", 1, "cheap"), (1, None, None, None, None, None, "bare"),
        (None, day, D("1.00"), "", "r:b.csv", 2, "empty reference"), (2, day, D("1.00"), None, "r:b.csv", 2, None),
    ]
    kept = sorted([rows[2], rows[4], rows[5], rows[6], rows[7]], key=str)
    for batch in (rows, rows[::-1]):
        df = spark.createDataFrame(batch, ddl).coalesce(1)
        assert sorted(map(tuple, dd.dedupe_by_reference(df, df.limit(0)).collect()), key=str) == kept
    for batch in (rows[:2], rows[1::-1]):
        df = spark.createDataFrame(batch, ddl).coalesce(1)
        assert [r["description"] for r in dd.dedupe_by_reference(df, df.limit(0)).collect()] == ["one"]
