from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import extract as ex, layout


def D(x):
    return Decimal(x)


def lines(spark, *texts, file="f"):
    return spark.createDataFrame([(file, i, t) for i, t in enumerate(texts)], "source_file string, line_no long, text string").repartition(3)


def test_fields_and_missing_names(spark):
    docs = spark.createDataFrame([("a", "Opening\n1,000.00 Closing 5.00"), ("b", "Closing 7.00")], "source_file string, text string")
    out = {r["source_file"]: r for r in ex.extract_fields(docs, {"o": r"Opening\s+([\d,.]+)", "c": r"Closing\s+([\d,.]+)"}).collect()}
    assert (out["a"]["o"], out["a"]["missing"]) == ("1,000.00", [])
    assert (out["b"]["o"], out["b"]["missing"]) == (None, ["o"])


def test_scoped_rows(spark):
    df = lines(
        spark,
        "Agent: early", "001ABC Before", "01/01/2024 Pay 1.00", "Detail here", "02/01/2024 orphan 5.00", "001ABC Alpha", "03/01/2024 Pay 10.00",
        "noise", "04/01/2024 Pay 1,000.50", "999ZZZ Unlisted", "05/01/2024 Pay 2.00", "002ABC Beta", "06/01/2024 Pay 3.00",
        "Agent: x", "001ABC Alpha", "07/01/2024 Pay 99.00",
    )
    header, row = r"^(\d{3}[A-Z]{3})\s+([A-Za-z\s]+)$", r"^(\d{2})/(\d{2})/(\d{4})\s+(.+?)\s+([\d,]+\.\d+)$"
    known = spark.createDataFrame([("f", "001ABC"), ("f", "002ABC")], "source_file string, code string")
    out = ex.extract_scoped_rows(df, "Detail", header, row, "Agent:", known, block=4).collect()
    assert {r["code"]: r["amount"] for r in out} == {"001ABC": D("1012.50"), "002ABC": D("3.00")}


def test_activity_rows(spark):
    df = lines(spark, "1/5/24 Payroll Credit $5.00 $1,100.25", "1/6/24 Release 2.5 $10.00", "1/7/24 Payroll Credit none", "1/8/24 Release 3", "x 1/9/24 Release 1 1.0")
    r = ex.extract_activity_rows(df).first()
    assert (r["own_contribution"], r["vested_units"], r["company_match"]) == (D("1100.25"), D("2.5"), D("25"))


def test_label_amount(spark):
    def got(*texts):
        row = ex.extract_label_amount(lines(spark, *texts), "Repartición neta").first()
        return None if row is None else row["amount"]

    assert got("x", "REPARTICION NETA total $ 7 15,208 MXN 7") == D("715208")
    assert got("repartición neta $ -") == 0 and got("repartición neta") == 0
    assert got("repartición neta $ -5.50 $ 3") == D("-5.50")
    assert got("other $ 1") is None


def test_signed_rows(spark):
    out = {r["description"]: r["amount"] for r in ex.extract_signed_rows(lines(spark, "PARK - LANTERN + $1,000.00 x", "PAGO - $5.00", "MOSS - PARK 5.00")).collect()}
    assert out == {"PARK - LANTERN": D("-1000.00"), "PAGO": D("5.00")}


def test_template_needs_exactly_one_marker(spark):
    docs = spark.createDataFrame([("a", "x NEW x"), ("b", "OLD"), ("c", "NEW OLD"), ("d", "-")], "source_file string, text string")
    out = {r["source_file"]: r["template"] for r in ex.detect_template(docs, {"new": "NEW", "old": "OLD"}).collect()}
    assert out == {"a": "new", "b": "old", "c": None, "d": None}


def test_records_and_region(spark):
    df = lines(spark, "head", "S one", "more", "S two", "tail", "tail 2")
    out = {r["record_no"]: (r["first_line"], r["n_lines"], r["raw_text"]) for r in ex.assemble_records(df, F.startswith("text", F.lit("S "))).collect()}
    assert out == {0: (1, 2, "S one\nmore"), 1: (3, 3, "S two\ntail\ntail 2")}
    marks = lines(spark, "a", "ON", "b", "OFF", "c", "ON", "d")
    on, off = F.col("text") == "ON", F.col("text") == "OFF"
    assert sorted(r["text"] for r in ex.table_region(marks, on, off).collect()) == ["b", "d"]
    assert [r["text"] for r in ex.table_region(marks, on, off, once=True).collect()] == ["b"]


def test_fill_dates(spark):
    days = [None, date(2024, 1, 2), None, None, date(2024, 1, 1), None]
    df = spark.createDataFrame([("f", i, d) for i, d in enumerate(days)], "source_file string, row int, day date")
    out = ex.fill_dates(df, ["source_file"], "row", F.col("day"), block=2).orderBy("row").collect()
    assert [r["filled_date"] for r in out] == [None, days[1], days[1], days[1], days[4], days[4]]


def test_periods(spark):
    docs = spark.createDataFrame([("Junio 24.pdf", "periodo de 2024\nDel 03-feb-24 al 02-mar-24\nDias: 29")], "source_file string, text string")
    token = r"(\d{2}-[a-z]{3}-\d{2})"
    p = ex.period_from_labels(docs, rf"Del {token} al {token}", "dd-mmm-y").first()
    assert (p["period_start"], p["period_end"]) == (date(2024, 2, 3), date(2024, 3, 2))
    p = ex.period_from_days(docs, rf"al {token}", "dd-mmm-y", r"Dias: (\d+)").first()
    assert p["period_start"] == date(2024, 2, 3)
    p = ex.period_from_file_name(docs, "junio|julio").first()
    assert (p["period_start"], p["period_end"]) == (date(2024, 6, 1), date(2024, 6, 30))


WORD = "source_file string, page int, word_no int, text string, x0 double, x1 double, top double"


def fold(words, tolerance=3.0):
    """Lines anchored at their first word, read left to right."""
    out = []
    for w in sorted(words, key=lambda w: (w[6], w[4])):
        if out and abs(out[-1][0][6] - w[6]) <= tolerance:
            out[-1].append(w)
        else:
            out.append([w])
    return sorted(" ".join(w[3] for w in sorted(line, key=lambda w: w[4])) for line in out)


@pytest.mark.parametrize("seed", range(3))
def test_lines_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    words = [("f", 1, i, f"w{i}", float(i * 7 % 300), 0.0, rng.randint(0, 120) / 2) for i in range(80)]
    df = spark.createDataFrame(words, WORD).repartition(4)
    assert sorted(r["text"] for r in layout.words_to_lines(df).collect()) == fold(words)
    kept = [w for w in words if not 50 <= w[4] < 100]
    got = layout.words_to_lines(df, skip_x=(50, 100)).collect()
    assert sorted(r["text"] for r in got) == fold(kept)


def test_lines_of_many_heights(spark):
    """Heights without a gap, far more than a page has, and heights that all stand apart."""
    rng = random.Random(9)
    words = [("f", 1, i, f"w{i}", float(i), 0.0, round(rng.uniform(0, 3_000), 3)) for i in range(10_000)]
    assert sorted(r["text"] for r in layout.words_to_lines(spark.createDataFrame(words, WORD)).collect()) == fold(words)
    apart = spark.range(10_000).selectExpr("'f' source_file", "1 page", "int(id) word_no", "'w' text", "0D x0", "0D x1", "id * 4D top")
    assert layout.words_to_lines(apart).count() == 10_000


def test_drifting_words_start_a_new_line(spark):
    words = [("f", 1, i, t, float(i), 0.0, top) for i, (t, top) in enumerate([("a", 0.0), ("b", 2.0), ("c", 4.0), ("d", 6.0)])]
    got = layout.words_to_lines(spark.createDataFrame(words, WORD)).collect()
    assert sorted(r["text"] for r in got) == ["a b", "c d"]


def test_rounded_lines_use_half_even(spark):
    words = [("f", 1, 0, "a", 0.0, 0.0, 0.5), ("f", 1, 1, "b", 1.0, 0.0, 1.5), ("f", 1, 2, "c", 2.0, 0.0, 2.5)]
    got = layout.words_to_rounded_lines(spark.createDataFrame(words, WORD)).collect()
    assert sorted((r["line_top"], r["text"]) for r in got) == [(0, "a"), (2, "b c")]


def test_columns(spark):
    labels = ["IN", "OUT"]
    words = [
        ("f", 1, 0, "IN", 10.0, 0.0, 0.0), ("f", 2, 0, "IN", 20.0, 0.0, 0.0), ("f", 2, 1, "OUT", 40.0, 0.0, 0.0), ("f", 3, 0, "IN", 90.0, 0.0, 0.0),
        ("f", 3, 1, "OUT", 99.0, 0.0, 0.0),
    ]
    bounds = layout.column_bounds(spark.createDataFrame(words, WORD), labels)
    assert [tuple(r) for r in bounds.collect()] == [("f", 20.0, 40.0)]
    numbers = [("f", 1, i, "n", 0.0, x, 0.0) for i, x in enumerate([19.9, 20.0, 39.9, 40.0, 999.0])]
    got = layout.classify_columns(spark.createDataFrame(numbers, WORD), bounds, labels).orderBy("word_no").collect()
    assert [r["column"] for r in got] == ["unknown", "IN", "IN", "OUT", "OUT"]


def test_nearest_value_prefers_height_then_order(spark):
    words = [
        ("f", 1, 0, "TOTAL:", 0.0, 50.0, 100.0), ("f", 1, 1, "$1", 60.0, 0.0, 108.0), ("f", 1, 2, "$2", 60.0, 0.0, 103.0), ("f", 1, 3, "$3", 70.0, 0.0, 97.0),
        ("f", 1, 4, "$4", 40.0, 0.0, 100.0), ("f", 1, 5, "5", 60.0, 0.0, 100.0), ("f", 2, 0, "TOTAL:", 0.0, 50.0, 100.0), ("f", 2, 1, "$9", 60.0, 0.0, 108.5),
    ]
    df = spark.createDataFrame(words, WORD)
    out = layout.nearest_value(df, layout.first_labels(df, ["TOTAL:"]), F.startswith("text", F.lit("$"))).collect()
    assert {r["page"]: r["value"] for r in out} == {1: "$2", 2: None}


def test_table_ends_at_the_first_page_without_headers(spark):
    words = [("f", p, 0, t, 0.0, 0.0, 0.0) for p, t in [(1, "x"), (2, "H"), (3, "H"), (4, "x"), (5, "H")]]
    got = ex.end_at_headerless_page(spark.createDataFrame(words, WORD), ["H"]).collect()
    assert sorted(r["page"] for r in got) == [2, 3]


def test_words_cross_the_network_once(spark):
    """Also words without a height or page, which are on no line."""
    words = [("f", 1, 0, "a", 0.0, 0.0, 1.0), ("f", 1, 1, None, None, 0.0, 2.0), ("f", 1, 2, "c", 2.0, 0.0, None), ("f", None, 3, "d", 3.0, 0.0, 1.0)]
    df = spark.createDataFrame(words, WORD)
    ways = [layout.words_to_lines(df), layout.words_to_rounded_lines(df), layout.column_streams(df, {"all": (0, 9)})]
    for out in ways:
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = [sorted((str(r["page"]), r["text"]) for r in out.collect()) for out in ways]
    assert got == [[("1", "a")], [("1", ""), ("1", "a"), ("1", "c"), ("None", "d")], [("1", "c a"), ("None", "d")]]
