"""Statement checks and the all-or-nothing split into valid and quarantined files.

Checks are rows (account_id, source_file, check, expected, actual, tolerance, ok).
Movements are summed per statement before they meet the printed figures, so the
join has one row per statement on either side.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyspark.functions.money import SUM, within
from tallyspark.functions.text import matches
from tallyspark.plans.ordered import carry_forward
from tallyspark.plans.scan import scan_in_order

KEY = ["account_id", "source_file"]
CHAIN = [*KEY, "period_start", "period_end", "opening", "closing"]
CENT = "0.01"


def _row(name: str, expected: Column, actual: Column, tolerance: str) -> Column:
    e, a = expected.cast(SUM), actual.cast(SUM)
    return F.struct(
        F.lit(name).alias("check"),
        e.alias("expected"),
        a.alias("actual"),
        F.lit(tolerance).cast("decimal(6,2)").alias("tolerance"),
        F.coalesce(within(e, a, tolerance), F.lit(False)).alias("ok"),
    )


def _checks(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(*KEY, F.explode(F.array(*rows)).alias("c")).select(*KEY, "c.*")


def movement_totals(movements: DataFrame, left_out: Column | None = None) -> DataFrame:
    """Charges, credits, their counts and the net of each statement file.

    ``left_out`` marks rows that the printed totals do not contain, e.g. fees
    that are itemised elsewhere or disclosure rows.
    """
    amount = F.col("amount")
    rows = movements if left_out is None else movements.filter(~F.coalesce(left_out, F.lit(False)))
    return rows.groupBy(*KEY).agg(
        F.sum(F.when(amount < 0, -amount).otherwise(0)).cast(SUM).alias("charges"),
        F.sum(F.when(amount > 0, amount).otherwise(0)).cast(SUM).alias("credits"),
        F.count_if(amount < 0).alias("charge_count"),
        F.count_if(amount > 0).alias("credit_count"),
        F.sum(amount).cast(SUM).alias("delta"),
    )


def _on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the key, NULL as a value: a file whose account could not be read has a NULL
    account and still meets its own rows. The key crosses the network once, as it is."""
    other = right.withColumnsRenamed({c: f"_other_{c}" for c in KEY})
    same = [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in KEY]
    joined = left.join(other, same[0] & same[1], how)
    if how == "full":
        joined = joined.withColumns({c: F.coalesce(c, f"_other_{c}") for c in KEY})
    return joined.drop(*[f"_other_{c}" for c in KEY])


def _against(statements: DataFrame, totals: DataFrame) -> DataFrame:
    joined = _on_key(statements, totals, "left")
    return joined.na.fill(0, ["charges", "credits", "charge_count", "credit_count", "delta"])


def check_totals(
    movements: DataFrame,
    statements: DataFrame,
    left_out: Column | None = None,
    tolerance: str = CENT,
    counts: bool = True,
) -> DataFrame:
    """Sums (and counts) of charges and credits against the printed ones."""
    both = _against(statements, movement_totals(movements, left_out))
    rows = [
        _row("charges", F.col("printed_charges"), F.col("charges"), tolerance),
        _row("credits", F.col("printed_credits"), F.col("credits"), tolerance),
    ]
    if counts:
        rows += [
            _row("charge_count", F.col("n_charges"), F.col("charge_count"), "0.00"),
            _row("credit_count", F.col("n_credits"), F.col("credit_count"), "0.00"),
        ]
    return _checks(both, rows)


def check_delta(movements: DataFrame, statements: DataFrame, tolerance: str = CENT) -> DataFrame:
    """Sum of the movements against closing minus opening."""
    both = _against(statements, movement_totals(movements))
    return _checks(both, [_row("delta", F.col("closing") - F.col("opening"), F.col("delta"), tolerance)])


def check_statement(movements: DataFrame, statements: DataFrame, tolerance: str = CENT) -> DataFrame:
    """Totals, counts and delta from one pass over the movements."""
    both = _against(statements, movement_totals(movements))
    return _checks(
        both,
        [
            _row("charges", F.col("printed_charges"), F.col("charges"), tolerance),
            _row("credits", F.col("printed_credits"), F.col("credits"), tolerance),
            _row("charge_count", F.col("n_charges"), F.col("charge_count"), "0.00"),
            _row("credit_count", F.col("n_credits"), F.col("credit_count"), "0.00"),
            _row("delta", F.col("closing") - F.col("opening"), F.col("delta"), tolerance),
        ],
    )


def check_equation(statements: DataFrame, tolerance: str = CENT) -> DataFrame:
    """opening + charges + instalments + interest + fees + tax - payments = closing."""
    plus = [F.col(c) for c in ("opening", "regular_charges", "instalments", "interest", "fees", "tax")]
    total = plus[0]
    for c in plus[1:]:
        total = total + c
    return _checks(statements, [_row("equation", F.col("closing"), total - F.col("payments"), tolerance)])


def check_components(components: DataFrame, printed: DataFrame, tolerance: str = CENT) -> DataFrame:
    """Parts (``value``) summed per statement against the printed ``total``."""
    summed = components.groupBy(*KEY).agg(F.sum("value").cast(SUM).alias("summed"))
    both = printed.join(summed, KEY, "left")
    return _checks(both, [_row("components", F.col("total"), F.coalesce("summed", F.lit(0)), tolerance)])


def check_product(
    rows: DataFrame, left: Column, right: Column, printed: Column, tolerance: str, name: str = "product"
) -> DataFrame:
    """left x right, rounded to cents, against the printed value of each row."""
    return _checks(rows, [_row(name, printed, F.round(left * right, 2), tolerance)])


def _type(df: DataFrame, column: Column) -> T.DataType:
    return df.select(column).schema[0].dataType


def _neighbour(statements: DataFrame, forward: bool) -> DataFrame:
    """Each statement with the nearest other one of its account, behind or ahead, as a struct.

    Ends and starts are laid on one time line per account; what is looked for is carried
    along the line to where it is needed, backwards for what lies ahead. Years cut the
    line, so no pairs are formed and no account is one task.
    """
    mine, other = ("period_end", "period_start") if forward else ("period_start", "period_end")
    # A statement without the date is nobody's neighbour; its row comes first on the line.
    far = F.when(F.col(other).isNotNull(), F.struct("source_file", F.col("opening" if forward else "closing").alias("balance")))
    row = F.struct(*statements.columns)
    none = lambda column: F.lit(None).cast(_type(statements, column))
    day = lambda c: F.unix_date(F.col(c)) * (-1 if forward else 1)
    events = F.array(
        F.struct(day(other).alias("_at"), F.lit(0).alias("_kind"), far.alias("_far"), none(row).alias("_row")),
        F.struct(day(mine).alias("_at"), F.lit(1).alias("_kind"), none(far).alias("_far"), row.alias("_row")),
    )
    line = statements.select("account_id", F.col("source_file").alias("_file"), F.inline(events)).withColumn(
        "_year", F.floor(F.col("_at") / 366)
    )
    carried = carry_forward(line, ["account_id"], "_year", ["_at", "_kind", "_file"], F.col("_far"), "_near")
    return carried.filter(F.col("_kind") == 1).select("_row.*", F.col("_near"))


def previous_statement(statements: DataFrame) -> DataFrame:
    """Add ``previous_file`` and ``previous_closing``: the statement of the same
    account with the latest period end on or before this period start."""
    near = _neighbour(statements, forward=False)
    return near.select(
        *statements.columns,
        F.col("_near.source_file").alias("previous_file"),
        F.col("_near.balance").alias("previous_closing"),
    )


def next_statement(statements: DataFrame) -> DataFrame:
    """Add ``next_file`` and ``next_opening``: the statement of the same account with the
    earliest period start on or after this period end."""
    near = _neighbour(statements, forward=True)
    return near.select(
        *statements.columns,
        F.col("_near.source_file").alias("next_file"),
        F.col("_near.balance").alias("next_opening"),
    )


def _known_break(rows: DataFrame, known_gaps: DataFrame | None, closing: str, opening: str) -> DataFrame:
    """Add ``_known``: whether (account, closing, opening) is an accepted break."""
    if known_gaps is None:
        return rows.withColumn("_known", F.lit(False))
    key = lambda account, c, o: F.struct(F.col(account), F.col(c).cast(SUM).alias("c"), F.col(o).cast(SUM).alias("o"))
    gaps = known_gaps.select(key("account_id", "previous_closing", "opening").alias("_gap"), F.lit(True).alias("_known")).distinct()
    marked = rows.withColumn("_gap", key("account_id", closing, opening)).join(gaps, "_gap", "left").drop("_gap")
    return marked.withColumn("_known", F.coalesce("_known", F.lit(False)))


def _links(rows: DataFrame, name: str, expected: str, actual: str, tolerance: str) -> DataFrame:
    found = rows.select(*KEY, _row(name, F.col(expected), F.col(actual), tolerance).alias("c"), "_known")
    return found.select(*KEY, "c.check", "c.expected", "c.actual", "c.tolerance", (F.col("c.ok") | F.col("_known")).alias("ok"))


def check_chain(
    statements: DataFrame, known_gaps: DataFrame | None = None, tolerance: str = CENT, full: bool = False
) -> DataFrame:
    """Previous closing against this opening; statements without one are left out.

    ``known_gaps`` (account_id, previous_closing, opening) lists accepted breaks. With
    ``full`` every statement is also held against the one after it (``chain_next``: this
    closing against that opening), so a file that was filled in later is checked on both
    sides. Only the columns of the chain are carried.
    """
    statements = statements.select(*CHAIN)
    rows = _known_break(
        previous_statement(statements).filter("previous_file is not null"), known_gaps, "previous_closing", "opening"
    )
    checks = _links(rows, "chain", "previous_closing", "opening", tolerance)
    if full:
        ahead = _known_break(next_statement(statements).filter("next_file is not null"), known_gaps, "closing", "next_opening")
        checks = checks.unionByName(_links(ahead, "chain_next", "closing", "next_opening", tolerance))
    return checks


class _Registered:
    """The registered statements of an account by period end, and its accepted breaks."""

    def __init__(self) -> None:
        self.ends: list[tuple] = []
        self.gaps: set[tuple] = set()


def check_chain_in_order(
    fresh: DataFrame, known: DataFrame, failed: DataFrame, known_gaps: DataFrame | None = None, tolerance: str = CENT
) -> DataFrame:
    """The chain for a batch, as if its files came one after the other by name.

    A file of ``fresh`` that is not in ``failed`` meets the registered statement with the
    latest end on or before its start. Registered are those of ``known`` and the files
    of the batch that came before and were accepted: a rejected or undated file is nobody's
    predecessor, so a hole stays visible to every file behind it. Files in ``failed`` get no
    row. Whether a file is accepted depends on every one before it, so the statements of an
    account are scanned in order; the scan holds one balance per registered statement and
    finds the predecessor by bisection.
    """
    sound = _on_key(fresh, failed.select(*KEY).distinct(), "left_anti").filter(
        "account_id is not null and period_start is not null and period_end is not null"
    )
    nothing = {"string": ["source_file"], "date": ["period_start", "period_end"], SUM: ["opening", "closing"]}
    types = {name: kind for kind, names in nothing.items() for name in names}

    def rows(df: DataFrame, kind: int, **columns: str) -> DataFrame:
        picked = [
            (F.col(columns[n]) if n in columns else F.lit(None)).cast(t).alias(n) for n, t in types.items()
        ]
        return df.select("account_id", F.lit(kind).alias("kind"), *picked)

    dated = known.filter("account_id is not null and period_end is not null")
    line = rows(dated, 1, source_file="source_file", period_end="period_end", closing="closing").unionByName(
        rows(sound, 2, **{n: n for n in types})
    )
    if known_gaps is not None:
        gaps = known_gaps.filter("account_id is not null")
        line = line.unionByName(rows(gaps, 0, closing="previous_closing", opening="opening"))
    limit, last = Decimal(tolerance), "\U0010ffff"

    def step(row: dict, state: _Registered) -> dict | None:
        entry = (row["period_end"], row["source_file"], row["closing"])
        if row["kind"] == 0:
            state.gaps.add((row["closing"], row["opening"]))
            return None
        if row["kind"] == 1:
            insort(state.ends, entry, key=lambda e: e[:2])
            return None
        at = bisect_right(state.ends, (row["period_start"], last), key=lambda e: e[:2])
        if at == 0:
            insort(state.ends, entry, key=lambda e: e[:2])
            return None
        before, opening = state.ends[at - 1][2], row["opening"]
        near = before is not None and opening is not None and abs(before - opening) <= limit
        ok = near or (before, opening) in state.gaps
        if ok:
            insort(state.ends, entry, key=lambda e: e[:2])
        return {"account_id": row["account_id"], "source_file": row["source_file"], "expected": before, "actual": opening, "ok": ok}

    schema = f"account_id long, source_file string, expected {SUM}, actual {SUM}, ok boolean"
    links = scan_in_order(line, "account_id", ["kind", "source_file", "period_start"], _Registered, step, schema)
    return links.select(
        *KEY,
        F.lit("chain").alias("check"),
        "expected",
        "actual",
        F.lit(tolerance).cast("decimal(6,2)").alias("tolerance"),
        "ok",
    )


def itemised_fees(movements: DataFrame, pattern: str) -> DataFrame:
    """Fees that a statement prints both as a row and in its summary."""
    amount = F.col("amount")
    return movements.groupBy(*KEY).agg(
        F.coalesce(
            F.sum(F.when((amount < 0) & matches(F.col("description"), pattern), -amount)), F.lit(0)
        ).cast(SUM).alias("itemised"),
        F.count("*").alias("rows"),
    )


def _cost_remainder(statements: DataFrame, movements: DataFrame, fee_pattern: str) -> DataFrame:
    both = statements.join(itemised_fees(movements, fee_pattern), KEY, "left").na.fill(0, ["itemised", "rows"])
    left = F.col("interest") + F.col("fees") + F.col("tax") - F.col("itemised")
    return both.withColumn("remainder", left.cast(SUM))


def synthesize_costs(statements: DataFrame, movements: DataFrame, fee_pattern: str, description: str) -> DataFrame:
    """One movement per statement for costs that only its summary prints.

    It is dated at the cutoff, numbered after the parsed rows, and left out when
    nothing remains. A negative remainder is an error (``check_fee_remainder``).
    """
    rows = _cost_remainder(statements, movements, fee_pattern).filter(F.col("remainder") > 0)
    return rows.select(
        *KEY,
        F.col("rows").alias("source_row"),
        F.col("cutoff_date").alias("op_date"),
        F.col("cutoff_date").alias("charge_date"),
        F.lit(description).alias("description"),
        (-F.col("remainder")).cast(SUM).alias("amount"),
    )


def check_fee_remainder(statements: DataFrame, movements: DataFrame, fee_pattern: str) -> DataFrame:
    """Itemised fees must not exceed the costs of the summary."""
    rows = _cost_remainder(statements, movements, fee_pattern)
    below = F.least(F.col("remainder"), F.lit(0).cast(SUM))
    return _checks(rows, [_row("fee_remainder", F.lit(0), below, "0.00")])


# Fixed patterns: instalment rows that are shown but are not spending.
ENROLMENT = r"\bA\s+\d{2}\s+MESES\b"
DISCLOSURE = r"^\d{2}\s+DE\s+\d{2}\b"


def flag_disclosures(movements: DataFrame, pattern: str) -> DataFrame:
    return movements.withColumn("is_disclosure", matches(F.col("description"), pattern))


def drop_disclosures(movements: DataFrame) -> DataFrame:
    """Rows that stay after the totals have been checked."""
    return movements.filter(~F.coalesce("is_disclosure", F.lit(False)))


def failed_files(checks: DataFrame) -> DataFrame:
    return checks.filter(~F.col("ok")).select(*KEY).distinct()


def accept(movements: DataFrame, checks: DataFrame) -> DataFrame:
    """Movements of the files that pass every check."""
    return _on_key(movements, failed_files(checks), "left_anti")


def quarantine(movements: DataFrame, checks: DataFrame) -> DataFrame:
    """Movements of the files with a failed check."""
    return _on_key(movements, failed_files(checks), "left_semi")


def import_report(movements: DataFrame, checks: DataFrame) -> DataFrame:
    """Per file: rows taken, or the names of its failed checks."""
    counted = movements.groupBy(*KEY).agg(F.count("*").alias("_rows"))
    failed = checks.groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("check")))).alias("_failed")
    )
    both = _on_key(failed, counted, "full")
    bad = F.coalesce(F.size("_failed"), F.lit(0)) > 0
    return both.select(
        *KEY,
        F.when(bad, "error").otherwise("ok").alias("status"),
        F.when(bad, F.lit(0)).otherwise(F.coalesce("_rows", F.lit(0))).cast("long").alias("rows"),
        F.when(bad, F.array_join("_failed", "; ")).alias("error"),
    )
