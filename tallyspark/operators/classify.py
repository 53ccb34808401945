"""Ordered rules that give a ledger row its category and its fixed/variable tag.

Rules are data. They compile to one chain of conditions with literal patterns,
so a row is classified in a single narrow stage: no join, no shuffle, and each
pattern is compiled once. Adjacent text-only rules of one category and stage are
merged into one alternation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions.text import fold_accents, haystack, matches
from tallyspark.operators.reports import is_spend
from tallyspark.plans.small import small



@dataclass(frozen=True)
class Rule:
    """One rule; ``stage`` then ``priority`` decide the order, the first hit wins.

    ``pattern`` and ``pattern2`` must both be found in the text. ``abs_amount``
    stands in for the text: within a cent of it, the row matches without it.
    Dates are inclusive, NULL is open. ``sign`` is +1 or -1 for rows in or out.
    ``fold`` searches accent-folded text; accounts in ``exclude_accounts`` are
    never matched.
    """

    rule_id: int
    stage: int
    priority: int
    category: str
    pattern: str | None = None
    pattern2: str | None = None
    valid_from: date | None = None
    valid_until: date | None = None
    sign: int | None = None
    abs_amount: Decimal | None = None
    fold: bool = False
    exclude_accounts: tuple[str, ...] = field(default=())

    @property
    def text_only(self) -> bool:
        return self.pattern is not None and not (
            self.pattern2
            or self.valid_from
            or self.valid_until
            or self.sign
            or self.abs_amount is not None
            or self.exclude_accounts
        )


def rules_from_table(rules: DataFrame, limit: int | None = None) -> list[Rule]:
    """Read a rule table into rules; with ``limit``, a longer one is an error."""
    rows = (rules if limit is None else rules.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    names = set(Rule.__dataclass_fields__)
    out = []
    for row in rows:
        values = {k: v for k, v in row.asDict().items() if k in names and v is not None}
        values["exclude_accounts"] = tuple(values.get("exclude_accounts", ()))
        out.append(Rule(**values))
    return out


def ordered(rules: Iterable[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (r.stage, r.priority, r.rule_id))


_TEXT, _FOLDED = "_text", "_folded"


def with_text(ledger: DataFrame, rules: Iterable[Rule] = ()) -> DataFrame:
    """Add the searched text once, so that each rule does not build it again."""
    out = ledger.withColumn(_TEXT, haystack(F.col("raw_description"), F.col("description")))
    if any(r.fold for r in rules):
        out = out.withColumn(_FOLDED, fold_accents(F.col(_TEXT)))
    return out


def condition(rule: Rule) -> Column:
    """The rule as a boolean column over ``with_text`` rows; never NULL."""
    words = F.col(_FOLDED if rule.fold else _TEXT)
    hits = F.lit(True)
    if rule.pattern is not None:
        hits = matches(words, rule.pattern)
    if rule.abs_amount is not None:
        near = F.abs(F.abs(F.col("amount")) - F.lit(rule.abs_amount)) < F.lit(Decimal("0.01"))
        hits = near if rule.pattern is None else hits | near
    parts = [hits]
    if rule.pattern2 is not None:
        parts.append(matches(words, rule.pattern2))
    if rule.valid_from is not None:
        parts.append(F.col("date") >= F.lit(rule.valid_from))
    if rule.valid_until is not None:
        parts.append(F.col("date") <= F.lit(rule.valid_until))
    if rule.sign is not None:
        parts.append(F.col("amount") > 0 if rule.sign > 0 else F.col("amount") < 0)
    if rule.exclude_accounts:
        parts.append(~F.col("account").isin(*rule.exclude_accounts))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return F.coalesce(out, F.lit(False))


def merged(rules: Sequence[Rule]) -> list[Rule]:
    """Join neighbours that differ only in their pattern."""
    out: list[Rule] = []
    for rule in ordered(rules):
        last = out[-1] if out else None
        if (
            last is not None
            and last.text_only
            and rule.text_only
            and (last.stage, last.category, last.fold) == (rule.stage, rule.category, rule.fold)
        ):
            out[-1] = Rule(
                last.rule_id, last.stage, last.priority, last.category,
                pattern=f"{last.pattern}|(?:{rule.pattern})", fold=last.fold,
            )
        elif rule.text_only:
            out.append(
                Rule(rule.rule_id, rule.stage, rule.priority, rule.category, pattern=f"(?:{rule.pattern})", fold=rule.fold)
            )
        else:
            out.append(rule)
    return out


#: Rules that one combined pattern stands before.
RUN = 16


def _runs(rules: Sequence[Rule]) -> list[list[Rule]]:
    """Neighbours that can share a guard: a row that their patterns joined by "or" do not
    match is hit by none of them."""
    out: list[list[Rule]] = []
    for rule in rules:
        guarded = rule.pattern is not None and rule.abs_amount is None
        last = out[-1][-1] if out else None
        joins = last is not None and last.pattern is not None and last.abs_amount is None and last.fold == rule.fold
        if guarded and joins and len(out[-1]) < RUN:
            out[-1].append(rule)
        else:
            out.append([rule])
    return out


def _guard(run: Sequence[Rule]) -> Column:
    """Whether any rule of a run can hit. One pattern costs one reading of the text."""
    if len(run) == 1:
        return F.lit(True)
    words = F.col(_FOLDED if run[0].fold else _TEXT)
    return F.coalesce(matches(words, "|".join(f"(?:{r.pattern})" for r in run)), F.lit(False))


def _first_hit(rules: Sequence[Rule], result) -> Column:
    listed = merged(rules)
    if not listed:
        return F.lit(None)
    found = []
    for run in _runs(listed):
        chain = None
        for rule in run:
            # In a struct, as a rule may give NULL and still end the search.
            value = F.struct(result(rule).alias("v"))
            chain = F.when(condition(rule), value) if chain is None else chain.when(condition(rule), value)
        found.append(chain if len(run) == 1 else F.when(_guard(run), chain))
    return F.coalesce(*found)["v"]


def matched_category(rules: Sequence[Rule]) -> Column:
    """Category name of the first rule that hits ``with_text`` rows, NULL without one."""
    return _first_hit(rules, lambda r: F.lit(r.category)).cast("string")


def category_ids(rules: Iterable[Rule], categories: DataFrame) -> dict[str, int]:
    """Ids of the categories that the rules name (at most one per rule).

    Of categories that share a name the one with the greatest id counts. A name that
    does not exist is absent.
    """
    wanted = sorted({r.category for r in rules})
    named = categories.filter(F.col("name").isin(*wanted)).groupBy("name").agg(F.max("category_id").alias("category_id"))
    rows = named.collect()
    return {r["name"]: r["category_id"] for r in rows}


def classify(ledger: DataFrame, rules: Sequence[Rule], categories: DataFrame) -> DataFrame:
    """Give rows without a category the one of their first matching rule.

    A rule whose category does not exist leaves its rows without one; later rules
    are not tried. Ids are literals in the chain, so nothing is joined.
    """
    ids = category_ids(rules, categories)
    found = _first_hit(rules, lambda r: F.lit(ids.get(r.category)).cast("long")).cast("long")
    rows = with_text(ledger, rules)
    return rows.withColumn(
        "category_id", F.when(F.col("category_id").isNotNull(), F.col("category_id")).otherwise(found)
    ).select(*ledger.columns)


def classify_transfers(
    ledger: DataFrame,
    accounts: DataFrame,
    patterns: Sequence[str],
    category: str,
    categories: DataFrame,
    exclude_accounts: Sequence[str] = (),
) -> DataFrame:
    """Own transfers by the holder's identity in accent-folded text.

    Accounts that print the holder on every row are left out. Without patterns
    nothing is classified.
    """
    if not patterns:
        return ledger
    rule = Rule(
        0, 0, 0, category,
        pattern="|".join(f"(?:{p})" for p in patterns), fold=True, exclude_accounts=tuple(exclude_accounts),
    )
    if not exclude_accounts:
        return classify(ledger, [rule], categories)
    excluded = accounts.filter(F.col("name").isin(*exclude_accounts)).select(
        "account_id", F.col("name").alias("account")
    )
    named = ledger.join(small(excluded), "account_id", "left").withColumn("account", F.coalesce("account", F.lit("")))
    return classify(named, [rule], categories).select(*ledger.columns)


def tag_frequency(ledger: DataFrame, categories: DataFrame, fixed_patterns: Sequence[str]) -> DataFrame:
    """Tag untagged spending rows as fixed or variable by their text."""
    kinds = categories.select("category_id", F.col("kind").alias("_kind"))
    joined = with_text(ledger).join(small(kinds), "category_id", "left")
    fixed = matches(F.col(_TEXT), "|".join(f"(?:{p})" for p in fixed_patterns)) if fixed_patterns else F.lit(False)
    untagged = F.col("spend_frequency").isNull() & is_spend(F.col("_kind"), F.col("category_id"), F.col("amount"))
    tag = F.when(untagged, F.when(fixed, "fijo").otherwise("variable")).otherwise(F.col("spend_frequency"))
    return joined.withColumn("spend_frequency", tag).select(*ledger.columns)


def classify_all(
    ledger: DataFrame,
    accounts: DataFrame,
    categories: DataFrame,
    holder_patterns: Sequence[str],
    transfer_category: str,
    rules: Sequence[Rule],
    fixed_patterns: Sequence[str],
    exclude_accounts: Sequence[str] = (),
    trace: bool = False,
) -> DataFrame:
    """Transfers, then rules, then tags. Running it again changes nothing.

    ``trace`` adds ``step`` (transfer or rule, where a category was given) and
    ``newly_tagged``.
    """
    rows = ledger.withColumn("_c0", F.col("category_id")).withColumn("_f0", F.col("spend_frequency"))
    rows = classify_transfers(rows, accounts, holder_patterns, transfer_category, categories, exclude_accounts)
    rows = rows.withColumn("_c1", F.col("category_id"))
    rows = tag_frequency(classify(rows, rules, categories), categories, fixed_patterns)
    if not trace:
        return rows.select(*ledger.columns)
    given = F.col("_c0").isNull() & F.col("category_id").isNotNull()
    return rows.select(
        *ledger.columns,
        F.when(given, F.when(F.col("_c1").isNotNull(), "transfer").otherwise("rule")).alias("step"),
        (F.col("_f0").isNull() & F.col("spend_frequency").isNotNull()).alias("newly_tagged"),
    )


def classification_counts(traced: DataFrame) -> DataFrame:
    """Rows that each step of a traced run has classified or tagged."""
    return traced.agg(
        F.count_if(F.col("step") == "transfer").alias("transfers_classified"),
        F.count_if(F.col("step") == "rule").alias("merchants_classified"),
        F.count_if(F.col("newly_tagged")).alias("spend_frequency_tagged"),
    )


def rule_audit(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per rule: rows it would hit, rows it hits first, and whether earlier rules
    take them all (``shadowed``) or nothing matches (``zero_hit``).

    Rows are counted by the list of rules they hit. Few lists differ, and each costs
    one partial count a task; only the counted lists are spread out. No row of the ledger
    is multiplied.
    """
    listed = ordered(rules)
    open_rows = with_text(ledger.filter(F.col("category_id").isNull()), listed)
    found, i = [], 0
    for run in _runs(listed):
        hits = F.array_compact(F.array(*[F.when(condition(r), F.lit(i + k)) for k, r in enumerate(run)]))
        found.append(hits if len(run) == 1 else F.when(_guard(run), hits).otherwise(F.array().cast("array<int>")))
        i += len(run)
    lists = open_rows.select(F.concat(*found).alias("hits")).groupBy("hits").agg(F.count("*").alias("n"))
    spread_out = lists.select(F.posexplode("hits").alias("place", "rule"), "n")
    counts = spread_out.groupBy("rule").agg(
        F.sum("n").alias("any_hits"), F.sum(F.when(F.col("place") == 0, F.col("n")).otherwise(0)).alias("first_hits")
    )
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("rule"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"))
            for i, r in enumerate(listed)
        ]
    )
    named = ledger.sparkSession.range(1).select(F.inline(entries)).join(counts, "rule", "left")
    rows = named.select(
        F.struct(
            "rule_id",
            "category",
            F.coalesce("any_hits", F.lit(0)).alias("any_hits"),
            F.coalesce("first_hits", F.lit(0)).alias("first_hits"),
        ).alias("r")
    )
    return rows.select(
        "r.*",
        (F.col("r.any_hits") == 0).alias("zero_hit"),
        ((F.col("r.any_hits") > 0) & (F.col("r.first_hits") == 0)).alias("shadowed"),
    )
