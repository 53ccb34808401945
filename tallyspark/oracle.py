"""The same answers in plain SQL for DuckDB, written apart from the Spark plans."""

from __future__ import annotations

from tallyspark import rulebook
from tallyspark.operators.classify import Rule
from tallyspark.sources.bindings import CATEGORIES

_MONTHS = "['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic']"
_MONTHS_FULL = (
    "['enero','febrero','marzo','abril','mayo','junio','julio','agosto',"
    "'septiembre','octubre','noviembre','diciembre']"
)


def _q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_CATEGORY = "category(category_id, name, kind, nature) AS (VALUES " + ", ".join(
    f"({i}, {_q(n)}, {_q(k)}, {_q(t)})" for i, n, k, t in CATEGORIES
) + ")"

_ACCOUNT = """account AS (
  SELECT c_custkey AS account_id, CAST(c_nationkey AS BIGINT) AS owner_id, c_name AS name,
    'Bank ' || n_name AS institution,
    CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'transactional'
         WHEN c_mktsegment = 'AUTOMOBILE' THEN 'investment_formal'
         WHEN c_mktsegment = 'FURNITURE' THEN 'investment_informal' ELSE 'equity_compensation' END AS kind,
    CASE WHEN n_regionkey IN (0,1) THEN 'MXN' WHEN n_regionkey IN (2,3) THEN 'USD' ELSE 'EUR' END AS currency,
    CASE WHEN c_custkey % 10 IN (1,2) THEN c_custkey - c_custkey % 10 END AS parent_account_id,
    c_mktsegment = 'MACHINERY' AS is_credit_card,
    CAST(1 + c_custkey % 31 AS INTEGER) AS statement_cutoff_day,
    CAST(10 + c_custkey % 15 AS INTEGER) AS payment_due_offset_days,
    CASE WHEN c_custkey % 2 = 0 THEN 'natural' ELSE 'habil' END AS payment_due_offset_type,
    CASE WHEN c_custkey % 29 = 0 THEN CAST(50000 AS DECIMAL(14,2)) END AS principal
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

_LEDGER = """priced AS (
  SELECT *, CAST(l_extendedprice AS DECIMAL(14,2)) AS p,
    CASE WHEN l_partkey % 11 <> 0 THEN 1 + l_partkey % 10 END AS category_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
signed AS (
  SELECT *, CAST(p * CASE
      WHEN category_id IS NULL THEN CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END
      WHEN category_id <= 6 THEN CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END
      WHEN category_id = 7 THEN 2 WHEN category_id = 8 THEN 1
      ELSE CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END END AS DECIMAL(14,2)) AS amount
  FROM priced),
ledger AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 509 + l_suppkey) % 1048576 AS id,
    o_custkey AS account_id, CAST(l_shipdate AS DATE) AS date, amount,
    CASE l_suppkey % 20 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'MXN' END AS currency, category_id,
    CASE WHEN (coalesce(category_id <= 6, false) OR (category_id IS NULL AND amount < 0)) AND l_linenumber <> 7
           OR l_partkey % 97 = 0
         THEN CASE WHEN l_suppkey % 3 = 0 THEN 'fijo' ELSE 'variable' END END AS spend_frequency,
    CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS external_ref,
    's' || l_suppkey || CASE WHEN l_linestatus = 'O' THEN '.csv' ELSE '.pdf' END AS source_file,
    l_linenumber AS source_row, p_name AS description,
    CASE WHEN l_suppkey % 7 <> 0 THEN p_brand END AS raw_description
  FROM signed)"""

_BASE = "WITH " + ",\n".join((_CATEGORY, _ACCOUNT, _LEDGER)) + """,
base AS (
  SELECT a.owner_id, l.currency, strftime(l.date, '%Y-%m') AS month, l.date, c.name AS category, c.kind, c.nature,
    l.spend_frequency AS tag, l.category_id IS NULL AND l.amount < 0 AS unknown_charge, l.amount
  FROM ledger l JOIN account a USING (account_id) LEFT JOIN category c USING (category_id))"""

_MONTHLY = _BASE + """,
monthly AS (
  SELECT owner_id, currency, month,
    sum(CASE WHEN kind = 'income' THEN amount ELSE 0 END) AS income,
    sum(CASE WHEN unknown_charge THEN -amount ELSE 0 END) AS uncategorized_expense,
    sum(CASE WHEN tag = 'fijo' THEN -amount ELSE 0 END) AS fijo_total,
    sum(CASE WHEN tag = 'variable' THEN -amount ELSE 0 END) AS variable_total,
    sum(CASE WHEN kind = 'expense' OR unknown_charge THEN -amount ELSE 0 END) AS total_expense,
    sum(CASE WHEN kind = 'income' OR kind = 'expense' OR unknown_charge THEN amount ELSE 0 END) AS net
  FROM base WHERE kind IN ('income','expense') OR unknown_charge OR tag IS NOT NULL
  GROUP BY ALL)"""

_SNAP = """snap AS (
  SELECT o_orderkey AS id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS sub_portfolio,
    CAST(o_totalprice AS DECIMAL(14,2)) AS market_value,
    CASE WHEN (o_custkey + o_orderkey) % 13 = 0 THEN 'EUR' ELSE 'MXN' END AS currency,
    CASE WHEN o_orderkey % 50 <> 0 THEN 'v' || (o_orderkey % 40) || '.pdf' END AS source_file
  FROM orders)"""

_EQUITY = """equity AS (
  SELECT event_id AS id, user_id AS account_id, CAST(ts AS DATE) AS date,
    CASE WHEN event_id % 9 <> 0 THEN CAST(CAST(value AS DECIMAL(14,2)) * 100 AS DECIMAL(14,2)) END AS market_value,
    'USD' AS currency FROM events)"""

_ALT = """alt AS (
  SELECT account_id, period_start, last_day(period_start) AS period_end, revenue, net_income,
    CAST(net_income * 0.02 AS DECIMAL(24,2)) AS proportional_income
  FROM (SELECT l_suppkey AS account_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS revenue,
      CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)))
        AS DECIMAL(24,2)) AS net_income
    FROM lineitem GROUP BY ALL))"""

_NEWEST = """newest AS (
  SELECT * FROM snap QUALIFY row_number() OVER (
    PARTITION BY account_id, sub_portfolio ORDER BY date DESC, id) = 1),
first_seen AS (SELECT account_id, sub_portfolio, min(id) AS first_id FROM snap GROUP BY ALL),
held AS (
  SELECT n.account_id, sum(n.market_value) AS snapshot_value, arg_min(n.currency, f.first_id) AS snapshot_currency
  FROM newest n JOIN first_seen f ON n.account_id = f.account_id
    AND n.sub_portfolio IS NOT DISTINCT FROM f.sub_portfolio GROUP BY ALL),
newest_equity AS (
  SELECT * FROM equity QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY date DESC, id) = 1),
hand AS (SELECT DISTINCT account_id FROM snap WHERE source_file IS NULL),
moved AS (SELECT account_id, sum(amount) AS moved FROM ledger GROUP BY ALL),
shared AS (SELECT account_id, sum(proportional_income) AS shared FROM alt GROUP BY ALL),
balance AS (
  SELECT a.account_id, a.owner_id, a.name, a.kind, a.parent_account_id,
    coalesce(m.moved, 0) + coalesce(h.snapshot_value, 0) + coalesce(e.market_value, 0)
      + CASE WHEN a.principal IS NOT NULL THEN a.principal ELSE coalesce(s.shared, 0) END AS balance,
    CASE WHEN e.market_value IS NOT NULL THEN e.currency ELSE coalesce(h.snapshot_currency, a.currency) END AS currency,
    a.account_id IN (SELECT account_id FROM hand) AS manual,
    coalesce(a.parent_account_id IN (SELECT account_id FROM hand), false) AS excluded,
    a.principal IS NOT NULL AS fixed, coalesce(s.shared, 0) AS shared, coalesce(m.moved, 0) AS moved,
    h.account_id IS NOT NULL AS has_snapshot
  FROM account a LEFT JOIN moved m USING (account_id) LEFT JOIN held h USING (account_id)
    LEFT JOIN newest_equity e USING (account_id) LEFT JOIN shared s USING (account_id)),
worth AS (
  SELECT owner_id, currency, sum(balance) AS total FROM balance WHERE balance <> 0 AND NOT excluded GROUP BY ALL)"""

_WEALTH = ",\n".join((_SNAP, _EQUITY, _ALT, _NEWEST))
_ALL = "WITH " + ",\n".join((_CATEGORY, _ACCOUNT, _LEDGER, _WEALTH))
_ALL_MONTHLY = _MONTHLY + ",\n" + _WEALTH

_BY_CURRENCY = _ALL + """,
parts AS (
  SELECT account_id, currency, amount FROM ledger
  UNION ALL SELECT account_id, currency, market_value FROM newest
  UNION ALL SELECT account_id, currency, market_value FROM newest_equity WHERE market_value IS NOT NULL
  UNION ALL SELECT account_id, 'MXN', proportional_income FROM alt
    WHERE account_id NOT IN (SELECT account_id FROM account WHERE principal IS NOT NULL)
  UNION ALL SELECT account_id, currency, principal FROM account WHERE principal IS NOT NULL),
by_currency AS (
  SELECT account_id, p.currency, sum(amount) AS balance, any_value(owner_id) AS owner_id,
    any_value(parent_account_id) AS parent_account_id
  FROM parts p JOIN account a USING (account_id) GROUP BY account_id, p.currency)"""


def _d(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


ORACLE: dict[str, str] = {}

# --- Reports -----------------------------------------------------------------

_MONEY_COLUMNS = ("income", "uncategorized_expense", "fijo_total", "variable_total", "total_expense", "net")
ORACLE["monthly_summary"] = f"{_MONTHLY} SELECT owner_id, currency, month, {_d(*_MONEY_COLUMNS)} FROM monthly"
ORACLE["monthly_category"] = _BASE + """
SELECT owner_id, currency, month, category, nature, CAST(-sum(amount) AS DOUBLE) AS amount
FROM base WHERE kind = 'expense' GROUP BY ALL"""
ORACLE["monthly_summary_categories"] = _BASE + """
SELECT owner_id, currency, month, CAST(row_number() OVER (
    PARTITION BY owner_id, currency, month ORDER BY amount DESC, category) - 1 AS INTEGER) AS position,
  category, nature, CAST(amount AS DOUBLE) AS amount
FROM (SELECT owner_id, currency, month, category, nature, -sum(amount) AS amount
      FROM base WHERE kind = 'expense' GROUP BY ALL)"""


def _spending(where: str) -> str:
    return _BASE + f"""
SELECT owner_id, category, nature, CAST(-sum(amount) AS DOUBLE) AS amount
FROM base WHERE kind = 'expense' AND {where} GROUP BY ALL
UNION ALL
SELECT owner_id, 'Sin categoría', NULL, CAST(-sum(amount) AS DOUBLE)
FROM base WHERE unknown_charge AND {where} GROUP BY owner_id HAVING sum(amount) <> 0"""


ORACLE["spending_by_category"] = _spending("true")
ORACLE["spending_by_category_range"] = _spending(
    "currency = 'MXN' AND date BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'"
)
ORACLE["month_breakdown"] = _BASE + """
SELECT owner_id, currency, CASE WHEN unknown_charge THEN 'Sin categoría' ELSE category END AS category, nature,
  CAST(-sum(amount) AS DOUBLE) AS amount
FROM base WHERE month = '1997-05' AND (kind = 'expense' OR unknown_charge) GROUP BY ALL
HAVING bool_or(kind = 'expense') OR sum(amount) <> 0"""

_CELLS = _BASE + """,
months AS (
  SELECT DISTINCT owner_id, month FROM base WHERE currency = 'MXN'
    AND (kind IN ('income','expense') OR unknown_charge OR tag IS NOT NULL)),
names AS (SELECT name AS category FROM category WHERE kind = 'expense' UNION ALL SELECT 'Sin categoría'),
spent AS (
  SELECT owner_id, month, CASE WHEN unknown_charge THEN 'Sin categoría' ELSE category END AS category,
    -sum(amount) AS amount
  FROM base WHERE currency = 'MXN' AND (kind = 'expense' OR unknown_charge) GROUP BY ALL),
cells AS (
  SELECT m.owner_id, m.month, n.category, coalesce(s.amount, 0) AS amount
  FROM months m CROSS JOIN names n LEFT JOIN spent s
    ON s.owner_id = m.owner_id AND s.month = m.month AND s.category = n.category)"""
_MATRIX = _CELLS + """,
matrix AS (
  SELECT owner_id, coalesce(category, 'Total') AS category, coalesce(month, 'Total') AS month, sum(amount) AS amount
  FROM cells GROUP BY GROUPING SETS ((owner_id, category, month), (owner_id, category), (owner_id, month), (owner_id)))"""
ORACLE["category_month_matrix"] = (
    _MATRIX + " SELECT owner_id, 'MXN' AS currency, category, month, CAST(amount AS DOUBLE) AS amount FROM matrix"
)
ORACLE["category_month_view"] = _MATRIX + """
SELECT owner_id, 'MXN' AS currency, category,
  """ + " ".join(
    f"""CAST(coalesce(sum(amount) FILTER (month = '{y}-{m:02d}'), 0) AS DOUBLE) AS "{y}-{m:02d}","""
    for y in range(1992, 2003) for m in range(1, 13)
) + """
  CAST(coalesce(sum(amount) FILTER (month = 'Total'), 0) AS DOUBLE) AS "Total"
FROM matrix GROUP BY ALL"""
ORACLE["category_month_lookup"] = _BASE + """
SELECT o.owner_id, 'MXN' AS currency, w.category, '1997-05' AS month,
  CAST(coalesce((SELECT -sum(amount) FROM base b WHERE b.owner_id = o.owner_id AND b.currency = 'MXN'
    AND b.month = '1997-05' AND b.category = w.category AND b.kind = 'expense'), 0) AS DOUBLE) AS amount
FROM (SELECT DISTINCT owner_id FROM account) o CROSS JOIN (VALUES ('Housing'), ('Travel'), ('Missing')) w(category)"""
ORACLE["expense_ratio"] = _MONTHLY + """,
ratio AS (SELECT *, CASE WHEN income > 0 THEN CAST(total_expense AS DOUBLE) * 100 / CAST(income AS DOUBLE) END AS raw FROM monthly)
SELECT owner_id, currency, month,
  CASE WHEN raw IS NOT NULL THEN CAST(greatest(least(floor(raw + 0.5), 999), -999) AS INTEGER) END AS ratio_pct, abs(raw) > 999 AS capped, raw > 100 AS over
FROM ratio"""
ORACLE["tag_surplus"] = _MONTHLY + """
SELECT owner_id, currency, month, CAST(fijo_total + variable_total - total_expense AS DOUBLE) AS surplus
FROM monthly WHERE fijo_total + variable_total > total_expense"""
ORACLE["kpi_tiles"] = _ALL_MONTHLY + """
SELECT coalesce(m.owner_id, w.owner_id) AS owner_id, coalesce(m.currency, w.currency) AS currency,
  CAST(w.total AS DOUBLE) AS total, m.month AS last_month, CAST(m.income AS DOUBLE) AS income,
  CAST(m.total_expense AS DOUBLE) AS total_expense, CAST(m.net AS DOUBLE) AS net
FROM (SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY owner_id, currency ORDER BY month DESC) = 1) m
FULL JOIN worth w ON m.owner_id = w.owner_id AND m.currency = w.currency"""

_SEARCH = """
SELECT l.id, a.name AS account, l.date, CAST(l.amount AS DOUBLE) AS amount, l.currency, l.description, c.name AS category
FROM ledger l JOIN account a USING (account_id) LEFT JOIN category c USING (category_id)
WHERE {where} ORDER BY l.date DESC, l.id LIMIT 200"""
_TABLES = "WITH " + ",\n".join((_CATEGORY, _ACCOUNT, _LEDGER))
ORACLE["search_transactions"] = _TABLES + _SEARCH.format(
    where="l.date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"
)
ORACLE["search_by_category"] = _TABLES + _SEARCH.format(where="a.name = 'Customer#000000042' AND c.name = 'Travel'")
ORACLE["export_ledger"] = _TABLES + """
SELECT l.id, l.date, strftime(l.date, '%Y-%m') AS month, a.name AS account, a.institution, l.currency,
  CAST(l.amount AS DOUBLE) AS amount, l.description, coalesce(c.name, '') AS category,
  CASE c.kind WHEN 'expense' THEN 'GASTO' WHEN 'income' THEN 'INGRESO' WHEN 'transfer' THEN 'TRANSFERENCIA' ELSE '' END AS kind,
  CASE c.nature WHEN 'basico' THEN 'Básico' WHEN 'necesario' THEN 'Necesario' WHEN 'estilo_de_vida' THEN 'Estilo de vida' ELSE '' END AS nature,
  CASE l.spend_frequency WHEN 'fijo' THEN 'Fijo' WHEN 'variable' THEN 'Variable' ELSE '' END AS frequency, l.source_file
FROM ledger l JOIN account a USING (account_id) LEFT JOIN category c USING (category_id)"""

ORACLE["write_export"] = (
    "SELECT month, kind, frequency, count(*) AS rows, sum(amount) AS amount, max(account) AS last_account FROM ("
    + ORACLE["export_ledger"] + ") GROUP BY ALL"
)


def _cutoff(as_of: str, day: str) -> str:
    first = f"CAST(date_trunc('month', {as_of}) AS DATE)"
    here = f"({first} + CAST(least({day}, day(last_day({first}))) - 1 AS INTEGER))"
    after = f"CAST({first} + INTERVAL 1 MONTH AS DATE)"
    there = f"({after} + CAST(least({day}, day(last_day({after}))) - 1 AS INTEGER))"
    return f"CASE WHEN {as_of} <= {here} THEN {here} ELSE {there} END"


def _add_business(start: str, days: str) -> str:
    """Weekday calendar as a lateral list: the n-th weekday after the start."""
    weekdays = (
        f"[CAST({start} + CAST(x AS INTEGER) AS DATE) for x in range(1, 60) if isodow({start} + CAST(x AS INTEGER)) <= 5]"
    )
    return f"CASE WHEN {days} > 0 THEN ({weekdays})[{days}] ELSE {start} END"


ORACLE["account_calendar"] = "WITH " + _ACCOUNT + f""",
cut AS (SELECT a.*, p.name AS parent,
    CASE WHEN a.is_credit_card THEN {_cutoff("DATE '2001-06-15'", "a.statement_cutoff_day")} END AS next_cutoff_date
  FROM account a LEFT JOIN account p ON a.parent_account_id = p.account_id)
SELECT account_id, owner_id, name, institution, kind, currency, parent, is_credit_card, next_cutoff_date,
  CASE WHEN is_credit_card THEN CASE WHEN payment_due_offset_type = 'natural'
    THEN next_cutoff_date + payment_due_offset_days
    ELSE {_add_business("next_cutoff_date", "payment_due_offset_days")} END END AS next_payment_due_date
FROM cut"""
ORACLE["accounts_with_parent"] = "WITH " + _ACCOUNT + """
SELECT a.account_id, a.name, a.parent_account_id, p.name AS parent
FROM account a LEFT JOIN account p ON a.parent_account_id = p.account_id"""

# --- Classification ----------------------------------------------------------

_HAY = "(coalesce(raw_description, '') || ' ' || description)"


def _matches(pattern: str) -> str:
    plain = pattern.replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])")
    return f"regexp_matches({_HAY}, {_q(plain)}, 'i')"


def _rule(rule: Rule) -> str:
    hit = _matches(rule.pattern)
    if rule.abs_amount is not None:
        hit = f"({hit} OR abs(abs(amount) - {rule.abs_amount}) < 0.01)"
    parts = [hit]
    if rule.pattern2:
        parts.append(_matches(rule.pattern2))
    if rule.valid_from:
        parts.append(f"date >= DATE '{rule.valid_from}'")
    if rule.valid_until:
        parts.append(f"date <= DATE '{rule.valid_until}'")
    if rule.sign:
        parts.append("amount > 0" if rule.sign > 0 else "amount < 0")
    return " AND ".join(parts)


def _first_rule(rules: tuple[Rule, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {_rule(r)} THEN {_q(r.category)}" for r in rules) + " END"


_HOLDER = "(" + " OR ".join(_matches(p) for p in rulebook.HOLDER_PATTERNS) + ")"
_EXCLUDED = "(" + ", ".join(_q(n) for n in rulebook.HOLDER_EXCLUDED) + ")"
_IS_TRANSFER = f"({_HOLDER} AND account_id NOT IN (SELECT account_id FROM account WHERE name IN {_EXCLUDED}))"
_FIXED = "(" + " OR ".join(_matches(p) for p in rulebook.FIXED_PATTERNS) + ")"


def _named(expression: str) -> str:
    cases = " ".join(f"WHEN {_q(n)} THEN {i}" for i, n, _, _ in CATEGORIES)
    return f"CAST(CASE {expression} {cases} END AS BIGINT)"


_BY_RULE = _named(_first_rule(rulebook.RULES))
ORACLE["classify_transfers"] = (
    _TABLES + f" SELECT id, CAST(CASE WHEN {_IS_TRANSFER} THEN 9 END AS BIGINT) AS category_id FROM ledger"
)
ORACLE["classify_rules"] = _TABLES + f" SELECT id, {_BY_RULE} AS category_id FROM ledger"
ORACLE["classify_keeps_known"] = _TABLES + f"""
SELECT CAST(coalesce(category_id, {_BY_RULE}) AS BIGINT) AS category_id, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount
FROM ledger GROUP BY 1"""
ORACLE["classify_dated_rules"] = _TABLES + f"""
SELECT * FROM (SELECT id, {_first_rule(rulebook.DATED_RULES)} AS category FROM ledger) WHERE category IS NOT NULL"""


def _tagged(category: str, old: str) -> str:
    return f"""CASE WHEN {old} IS NOT NULL THEN {old}
  WHEN {category} BETWEEN 1 AND 6 OR ({category} IS NULL AND amount < 0)
  THEN CASE WHEN {_FIXED} THEN 'fijo' ELSE 'variable' END END"""


ORACLE["spend_frequency"] = (
    _TABLES + f" SELECT id, {_tagged('category_id', 'CAST(NULL AS VARCHAR)')} AS spend_frequency FROM ledger"
)
_CLASSIFIED = _TABLES + f""",
classified AS (SELECT * EXCLUDE (category_id), category_id AS old_category, {_IS_TRANSFER} AS is_transfer, CAST(CASE WHEN category_id IS NOT NULL THEN category_id
    WHEN {_IS_TRANSFER} THEN 9 ELSE {_BY_RULE} END AS BIGINT) AS category_id FROM ledger),
tagged AS (SELECT *, {_tagged('category_id', 'spend_frequency')} AS new_tag FROM classified)"""
ORACLE["classify_all"] = _CLASSIFIED + " SELECT id, category_id, new_tag AS spend_frequency FROM tagged"
ORACLE["classification_counts"] = _CLASSIFIED + """
SELECT count(*) FILTER (old_category IS NULL AND is_transfer) AS transfers_classified,
  count(*) FILTER (old_category IS NULL AND NOT is_transfer AND category_id IS NOT NULL) AS merchants_classified,
  count(*) FILTER (spend_frequency IS NULL AND new_tag IS NOT NULL) AS spend_frequency_tagged
FROM tagged"""
def _audit(rules) -> str:
    hits = ", ".join(f"CASE WHEN {_rule(r)} THEN {r.rule_id} END" for r in rules)
    listed = ", ".join(f"({r.rule_id}, {_q(r.category)})" for r in rules)
    return _TABLES + f""",
rules(rule_id, category) AS (VALUES {listed}),
hits AS (SELECT [x for x in [{hits}] if x IS NOT NULL] AS h FROM ledger),
every AS (SELECT unnest(h) AS rule_id, count(*) AS n FROM hits GROUP BY 1),
firsts AS (SELECT h[1] AS rule_id, count(*) AS n FROM hits WHERE len(h) > 0 GROUP BY 1)
SELECT r.rule_id, r.category, coalesce(e.n, 0) AS any_hits, coalesce(f.n, 0) AS first_hits,
  coalesce(e.n, 0) = 0 AS zero_hit, coalesce(e.n, 0) > 0 AND coalesce(f.n, 0) = 0 AS shadowed
FROM rules r LEFT JOIN every e USING (rule_id) LEFT JOIN firsts f USING (rule_id)"""


ORACLE["rule_audit"] = _audit(rulebook.RULES)
ORACLE["rule_audit_many"] = _audit(rulebook.MANY_RULES)
ORACLE["classify_many_rules"] = _TABLES + f" SELECT id, {_named(_first_rule(rulebook.MANY_RULES))} AS category_id FROM ledger"

# --- Dedupe and ingest -------------------------------------------------------

_FEED = """WITH feed AS (
  SELECT l_suppkey AS account_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
    CAST(-floor(l_extendedprice / 10000) * 10000 AS DECIMAL(14,2)) AS amount,
    CASE WHEN l_linenumber % 3 <> 0 THEN 'R' || (l_orderkey % 5) END AS external_ref,
    'c' || year(l_shipdate) || '-' || (l_orderkey % 3) || CASE WHEN l_linestatus = 'O' THEN '.CSV' ELSE '.pdf' END AS source_file,
    (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 509 + l_suppkey) % 1048576 AS source_row,
    CASE WHEN l_linestatus = 'O' THEN '.csv' ELSE '.pdf' END AS ext,
    l_shipdate < DATE '1998-01-01' AS loaded
  FROM lineitem),
loaded AS (SELECT * FROM feed WHERE loaded)"""
_FEED_COLUMNS = "account_id, source_file, source_row, external_ref, CAST(amount AS DOUBLE) AS amount"
ORACLE["dedupe_positional"] = _FEED + f"""
SELECT {_FEED_COLUMNS} FROM feed f WHERE NOT EXISTS (SELECT 1 FROM loaded l WHERE l.account_id = f.account_id
  AND l.source_file = f.source_file AND l.source_row = f.source_row)"""
_KNOWN_REF = """(f.external_ref IS NOT NULL AND EXISTS (SELECT 1 FROM loaded l WHERE l.account_id = f.account_id
    AND l.external_ref = f.external_ref AND l.date = f.date AND l.amount = f.amount)
  OR f.external_ref IS NULL AND EXISTS (SELECT 1 FROM loaded l WHERE l.account_id = f.account_id
    AND l.external_ref IS NULL AND l.source_file = f.source_file AND l.source_row = f.source_row))"""
_FIRST_REF = """(external_ref IS NULL OR row_number() OVER (
  PARTITION BY account_id, external_ref, date, amount ORDER BY source_file, source_row) = 1)"""
ORACLE["dedupe_by_reference"] = _FEED + f"""
SELECT {_FEED_COLUMNS} FROM (SELECT * FROM feed f QUALIFY {_FIRST_REF}) f WHERE NOT {_KNOWN_REF}"""
_EXTS = """,
exts AS (SELECT account_id, date, amount, list(DISTINCT ext) AS e FROM loaded GROUP BY ALL),
cross_format AS (
  SELECT f.*, CASE WHEN e IS NULL
    THEN ext = first_value(ext) OVER (PARTITION BY f.account_id, f.date, f.amount ORDER BY source_file, source_row)
    ELSE len([x for x in e if x <> ext]) = 0 END AS keep
  FROM {source} f LEFT JOIN exts USING (account_id, date, amount))"""
ORACLE["dedupe_cross_format"] = _FEED + _EXTS.format(source="feed") + f" SELECT {_FEED_COLUMNS} FROM cross_format WHERE keep"
ORACLE["dedupe_card_feed"] = _FEED + f""",
fresh AS (SELECT * FROM feed f WHERE NOT {_KNOWN_REF})""" + _EXTS.format(source="fresh") + f"""
SELECT {_FEED_COLUMNS} FROM (SELECT * FROM cross_format WHERE keep) QUALIFY {_FIRST_REF}"""
ORACLE["dedupe_by_id"] = _FEED + """,
marked AS (SELECT * REPLACE (external_ref || '/' || strftime(date, '%Y%m') AS external_ref) FROM feed)
SELECT account_id, source_file, source_row, external_ref, CAST(amount AS DOUBLE) AS amount
FROM (SELECT * FROM marked QUALIFY row_number() OVER (
  PARTITION BY account_id, external_ref ORDER BY source_file, source_row) = 1) m
WHERE NOT EXISTS (SELECT 1 FROM marked l WHERE l.loaded AND l.account_id = m.account_id AND l.external_ref = m.external_ref)"""
ORACLE["dedupe_snapshots"] = "WITH " + _SNAP + """,
moved AS (SELECT id, account_id, CAST(date_trunc('month', date) AS DATE) AS date, sub_portfolio,
    coalesce(source_file, 'manual') AS source_file, date < DATE '1998-01-01' AS loaded FROM snap)
SELECT id, account_id, date, sub_portfolio FROM (
  SELECT *, bool_or(loaded) OVER (PARTITION BY account_id, date, sub_portfolio) AS known,
    row_number() OVER (PARTITION BY account_id, date, sub_portfolio ORDER BY source_file, id) AS n FROM moved)
WHERE n = 1 AND NOT known"""
ORACLE["dedupe_periods"] = "WITH " + _ALT + """
SELECT account_id, period_start, period_end, CAST(net_income AS DOUBLE) AS net_income
FROM alt WHERE period_start >= DATE '1998-01-01'"""
ORACLE["dedupe_equity"] = "WITH " + _EQUITY + """
SELECT id, account_id, date FROM equity e WHERE date >= DATE '2024-01-15'
QUALIFY row_number() OVER (PARTITION BY account_id, date ORDER BY id) = 1"""

_STATEMENTS = "WITH " + ",\n".join((_CATEGORY, _ACCOUNT, _LEDGER)) + """,
per_month AS (
  SELECT account_id, CAST(date_trunc('month', date) AS DATE) AS period_start, sum(amount) AS delta,
    sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS charges, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS credits,
    count(*) FILTER (amount < 0) AS n_neg, count(*) FILTER (amount > 0) AS n_pos, count(*) AS n_rows
  FROM ledger GROUP BY ALL),
statement AS (
  SELECT *, 'a' || account_id || '-' || strftime(period_start, '%Y-%m') || '.pdf' AS source_file,
    last_day(period_start) AS period_end, run - delta AS opening,
    run + CASE WHEN account_id % 23 = 0 AND month(period_start) % 4 = 0 THEN 5 ELSE 0 END AS closing,
    charges + CASE WHEN account_id % 17 = 0 THEN 1 ELSE 0 END AS printed_charges,
    n_pos + CASE WHEN account_id % 19 = 0 THEN 1 ELSE 0 END AS printed_n_pos
  FROM (SELECT *, sum(delta) OVER (PARTITION BY account_id ORDER BY period_start) AS run FROM per_month)),
chain AS (
  SELECT *, (SELECT arg_max(p.source_file, p.period_end) FROM statement p
      WHERE p.account_id = s.account_id AND p.period_end <= s.period_start) AS previous_file
  FROM statement s),
linked AS (
  SELECT c.*, p.closing AS previous_closing FROM chain c LEFT JOIN statement p ON p.source_file = c.previous_file),
checks AS (
  SELECT account_id, source_file, 'charges' AS "check", printed_charges AS expected, charges AS actual, 0.01 AS tolerance FROM statement
  UNION ALL SELECT account_id, source_file, 'credits', credits, credits, 0.01 FROM statement
  UNION ALL SELECT account_id, source_file, 'charge_count', n_neg, n_neg, 0 FROM statement
  UNION ALL SELECT account_id, source_file, 'credit_count', printed_n_pos, n_pos, 0 FROM statement
  UNION ALL SELECT account_id, source_file, 'delta', closing - opening, delta, 0.01 FROM statement
  UNION ALL SELECT account_id, source_file, 'chain', previous_closing, opening, 0.01 FROM linked WHERE previous_file IS NOT NULL),
judged AS (SELECT *, abs(expected - actual) <= tolerance AS ok FROM checks),
bad AS (SELECT DISTINCT source_file FROM judged WHERE NOT ok),
moves AS (SELECT *, 'a' || account_id || '-' || strftime(date, '%Y-%m') || '.pdf' AS statement_file FROM ledger)"""
_CHECK_COLUMNS = 'account_id, source_file, "check", CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual, CAST(tolerance AS DOUBLE) AS tolerance, {ok} AS ok'
_CHECK = _CHECK_COLUMNS.format(ok="ok")

ORACLE["append_statements"] = _STATEMENTS + f"""
SELECT account_id, source_file, {_d('opening', 'closing')} FROM statement WHERE period_end >= DATE '1998-01-01'"""
ORACLE["append_new"] = _TABLES + """
SELECT strftime(date, '%Y-%m') AS month, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount,
  CAST(sum(count(*)) OVER () AS BIGINT) AS added
FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger k WHERE k.date < DATE '1998-01-01' AND k.account_id = l.account_id
  AND k.source_file = l.source_file AND k.source_row = l.source_row) GROUP BY 1"""
ORACLE["ingest_feed_rows"] = _TABLES + """
SELECT date, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount, count(external_ref) AS with_reference FROM ledger GROUP BY 1"""
ORACLE["ingest_feed_status"] = _TABLES + """
SELECT 'ok' AS status, NULL AS error, count(*) AS rows FROM ledger
UNION ALL SELECT 'error', 'unreadable: date', 0"""
ORACLE["ingest_stream_rows"] = _TABLES + """
SELECT account_id, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount
FROM (SELECT DISTINCT account_id, external_ref, date, amount FROM ledger WHERE external_ref IS NOT NULL) GROUP BY 1"""
ORACLE["ingest_stream_ledger"] = _TABLES + """
SELECT account_id, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount FROM (
  SELECT account_id, amount FROM (SELECT DISTINCT account_id, external_ref, date, amount FROM ledger WHERE external_ref IS NOT NULL)
  UNION ALL
  SELECT account_id, min(amount) FROM ledger WHERE external_ref IS NULL GROUP BY account_id, source_file, source_row
) GROUP BY 1"""
ORACLE["upsert_dimension"] = "WITH " + _ACCOUNT + """,
incoming AS (SELECT 'Customer#' || lpad(CAST(s_suppkey * 20 AS VARCHAR), 9, '0') AS name, s_suppkey + 1000000 AS account_id,
  CAST(s_suppkey % 28 + 1 AS INTEGER) AS cutoff, s_suppkey % 2 = 0 AS card FROM supplier)
SELECT a.account_id, a.name, a.institution, coalesce(i.cutoff, a.statement_cutoff_day) AS statement_cutoff_day,
  coalesce(i.card, a.is_credit_card) AS is_credit_card, a.payment_due_offset_days
FROM account a LEFT JOIN incoming i USING (name)
UNION ALL
SELECT account_id, name, 'New bank', cutoff, card, NULL FROM incoming WHERE name NOT IN (SELECT name FROM account)"""
ORACLE["overlay_manual"] = "WITH " + _SNAP + """,
manual AS (SELECT -id - 1 AS id, account_id, date + CAST(id % 2 AS INTEGER) AS date, sub_portfolio, market_value FROM snap)
SELECT id, account_id, date, sub_portfolio, CAST(market_value AS DOUBLE) AS market_value, source_file FROM snap
UNION ALL
SELECT id, account_id, date, sub_portfolio, CAST(market_value AS DOUBLE), NULL FROM manual m
WHERE NOT EXISTS (SELECT 1 FROM snap s WHERE s.account_id = m.account_id AND s.date = m.date
  AND s.sub_portfolio IS NOT DISTINCT FROM m.sub_portfolio)"""
ORACLE["resolve_account"] = """
WITH xml AS (
  SELECT 'o' || o_orderkey || '.txt' AS source_file, o_orderkey, o_custkey, l.line_no
  FROM orders CROSS JOIN (VALUES (0), (1)) l(line_no) WHERE o_orderkey % 10 <> 0),
coded AS (SELECT source_file, CAST(line_no AS INTEGER) AS line_no, o_custkey, o_orderkey % 100 = 77 AS bad FROM xml)
SELECT source_file, line_no, CASE WHEN bad THEN 'C-unknown' ELSE 'C' || o_custkey END AS contract,
  CASE WHEN NOT bad THEN c_custkey END AS account_id, bad OR c_custkey IS NULL AS rejected
FROM coded LEFT JOIN customer ON c_custkey = o_custkey"""

# --- Reconciliation ----------------------------------------------------------

ORACLE["check_totals"] = _STATEMENTS + f"""
SELECT {_CHECK} FROM judged WHERE "check" IN ('charges', 'credits', 'charge_count', 'credit_count')"""
ORACLE["check_delta"] = _STATEMENTS + f" SELECT {_CHECK} FROM judged WHERE \"check\" = 'delta'"
ORACLE["previous_statement"] = _STATEMENTS + """
SELECT account_id, source_file, CAST(opening AS DOUBLE) AS opening, previous_file,
  CAST(previous_closing AS DOUBLE) AS previous_closing FROM linked"""
ORACLE["check_chain"] = _STATEMENTS + f" SELECT {_CHECK} FROM judged WHERE \"check\" = 'chain'"
_NEXT = _STATEMENTS + """,
ahead AS (
  SELECT *, (SELECT arg_min(n.source_file, n.period_start) FROM statement n
      WHERE n.account_id = s.account_id AND n.period_start >= s.period_end) AS next_file
  FROM statement s),
followed AS (SELECT a.*, n.opening AS next_opening FROM ahead a LEFT JOIN statement n ON n.source_file = a.next_file)"""
ORACLE["next_statement"] = _NEXT + """
SELECT account_id, source_file, CAST(closing AS DOUBLE) AS closing, next_file, CAST(next_opening AS DOUBLE) AS next_opening FROM followed"""
ORACLE["check_chain_full"] = _NEXT + f"""
SELECT {_CHECK} FROM judged WHERE "check" = 'chain'
UNION ALL
SELECT account_id, source_file, 'chain_next', CAST(closing AS DOUBLE), CAST(next_opening AS DOUBLE), CAST(0.01 AS DOUBLE),
  abs(closing - next_opening) <= 0.01 FROM followed WHERE next_file IS NOT NULL"""
ORACLE["check_chain_known_gaps"] = (
    _STATEMENTS + f" SELECT {_CHECK_COLUMNS.format(ok='ok OR account_id % 46 = 0')} FROM judged WHERE \"check\" = 'chain'"
)
ORACLE["import_report"] = _STATEMENTS + """,
failed AS (SELECT source_file, string_agg("check", '; ' ORDER BY "check") AS error FROM judged WHERE NOT ok GROUP BY 1)
SELECT s.account_id, s.source_file, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN error IS NULL THEN n_rows ELSE 0 END AS rows, error
FROM statement s LEFT JOIN failed USING (source_file)"""
_MOVED = "SELECT account_id, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount FROM moves WHERE statement_file {op} (SELECT source_file FROM bad) GROUP BY 1"
ORACLE["accepted_movements"] = _STATEMENTS + " " + _MOVED.format(op="NOT IN")
ORACLE["quarantined_movements"] = _STATEMENTS + " " + _MOVED.format(op="IN")

# Files count in the order of their names, which here is the order of the months; a file
# meets the last statement that was registered, and joins them only if it fits.
_IMPORT = _STATEMENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
printed_file AS (
  SELECT *, account_id % 31 = 0 AS no_closing, account_id % 37 = 0 AS no_account,
    account_id % 41 = 0 AND month(period_start) % 5 = 0 AS no_end FROM statement),
own_checks AS (
  SELECT source_file, "check" FROM judged j JOIN printed_file s USING (source_file)
    WHERE NOT ok AND "check" <> 'chain' AND NOT (no_closing AND "check" = 'delta')
  UNION ALL SELECT source_file, 'readable' FROM printed_file WHERE no_closing OR no_account OR no_end
  UNION ALL SELECT source_file, 'delta' FROM printed_file WHERE no_closing),
queue AS (
  SELECT account_id, source_file, opening, closing, row_number() OVER (PARTITION BY account_id ORDER BY source_file) AS n
  FROM printed_file WHERE period_end >= DATE '1998-01-01' AND source_file NOT IN (SELECT source_file FROM own_checks)),
registered_before AS (
  SELECT account_id, arg_max(closing, period_end) AS closing FROM statement WHERE period_end < DATE '1998-01-01' GROUP BY 1),
walk(account_id, n, source_file, ok, last_closing) AS (
  SELECT q.account_id, q.n, q.source_file, coalesce(abs(r.closing - q.opening) <= 0.01, true),
    CASE WHEN coalesce(abs(r.closing - q.opening) <= 0.01, true) THEN q.closing ELSE r.closing END
  FROM queue q LEFT JOIN registered_before r USING (account_id) WHERE q.n = 1
  UNION ALL
  SELECT q.account_id, q.n, q.source_file, coalesce(abs(w.last_closing - q.opening) <= 0.01, true),
    CASE WHEN coalesce(abs(w.last_closing - q.opening) <= 0.01, true) THEN q.closing ELSE w.last_closing END
  FROM walk w JOIN queue q ON q.account_id = w.account_id AND q.n = w.n + 1),
import_checks AS (
  SELECT source_file, "check" FROM own_checks
  UNION ALL SELECT source_file, 'chain' FROM walk WHERE NOT ok),
import_bad AS (SELECT source_file, string_agg("check", '; ' ORDER BY "check") AS error FROM import_checks GROUP BY 1)"""
# Rows of registered files and of every seventh account are loaded already.
_NOT_LOADED = "period_end >= DATE '1998-01-01' AND account_id % 7 <> 3"
ORACLE["import_statement_report"] = _IMPORT + f"""
SELECT CASE WHEN s.account_id % 37 <> 0 THEN s.account_id END AS account_id, s.source_file, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN error IS NULL AND {_NOT_LOADED} THEN n_rows ELSE 0 END AS rows, error
FROM statement s LEFT JOIN import_bad USING (source_file)"""
ORACLE["import_statement_rows"] = _IMPORT + """
SELECT account_id, date AS op_date, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount,
  count(external_ref) AS with_reference, max(description) AS last_description
FROM moves WHERE statement_file NOT IN (SELECT source_file FROM import_bad)
  AND last_day(date) >= DATE '1998-01-01' AND account_id % 7 <> 3 GROUP BY ALL"""
ORACLE["registered_statements"] = _IMPORT + f"""
SELECT account_id, source_file, period_start, period_end, {_d('opening', 'closing')} FROM statement
WHERE period_end >= DATE '1998-01-01' AND source_file NOT IN (SELECT source_file FROM import_bad)"""
_CARD_IMPORT = """WITH RECURSIVE item AS (
  SELECT l_orderkey AS k, l_linenumber AS kind, CAST(l_shipdate AS DATE) AS d, l_linenumber > 3 AND l_returnflag = 'R' AS credit,
    CASE WHEN l_linenumber = 1 THEN CAST(1 AS DECIMAL(14,2)) ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END AS price,
    CASE l_linenumber WHEN 1 THEN 'RECARGO ZETA POR PAGO TARDIO' WHEN 2 THEN 'TIENDA A 03 MESES S/I' WHEN 3 THEN '02 DE 03 ANUALIDAD'
      ELSE 'COMPRA ' || l_suppkey END AS description,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY (CAST(l_linenumber AS BIGINT) * 1048576 + (l_partkey * 509 + l_suppkey) % 1048576) * 64 + l_quantity) - 1 AS n
  FROM lineitem),
sums AS (
  SELECT k, sum(CASE WHEN NOT credit AND kind <> CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END THEN price ELSE 0 END) AS charges,
    sum(CASE WHEN credit THEN price ELSE 0 END) AS credits, count(*) AS n_rows,
    sum(CASE WHEN k % 2 = 0 AND kind = 1 THEN 1 ELSE 0 END) AS itemised
  FROM item GROUP BY k),
head AS (
  SELECT o_orderkey AS k, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS period_end, coalesce(charges, 0) AS charges, coalesce(credits, 0) AS credits,
    coalesce(n_rows, 0) AS n_rows, coalesce(itemised, 0) AS itemised,
    'c' || o_custkey || '-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS source_file,
    o_orderkey % 7 + o_orderkey % 5 + o_orderkey % 3 AS costs,
    CASE WHEN o_orderkey % 2 = 0 THEN 25 ELSE 0 END AS extra
  FROM orders LEFT JOIN sums ON k = o_orderkey),
run AS (
  SELECT *, sum(charges + extra + costs - credits) OVER (PARTITION BY account_id ORDER BY period_end, k ROWS UNBOUNDED PRECEDING) AS total FROM head),
file AS (
  SELECT *, total - (charges + extra + costs - credits) AS opening,
    total + CASE WHEN k % 2 = 1 AND k % 17 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 41 = 0 THEN 0.05 ELSE 0 END AS closing,
    costs - itemised AS remainder, period_end < DATE '1998-01-01' AS known
  FROM run),
own AS (
  SELECT k, 'template' AS "check" FROM file WHERE k % 37 = 0
  UNION ALL SELECT k, 'charges' FROM file WHERE k % 37 <> 0 AND k % 17 = 0
  UNION ALL SELECT k, 'equation' FROM file WHERE k % 37 <> 0 AND (k % 41 = 0 OR k % 31 = 0)
  UNION ALL SELECT k, 'fee_remainder' FROM file WHERE k % 37 <> 0 AND remainder < 0
  UNION ALL SELECT k, 'readable' FROM file WHERE k % 37 <> 0 AND k % 31 = 0),
queue AS (
  SELECT account_id, k, opening, closing, row_number() OVER (PARTITION BY account_id ORDER BY source_file) AS n
  FROM file WHERE NOT known AND k NOT IN (SELECT k FROM own)),
registered AS (SELECT account_id, arg_max(closing, source_file) AS closing FROM file WHERE known GROUP BY 1),
walk(account_id, n, k, ok, last_closing) AS (
  SELECT q.account_id, q.n, q.k, coalesce(abs(r.closing - q.opening) <= 0.01, true),
    CASE WHEN coalesce(abs(r.closing - q.opening) <= 0.01, true) THEN q.closing ELSE r.closing END
  FROM queue q LEFT JOIN registered r USING (account_id) WHERE q.n = 1
  UNION ALL
  SELECT q.account_id, q.n, q.k, abs(w.last_closing - q.opening) <= 0.01,
    CASE WHEN abs(w.last_closing - q.opening) <= 0.01 THEN q.closing ELSE w.last_closing END
  FROM walk w JOIN queue q ON q.account_id = w.account_id AND q.n = w.n + 1),
checked AS (SELECT k, "check" FROM own UNION ALL SELECT k, 'chain' FROM walk WHERE NOT ok),
bad AS (SELECT k, string_agg("check", '; ' ORDER BY "check") AS error FROM checked GROUP BY 1),
fresh AS (
  SELECT f.account_id, f.k, i.d AS op_date, i.description, CASE WHEN i.credit THEN i.price ELSE -i.price END AS amount, 0 AS synthetic
  FROM file f JOIN item i USING (k)
  WHERE NOT known AND k % 11 <> 0 AND i.kind <> CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END
  UNION ALL
  SELECT account_id, k, period_end, 'Costos del resumen', -remainder, 1 FROM file WHERE remainder > 0)"""
ORACLE["import_card_report"] = _CARD_IMPORT + """
SELECT CASE WHEN f.k % 37 <> 0 THEN f.account_id END AS account_id, f.source_file, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN error IS NULL THEN (SELECT count(*) FROM fresh r WHERE r.k = f.k) ELSE 0 END AS rows, error
FROM file f LEFT JOIN bad USING (k)"""
ORACLE["import_card_rows"] = _CARD_IMPORT + """
SELECT account_id, op_date, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(synthetic) AS BIGINT) AS from_summary,
  max(description) AS last_description
FROM fresh WHERE k NOT IN (SELECT k FROM bad) GROUP BY ALL"""
ORACLE["evolved_ledger"] = _TABLES + """
SELECT CASE WHEN date >= DATE '1998-01-01' THEN spend_frequency END AS spend_frequency, 'none' AS benefit_tag,
  count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount
FROM ledger GROUP BY ALL"""

_CARD = """WITH card AS (
  SELECT o_custkey AS account_id, 'o' || o_orderkey || '.txt' AS source_file, o_orderkey AS k,
    CAST(o_orderdate AS DATE) AS cutoff_date, CAST(o_totalprice AS DECIMAL(14,2)) AS total,
    CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 0.5 AS DECIMAL(14,2)) AS half FROM orders),
printed AS (
  SELECT *, CAST(k % 7 AS DECIMAL(14,2)) AS interest, CAST(k % 5 AS DECIMAL(14,2)) AS fees, CAST(k % 3 AS DECIMAL(14,2)) AS tax,
    total - 100 + half + 25 + k % 7 + k % 5 + k % 3 - k % 400 AS computed FROM card),
rows AS (
  SELECT o_custkey AS account_id, 'o' || o_orderkey || '.txt' AS source_file, l_linenumber AS n,
    CASE WHEN l_linenumber = 1 THEN CAST(-1 AS DECIMAL(14,2)) ELSE -CAST(l_extendedprice AS DECIMAL(14,2)) END AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fee AS (
  SELECT p.*, coalesce(f.itemised, 0) AS itemised, coalesce(f.n_rows, 0) AS n_rows,
    p.interest + p.fees + p.tax - coalesce(f.itemised, 0) AS remainder
  FROM printed p LEFT JOIN (SELECT source_file, sum(CASE WHEN n = 1 THEN -amount ELSE 0 END) AS itemised, count(*) AS n_rows
    FROM rows GROUP BY 1) f USING (source_file))"""
ORACLE["check_equation"] = _CARD + """
SELECT account_id, source_file, 'equation' AS "check",
  CAST(computed + CASE WHEN k % 41 = 0 THEN 0.02 WHEN k % 43 = 0 THEN 0.01 ELSE 0 END AS DOUBLE) AS expected,
  CAST(computed AS DOUBLE) AS actual, CAST(0.01 AS DOUBLE) AS tolerance, k % 41 <> 0 AS ok FROM printed"""
ORACLE["check_totals_excluding_fees"] = _CARD + """
SELECT account_id, source_file, CAST(-sum(amount) AS DOUBLE) AS charges, count(*) AS charge_count
FROM rows WHERE n <> 1 GROUP BY ALL"""
ORACLE["check_fee_remainder"] = _CARD + """
SELECT account_id, source_file, 'fee_remainder' AS "check", CAST(0 AS DOUBLE) AS expected,
  CAST(least(remainder, 0) AS DOUBLE) AS actual, CAST(0 AS DOUBLE) AS tolerance, remainder >= 0 AS ok FROM fee"""
ORACLE["synthesize_costs"] = _CARD + """
SELECT account_id, source_file, n_rows AS source_row, cutoff_date AS op_date, cutoff_date AS charge_date,
  'Costos del resumen' AS description, CAST(-remainder AS DOUBLE) AS amount FROM fee WHERE remainder > 0"""
ORACLE["drop_disclosures"] = _CARD + """
SELECT CASE WHEN n = 1 THEN 'RECARGO ZETA POR PAGO TARDIO' ELSE 'COMPRA' END AS description, count(*) AS rows,
  CAST(sum(amount) AS DOUBLE) AS amount FROM rows WHERE n NOT IN (2, 3) GROUP BY 1"""
ORACLE["check_components"] = """
SELECT l_suppkey AS account_id, 'k' || l_orderkey AS source_file, 'components' AS "check",
  CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) + CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS expected,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS actual, CAST(0.01 AS DOUBLE) AS tolerance,
  l_suppkey % 13 <> 0 AS ok
FROM lineitem GROUP BY l_suppkey, l_orderkey"""
ORACLE["check_product"] = """
SELECT p_partkey AS account_id, p_brand || '.txt' AS source_file, 'product' AS "check",
  CAST(CAST(p_size * CAST(p_retailprice AS DECIMAL(14,2)) + CASE WHEN p_partkey % 37 = 0 THEN 1 ELSE 0 END AS DECIMAL(24,2)) AS DOUBLE) AS expected,
  CAST(CAST(p_size * CAST(p_retailprice AS DECIMAL(14,2)) AS DECIMAL(24,2)) AS DOUBLE) AS actual,
  CAST(0.05 AS DOUBLE) AS tolerance, p_partkey % 37 <> 0 AS ok
FROM part WHERE p_partkey % 5 <> 0"""
ORACLE["check_share"] = "WITH " + _ALT + """,
share AS (SELECT account_id, strftime(period_start, '%Y-%m') AS source_file,
    round(proportional_income + CASE WHEN account_id % 9 = 0 THEN 2 ELSE 0 END, 0) AS expected,
    round(net_income * 0.0200, 2) AS actual FROM alt)
SELECT account_id, source_file, 'share' AS "check", CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual,
  CAST(1 AS DOUBLE) AS tolerance, abs(expected - actual) <= 1.00 AS ok FROM share"""

# --- Wealth ------------------------------------------------------------------

ORACLE["latest_snapshot"] = _ALL + """
SELECT account_id, sub_portfolio, id, date, CAST(market_value AS DOUBLE) AS market_value, currency FROM newest"""
ORACLE["latest_equity"] = (
    _ALL + " SELECT account_id, id, date, CAST(market_value AS DOUBLE) AS market_value FROM newest_equity"
)
ORACLE["account_balance"] = (
    _ALL + " SELECT account_id, owner_id, CAST(balance AS DOUBLE) AS balance, currency, manual FROM balance"
)
ORACLE["account_balance_by_currency"] = _BY_CURRENCY + """
SELECT account_id, currency, CAST(balance AS DOUBLE) AS balance, account_id IN (SELECT account_id FROM hand) AS manual
FROM by_currency"""
ORACLE["net_worth"] = _ALL + " SELECT owner_id, currency, CAST(total AS DOUBLE) AS total FROM worth"
ORACLE["net_worth_by_currency"] = _BY_CURRENCY + """
SELECT owner_id, currency, CAST(sum(balance) AS DOUBLE) AS total FROM by_currency
WHERE balance <> 0 AND NOT coalesce(parent_account_id IN (SELECT account_id FROM hand), false) GROUP BY ALL"""
ORACLE["net_worth_by_account"] = _ALL + """
SELECT account_id, owner_id, name, kind, CAST(balance AS DOUBLE) AS balance, currency, excluded,
  concat_ws('|', CASE WHEN fixed THEN 'principal_only' WHEN shared <> 0 THEN 'income_only' END,
    CASE WHEN excluded THEN 'folded_into_parent'
         WHEN parent_account_id IS NOT NULL AND moved <> 0 AND NOT has_snapshot THEN 'movements_only' END,
    CASE WHEN manual THEN 'manual_value' END) AS caveats
FROM balance WHERE balance <> 0"""
ORACLE["distribution_return"] = "WITH " + _ALT + """
SELECT s_suppkey AS account_id, CAST(principal AS DOUBLE) AS initial_investment,
  CAST(coalesce(paid, 0) AS DOUBLE) AS cash_distributed_to_date,
  round(CAST(paid AS DOUBLE) / months / CAST(principal AS DOUBLE) * 100, 3) AS average_monthly_return_pct
FROM (SELECT s_suppkey, abs(CAST(s_acctbal AS DECIMAL(14,2))) + 1000 AS principal FROM supplier)
LEFT JOIN (SELECT account_id, count(*) AS months, sum(proportional_income) AS paid FROM alt GROUP BY 1) ON account_id = s_suppkey"""
_RUN = "CAST({opening} + sum(amount) OVER (PARTITION BY account_id ORDER BY date, id, amount ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance"
ORACLE["running_balance"] = _TABLES + f"""
SELECT id, account_id, date, CAST(amount AS DOUBLE) AS amount, {_RUN.format(opening='0')} FROM ledger"""
ORACLE["running_balance_anchored"] = _TABLES + f"""
SELECT id, account_id, date, CAST(amount AS DOUBLE) AS amount, {_RUN.format(opening='CAST(c_acctbal AS DECIMAL(14,2))')}
FROM ledger JOIN customer ON c_custkey = account_id"""

# --- Goals -------------------------------------------------------------------

_GOAL = _MONTHLY + """,
goal AS (
  SELECT *, CASE WHEN income > 0 THEN net >= target_amount END AS met
  FROM (SELECT *, CASE WHEN income > 0 THEN round(income * 0.15, 2) ELSE 0 END AS target_amount FROM monthly)),
judged AS (
  SELECT *, sum(CASE WHEN met THEN 0 ELSE 1 END) OVER (PARTITION BY owner_id, currency ORDER BY month DESC) AS missed
  FROM goal WHERE met IS NOT NULL)"""
ORACLE["savings_goal"] = _GOAL + f"""
SELECT owner_id, currency, month, {_d('income', 'net', 'target_amount')}, met FROM goal"""
ORACLE["current_streak"] = _GOAL + """
SELECT owner_id, currency, count(*) FILTER (missed = 0) AS current_streak FROM judged GROUP BY ALL"""
ORACLE["savings_goal_summary"] = _GOAL + """
SELECT g.owner_id, g.currency, count(j.month) AS months_evaluated, count(*) FILTER (j.met) AS months_met,
  count(*) FILTER (j.missed = 0) AS current_streak,
  coalesce(round(CAST(sum(j.net) * 100 AS DOUBLE) / CAST(sum(j.income) AS DOUBLE), 2), 0) AS historical_savings_rate_pct,
  CAST(15 AS DOUBLE) AS target_pct
FROM goal g LEFT JOIN judged j USING (owner_id, currency, month) GROUP BY ALL"""


def _basis(prefix: str) -> str:
    return prefix + """,
closed AS (
  SELECT * FROM monthly WHERE month <> '2001-06'
  QUALIFY row_number() OVER (PARTITION BY owner_id, currency ORDER BY month DESC) <= 12),
basis AS (
  SELECT owner_id, currency, count(*) AS window_months_used, count(*) FILTER (income > 0) AS income_months,
    round(CAST(median(CASE WHEN income > 0 THEN CAST(income AS DOUBLE) END) AS DECIMAL(20,3)), 2) AS median_monthly_income,
    round(CAST(median(CAST(fijo_total AS DOUBLE)) AS DECIMAL(20,3)), 2) AS median_monthly_fijo
  FROM closed GROUP BY ALL)"""


ORACLE["trailing_window"] = _basis(_MONTHLY) + f" SELECT owner_id, currency, month, {_d('income', 'fijo_total')} FROM closed"
ORACLE["projection_basis"] = _basis(_MONTHLY) + f"""
SELECT owner_id, currency, window_months_used, income_months, {_d('median_monthly_income', 'median_monthly_fijo')} FROM basis"""
_PROJECTED = _basis(_ALL_MONTHLY) + """,
projected AS (
  SELECT b.owner_id, b.currency, label, rate_pct, year, window_months_used, median_monthly_income, median_monthly_fijo,
    coalesce(w.total, 0) AS current_net_worth, income_months > 0 AS has_sample,
    round(median_monthly_income * rate, 2) AS monthly_savings,
    (year - 2001) * 12 + 6 AS months_remaining
  FROM basis b LEFT JOIN worth w ON w.owner_id = b.owner_id AND w.currency = 'MXN'
  CROSS JOIN (VALUES ('minimo', 15.0, 0.15), ('ambicioso', 30.0, 0.30)) s(label, rate_pct, rate)
  CROSS JOIN (VALUES (2001), (2002), (2000)) y(year)),
final AS (
  SELECT *, median_monthly_income - median_monthly_fijo - monthly_savings AS monthly_variable_budget,
    monthly_savings * months_remaining AS cumulative_savings,
    current_net_worth + monthly_savings * months_remaining AS projected_net_worth FROM projected)"""
ORACLE["savings_projection"] = _PROJECTED + f"""
SELECT owner_id, currency, label, CAST(rate_pct AS DOUBLE) AS rate_pct, year, window_months_used, has_sample,
  CAST(months_remaining AS INTEGER) AS months_remaining,
  {_d('median_monthly_income', 'median_monthly_fijo', 'current_net_worth', 'monthly_savings', 'monthly_variable_budget',
      'cumulative_savings', 'projected_net_worth')} FROM final"""
ORACLE["scenario_budget"] = _PROJECTED + """
SELECT owner_id, currency, label, CAST(median_monthly_fijo AS DOUBLE) AS fixed,
  CAST(monthly_variable_budget AS DOUBLE) AS variable, CAST(monthly_savings AS DOUBLE) AS savings
FROM final WHERE year = 2001"""
ORACLE["scenario_matrix"] = _PROJECTED + """
SELECT owner_id, currency, year, CAST(max(cumulative_savings) FILTER (label = 'minimo') AS DOUBLE) AS minimo,
  CAST(max(cumulative_savings) FILTER (label = 'ambicioso') AS DOUBLE) AS ambicioso FROM final GROUP BY ALL"""

# --- Extraction --------------------------------------------------------------

_ORDER = "'o' || o_orderkey || '.txt' AS source_file"
_TOTAL = "CAST(o_totalprice AS DECIMAL(14,2))"
_DAY = "CAST(o_orderdate AS DATE)"

ORACLE["extract_regex_rows"] = """
SELECT p_brand || '.txt' AS source_file, p_partkey AS line_no,
  lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || upper(substr(p_name, 1, 3)) AS code, p_name AS name,
  CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS DOUBLE) AS contributions, CAST(p_size AS DOUBLE) AS units,
  CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS DOUBLE) AS unit_value,
  CAST(p_size * CAST(p_retailprice AS DECIMAL(14,2)) + CASE WHEN p_partkey % 37 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS market_value
FROM part WHERE p_partkey % 5 <> 0"""
ORACLE["extract_signed_rows"] = f"""
SELECT {_ORDER}, o_orderkey AS line_no, 'CLUB - ' || o_custkey AS description,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN {_TOTAL} ELSE -{_TOTAL} END AS DOUBLE) AS amount FROM orders"""
ORACLE["extract_scoped_rows"] = """
SELECT 'i' || l_suppkey || '.txt' AS source_file, lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || 'FND' AS code,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY l_suppkey, l_linenumber"""
ORACLE["extract_activity_rows"] = """
WITH e AS (SELECT *, CAST(value AS DECIMAL(14,2)) AS v, event_id % 50 + 0.25 AS price FROM events)
SELECT 'u' || user_id || '.txt' AS source_file,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN v ELSE 0 END) AS DOUBLE) AS own_contribution,
  CAST(sum(CASE WHEN event_type = 'signup' THEN v ELSE 0 END) AS DOUBLE) AS vested_units,
  CAST(sum(CASE WHEN event_type = 'signup' THEN v * CAST(price AS DECIMAL(14,2)) ELSE 0 END) AS DOUBLE) AS company_match
FROM e GROUP BY user_id"""
ORACLE["extract_fields"] = f"""
SELECT {_ORDER}, CAST({_TOTAL} AS DOUBLE) AS opening,
  CASE WHEN o_orderkey % 31 <> 0 THEN CAST({_TOTAL} + 10 AS DOUBLE) END AS closing,
  CAST({_TOTAL} + o_orderkey % 90 AS DOUBLE) AS charges, CAST(o_orderkey % 90 AS INTEGER) AS n_charges,
  CASE WHEN o_orderkey % 31 = 0 THEN 'closing' ELSE '' END AS missing
FROM orders"""
ORACLE["extract_label_amount"] = f"""
SELECT {_ORDER}, CAST(CASE WHEN o_orderkey % 19 = 0 THEN 1 WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 0
  ELSE {_TOTAL} END AS DOUBLE) AS amount FROM orders"""
ORACLE["detect_template"] = """
SELECT CAST(doc_id AS VARCHAR) AS source_file,
  CASE WHEN contains(text, 'é') AND NOT contains(text, ' the ') THEN 'modern'
       WHEN contains(text, ' the ') AND NOT contains(text, 'é') THEN 'legacy' END AS template
FROM documents"""
_LINES = """WITH parts AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p FROM documents),
lines AS (SELECT CAST(doc_id AS VARCHAR) AS source_file, unnest(p) AS text, unnest(range(len(p))) AS line_no FROM parts)"""
ORACLE["assemble_records"] = _LINES + """,
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^[AEIOU]') THEN 1 ELSE 0 END) OVER (
    PARTITION BY source_file ORDER BY line_no) AS n FROM lines)
SELECT source_file, CAST(n - 1 AS BIGINT) AS record_no, min(line_no) AS first_line, count(*) AS n_lines,
  arg_min(text, line_no) AS start_text, md5(string_agg(text, chr(10) ORDER BY line_no)) AS raw_md5
FROM numbered WHERE n > 0 GROUP BY source_file, n"""
_REGION = _LINES + """,
marked AS (SELECT *, CASE WHEN regexp_matches(text, '^[AEIOU]') THEN 'on' WHEN regexp_matches(text, '^[RST]') THEN 'off' END AS mark FROM lines),
state AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no) AS state FROM marked)"""
ORACLE["table_region"] = _REGION + """
SELECT source_file, line_no, md5(text) AS text_md5 FROM state WHERE state = 'on' AND mark IS NULL"""
ORACLE["table_region_once"] = _REGION + """,
begun AS (SELECT source_file, min(line_no) AS on_line FROM marked WHERE mark = 'on' GROUP BY 1),
ended AS (SELECT m.source_file, min(line_no) AS off_line FROM marked m JOIN begun USING (source_file)
  WHERE mark = 'off' AND line_no > on_line GROUP BY 1)
SELECT source_file, count(*) AS n_lines, max(line_no) AS last_line FROM state LEFT JOIN ended USING (source_file)
WHERE state = 'on' AND mark IS NULL AND (off_line IS NULL OR line_no < off_line) GROUP BY 1"""
ORACLE["fill_dates"] = _TABLES + """,
p AS (SELECT id, account_id, date, amount, CASE WHEN source_row NOT IN (2, 5) THEN date END AS printed FROM ledger)
SELECT id, account_id, printed, last_value(printed IGNORE NULLS) OVER
  (PARTITION BY account_id ORDER BY id, date, amount ROWS UNBOUNDED PRECEDING) AS filled_date FROM p"""
ORACLE["statement_period"] = f"""
WITH o AS (SELECT *, {_DAY} AS d FROM orders),
f AS (SELECT *, 'o' || o_orderkey || '.txt-' || upper(substr({_MONTHS_FULL}[month(d)], 1, 1)) || substr({_MONTHS_FULL}[month(d)], 2) AS source_file FROM o)
SELECT source_file, d AS period_start, d + 29 AS period_end, 'labels' AS kind FROM f
UNION ALL SELECT source_file, d, d + 29, 'days' FROM f
UNION ALL SELECT source_file, CAST(date_trunc('month', d) AS DATE), last_day(d), 'file_name' FROM f"""
_WORDS = _LINES + """,
split AS (SELECT source_file, line_no, string_split(text, ' ') AS w FROM lines),
spread AS (SELECT source_file, line_no, unnest(w) AS text, unnest(range(len(w))) AS w FROM split),
words AS (SELECT source_file, line_no, CAST(line_no // 40 AS INTEGER) AS page, text, w, w * 10.0 AS x0, (line_no % 40) * 10.0 AS base,
    (length(text) % 3) * 2.0 AS off FROM spread WHERE text <> '')"""
ORACLE["words_to_lines"] = _WORDS + """,
low AS (SELECT *, min(off) OVER (PARTITION BY source_file, line_no) AS lowest FROM words),
cut AS (SELECT *, off - lowest > 3 AS below FROM low)
SELECT source_file, page, CAST(min(base + off) AS DOUBLE) AS top, count(*) AS n_words, md5(string_agg(text, ' ' ORDER BY x0)) AS text_md5
FROM cut GROUP BY source_file, page, line_no, below"""
ORACLE["words_to_rounded_lines"] = _WORDS + """
SELECT source_file, page, CAST(round_even(base + off + 0.5, 0) AS INTEGER) AS line_top, count(*) AS n_words,
  md5(string_agg(text, ' ' ORDER BY x0, base + off)) AS text_md5
FROM words GROUP BY ALL"""
ORACLE["column_bounds"] = """
SELECT 'w' || s_suppkey || '.txt' AS source_file, CAST(s_suppkey % 7 + 105 AS DOUBLE) AS CHARGES,
  CAST(s_suppkey % 7 + 205 AS DOUBLE) AS CREDITS, CAST(s_suppkey % 7 + 305 AS DOUBLE) AS BALANCE FROM supplier"""
ORACLE["classify_columns"] = """
WITH w AS (SELECT 'w' || l_suppkey || '.txt' AS source_file, l_suppkey % 7 AS s, l_extendedprice,
    80 + (l_partkey * 13 + l_orderkey) % 380 AS x FROM lineitem)
SELECT source_file, CASE WHEN x < s + 105 THEN 'unknown' WHEN x < s + 205 THEN 'CHARGES' WHEN x < s + 305 THEN 'CREDITS'
  ELSE 'BALANCE' END AS "column", count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS amount
FROM w GROUP BY ALL"""
ORACLE["column_streams"] = _WORDS + """
SELECT source_file, page, CASE WHEN x0 < 40 THEN 'left' WHEN x0 < 90 THEN 'mid' ELSE 'right' END AS stream,
  md5(string_agg(text, ' ' ORDER BY base + off, x0, line_no)) AS text_md5
FROM words GROUP BY ALL"""
ORACLE["headerless_page_end"] = _WORDS + """,
pages_ AS (SELECT source_file, page, count(*) AS n, bool_or(lower(text) = 'the') AND bool_or(lower(text) = 'of') AS has
  FROM words GROUP BY ALL),
firsts AS (SELECT source_file, min(page) AS f FROM pages_ WHERE has GROUP BY 1),
stops AS (SELECT p.source_file, min(page) AS s FROM pages_ p JOIN firsts USING (source_file) WHERE NOT has AND page > f GROUP BY 1)
SELECT source_file, CAST(sum(n) AS BIGINT) AS n_words, max(page) AS last_page
FROM pages_ JOIN firsts USING (source_file) LEFT JOIN stops USING (source_file)
WHERE page >= f AND (s IS NULL OR page < s) GROUP BY 1"""
ORACLE["nearest_value"] = f"""
WITH v AS (SELECT o_custkey, o_orderkey, {_TOTAL} AS total, abs(o_orderkey % 41 - 20) AS gap FROM orders WHERE o_orderkey % 5 <> 0),
n AS (SELECT * FROM v WHERE gap <= 8 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY gap, o_orderkey) = 1)
SELECT 'p' || c_custkey || '.txt' AS source_file, CAST(total AS DOUBLE) AS value FROM customer LEFT JOIN n ON c_custkey = o_custkey"""
ORACLE["stage_card_rows"] = _TABLES + """
SELECT source_file, id AS source_row, date, date AS post_date, CAST(amount AS DOUBLE) AS amount, description,
  CASE WHEN currency <> 'MXN' THEN CAST(abs(amount) AS DOUBLE) END AS foreign_amount,
  CASE WHEN currency <> 'MXN' THEN currency END AS foreign_currency, external_ref FROM ledger"""
ORACLE["stage_sectioned_balances"] = f"""
SELECT {_ORDER}, {_DAY} AS date, 'Bitcoin' AS sub_portfolio, CAST(o_orderkey % 1000 + 0.5 AS DOUBLE) AS units,
  CAST({_TOTAL} AS DOUBLE) AS market_value, 'USD' AS currency FROM orders
UNION ALL SELECT {_ORDER}, {_DAY}, 'Ether', 2.0, 1.0, 'USD' FROM orders"""
ORACLE["stage_sectioned_movements"] = f"""
SELECT {_ORDER}, 0 AS source_row, {_DAY} AS date, 'Compra: Bitcoin' AS description, 'BTC' AS currency,
  CAST(o_orderkey % 1000 + 0.25 AS DOUBLE) AS units, CAST({_TOTAL} AS DOUBLE) AS fiat_value FROM orders
UNION ALL SELECT {_ORDER}, 1, {_DAY}, 'Venta: Ether', 'ETH', -1.0, 1.0 FROM orders"""
ORACLE["stage_xml_block"] = f"""
SELECT {_ORDER}, 0 AS line_no, 'C' || o_custkey AS contract, 'Interest, net' AS description, CAST({_TOTAL} AS DOUBLE) AS amount,
  {_DAY} AS date, 'F' || o_orderkey AS external_ref FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT {_ORDER}, 1, 'C' || o_custkey, 'Fee', CAST(-(o_orderkey % 100 + 0.5) AS DOUBLE), {_DAY}, 'G' || o_orderkey
FROM orders WHERE o_orderkey % 10 <> 0"""

# --- Scalars -----------------------------------------------------------------

ORACLE["parse_money"] = f"""
WITH o AS (SELECT o_orderkey AS key, CAST({_TOTAL} AS DOUBLE) AS v FROM orders)
SELECT key, v AS suffix, CASE WHEN key % 2 = 0 THEN -v ELSE v END AS signed, -v AS paren, -v AS trailing, v AS unsigned,
  v AS spaced, CASE WHEN key % 3 = 0 THEN 0 ELSE v END AS dash_zero, CASE WHEN key % 5 <> 0 THEN v END AS unreadable FROM o"""
ORACLE["parse_dates"] = f"""
WITH o AS (SELECT o_orderkey AS key, {_DAY} AS d FROM orders)
SELECT key, d AS dashed, d AS slashed, d AS numeric, d AS spaced, d AS us,
  CASE WHEN day(last_day(d)) = 31 THEN last_day(d) END AS day_31, CAST(month(d) AS INTEGER) AS month_number FROM o"""
ORACLE["resolve_year"] = f"""
WITH o AS (SELECT o_orderkey AS key, {_DAY} AS d, {_DAY} - CAST(o_orderkey % 25 AS INTEGER) AS s,
    {_DAY} + CAST(o_orderkey % 28 AS INTEGER) AS e FROM orders)
SELECT key, CASE WHEN month(d) = month(s) THEN make_date(year(s), month(d), day(d))
  WHEN month(d) = month(e) THEN make_date(year(e), month(d), day(d)) ELSE make_date(year(e), month(d), day(d)) END AS resolved FROM o"""
ORACLE["card_dates"] = f"""
WITH o AS (SELECT o_orderkey AS key, {_DAY} AS d, CAST(o_orderkey % 23 AS INTEGER) AS n, CAST(1 + o_orderkey % 31 AS INTEGER) AS c FROM orders),
cut AS (SELECT *, {_cutoff('d', 'c')} AS cutoff FROM o)
SELECT key, cutoff, {_add_business('d', 'n')} AS business,
  CASE WHEN key % 2 = 0 THEN cutoff + n ELSE {_add_business('cutoff', 'n')} END AS due,
  CAST((1998 - year(d)) * 12 + 12 - month(d) AS INTEGER) AS months_left FROM cut"""
ORACLE["fold_accents"] = "SELECT doc_id, md5(strip_accents(text)) AS folded_md5 FROM documents"
ORACLE["text_functions"] = _TABLES + """
SELECT id, coalesce(raw_description, '') || ' ' || description AS haystack, right(source_file, 4) AS extension,
  source_file AS base_name, lpad(external_ref, 8, '0') AS reference, 'A' || source_file AS slash_reference,
  CASE spend_frequency WHEN 'fijo' THEN 'Fijo' WHEN 'variable' THEN 'Variable' END AS frequency
FROM ledger"""
