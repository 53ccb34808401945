"""A rule set over the words of the test tables, one rule or more per stage."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from tallyspark.operators.classify import Rule

HOLDER_PATTERNS = (r"Brand#7\b", r"Brand#2[34]\b")
HOLDER_EXCLUDED = ("Customer#000000007", "Customer#000000011", "Customer#000000100")
TRANSFER_CATEGORY = "Own transfer"
FIXED_PATTERNS = (r"\bring$", r"Brand#1\d (old|new)", r"cold g")

RULES = (
    Rule(101, 1, 1, "Card payment", r"Brand#1\b.*ring"),
    Rule(102, 1, 2, "Card payment", r"Brand#3\b.*ring"),
    Rule(103, 1, 3, "Other income", r"Brand#5\b.*(ring|rod)"),
    Rule(201, 2, 1, "Travel", r"Brand#10 .*anvil"),
    Rule(202, 2, 2, "Travel", r"Brand#11 .*anvil"),
    Rule(301, 3, 1, "Own transfer", r"Brand#9 .*gear"),
    Rule(401, 4, 1, "Housing", r"Brand#8 .*gear"),
    Rule(501, 5, 1, "Salary", r"cold (rod|plate)"),
    Rule(601, 6, 1, "Travel", r"Brand#12 red widget"),
    Rule(
        602, 6, 2, "Travel", r"blue widget|\bZORK\b",
        valid_from=date(1997, 4, 1), valid_until=date(1997, 8, 31), abs_amount=Decimal("50000.00"),
    ),
    Rule(701, 7, 1, "Travel", r"hot gizmo", sign=1),
    Rule(801, 8, 1, "Housing", r"Brand#2\b", pattern2=r"bolt|anvil|\b9ZQ\b", valid_from=date(1996, 8, 1)),
    Rule(901, 9, 1, "Health", r"large bolt", valid_from=date(1996, 1, 1), valid_until=date(1998, 12, 31)),
    Rule(902, 9, 2, "Dining", r"large bolt", valid_from=date(1998, 6, 1)),
    Rule(1001, 10, 1, "Transport", r"Brand#15 .*plate"),
    Rule(1101, 11, 1, "Housing", r"(?<![A-Za-z])HOT\b"),
    Rule(1201, 12, 1, "Groceries", r"^small"),
    Rule(1202, 12, 2, "Groceries", r"small (ring|rod)"),
    Rule(1203, 12, 3, "Groceries", r"small gear|new gear"),
    Rule(1204, 12, 4, "Dining", r"red (ring|gizmo|bolt)"),
    Rule(1205, 12, 5, "Ghost", r"old plate"),
    Rule(1206, 12, 6, "Dining", r"old (plate|rod)"),
    Rule(1207, 12, 7, "Transport", r"blue \w+r\b|blue anvil"),
    Rule(1208, 12, 8, "Health", r"large \w+"),
    Rule(1209, 12, 9, "Dining", r"large ring"),
    Rule(1210, 12, 10, "Transport", r"widget"),
)

# A long rule book: neighbours name different categories, so none of them merge.
MANY_RULES = tuple(
    Rule(5000 + k, 12, k, ("Travel", "Dining", "Groceries", "Transport", "Health")[k % 5], rf"Brand#{1 + k // 8}\b.*{noun}")
    for k, noun in enumerate(("ring", "rod", "plate", "gear", "bolt", "anvil", "widget", "gizmo") * 30)
)

DATED_RULES = tuple(r for r in RULES if r.stage in (6, 7, 8, 9))
