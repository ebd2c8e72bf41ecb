"""Keyword rules: the expectations of the original unit tests, plus traps."""

import pytest
from pyspark.sql import functions as F

from tally.functions.text import rule_category

CASES = [
    ("Monthly Salary Payment", "outflow", "Salaries"),
    ("Electricity Bill", "outflow", "Utilities"),
    ("Office Rent", "outflow", "Rent"),
    ("Cash Sale", "inflow", "Revenue"),
    ("Facebook Ads Campaign", "outflow", "Marketing"),
    ("Inventory Restock", "outflow", "Inventory"),
    ("Equipment repair", "outflow", None),
    ("Client consultation", "inflow", None),
    ("Annual subscription", "outflow", None),
    ("", "inflow", "Revenue"),
    (None, "outflow", "Miscellaneous"),
    ("bonus payment", "outflow", "Salaries"),
    ("internet service", "outflow", "Utilities"),
    ("pos transaction", "inflow", "Revenue"),
    ("random unknown expense", "outflow", None),
    (" N/A ", "inflow", "Revenue"),
    ("nil", "outflow", "Miscellaneous"),
    ("-", "outflow", "Miscellaneous"),
    (" none\t", "outflow", "Miscellaneous"),
    ("Current account fee", "outflow", "Rent"),
    ("driver salary and fuel cost", "outflow", "Salaries"),
    ("Tools & Hardware", "outflow", "Supplies"),
    ("FREIGHT charges", "outflow", "Miscellaneous"),
]


@pytest.fixture(scope="module")
def result(spark):
    df = spark.createDataFrame(CASES, "description string, direction string, expected string")
    return df.withColumn("got", rule_category(F.col("description"), F.col("direction"))).collect()


def test_rule_categories(result):
    bad = [(r.description, r.expected, r.got) for r in result if r.expected != r.got]
    assert not bad


def test_categorize_scored_and_resolve(spark):
    from tally.operators.categorize import categorize_scored, fill_categories, fill_report, resolve_category
    df = spark.createDataFrame(
        [("1", "a", "Office Rent", "outflow", None), ("2", "a", "zzz", "outflow", ""),
         ("3", "a", "zzz", "inflow", "Salaries"), ("4", "b", "Cash Sale", "inflow", "  ")],
        "transaction_id string, account_id string, description string, direction string, category string")
    s = {r.transaction_id: (r.category, r.confidence) for r in categorize_scored(df).collect()}
    assert s["1"] == ("Rent", 0.85) and s["2"] == ("Miscellaneous", 0.6)
    r = {x.transaction_id: x.category for x in resolve_category(df).collect()}
    assert r == {"1": "Rent", "2": "Miscellaneous", "3": "Salaries", "4": "  "}
    rep = {x.account_id: (x.categorized, x.already_categorized) for x in fill_report(fill_categories(df)).collect()}
    assert rep == {"a": (2, 1), "b": (0, 1)}
