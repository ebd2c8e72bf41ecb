import pytest
from pyspark.sql import functions as F

from tally.errors import ValidationError
from tally.operators import validate as V
from tally.schema import REQUIRED_COLUMNS

COLS = ", ".join(f"{c} string" for c in REQUIRED_COLUMNS) + ", currency string"
ROWS = [
    (" t1", "1", "Cash Sale", "", "3.5", " Inflow\t", "2025-01-01", "2025-01-01 08:00", "NGN"),
    ("t2", "1", "x", "", "2.5", "outflow", "2025-01-01 10:00:00", "2025-01-01 08:00", "JPY"),
    ("t3", "1", "x", "", "NaN", "outflow", "2025-01-01", "2025-01-01 08:00", "USD"),
    ("t4", "1", "x", "", "Infinity", "outflow", "2025-01-01", "2025-01-01 08:00", "USD"),
    ("t5", "1", "x", "", "10", "sideways", "2025-01-01", "2025-01-01 08:00", "USD"),
    ("t6", "1", "x", "", "10", "inflow", "01/02/2025", "2025-01-01 08:00", "USD"),
    ("t7", "1", "x", "", "10", "inflow", "2025-01-01", "2025-01-01 08:00", "XOF"),
    ("t8", "1", "x", "", "0.125", "inflow", "2025-01-01", "2025-01-01 08:00", "EUR"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, COLS)


def test_valid_rows_and_units(raw):
    v = {r.transaction_id: r for r in V.validate_transactions(raw).collect()}
    assert set(v) == {"t1", "t2", "t8"}
    assert v["t1"].amount == 350 and v["t1"].direction == "inflow"
    assert v["t2"].amount == 2  # JPY: no decimals, half to even
    assert v["t8"].amount == 12  # 12.5 -> 12 (half to even)


def test_quarantine_codes(raw):
    q = {r.transaction_id: r.violations for r in V.quarantine(raw).collect()}
    assert q == {"t3": "amount_invalid", "t4": "amount_invalid", "t5": "direction_invalid",
                 "t6": "transaction_date_invalid", "t7": "currency_unsupported"}


def test_strict_mode_reports_first_check(raw):
    with pytest.raises(ValidationError, match="direction_invalid"):
        V.assert_valid(raw)


def test_schema_check(raw):
    with pytest.raises(ValidationError):
        V.schema_check(raw.drop("posted_at"))


def test_default_currency_when_column_absent(raw):
    n = V.normalize_types(raw.drop("currency"))
    assert {r.currency for r in n.select("currency").collect()} == {"NGN"}


def test_default_fill(raw):
    f = V.default_fill(raw.drop("amount", "direction"), "2025-06-30 12:00:00").first()
    assert (f.amount, f.direction) == ("0", "outflow")
    kept = V.default_fill(raw, "2025-06-30 12:00:00").first()
    assert kept.amount == "3.5"
