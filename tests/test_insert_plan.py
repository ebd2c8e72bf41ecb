"""The checks and ids of a batch are worked out once a row, not again in each term of a filter at the scan."""

from tally.operators import maintain as K
from tally.sources.ledger import staged

REQUESTS = ("transaction_id string, account_id string, description string, category string, amount bigint, direction string, "
            "transaction_date string, posted_at string, _row bigint")


def test_no_filter_writes_out_the_ids(spark):
    rows = [("a", "1", "office rent", None, 5, "inflow", "2024-01-01", None, 0), ("a", "2", "x", None, 5, "inflow", "2024-01-01", None, 1),
            (None, "1", "x", None, 5, "inflow", "2024-01-01", None, 2), ("", "1", "x", None, 0, "inflow", "2024-01-01", None, 3),
            ("a", "1", "x", None, -5, "inflow", "2024-01-01", None, -1), ("h", "1", "x", None, 5, "inflow", "2024-01-01", None, 4)]
    requests = staged(spark.createDataFrame(rows, REQUESTS), "t-requests")
    ledger = staged(spark.createDataFrame([("h", "1"), (None, "1")], "transaction_id string, account_id string"), "t-held")
    accounts = staged(spark.createDataFrame([("1", "USD"), ("2", "EUR")], "account_id string, currency string"), "t-accounts")
    out = K.insert_tx(requests, ledger, accounts, "2025-06-30 12:00:00")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "sha2" in line]
    assert {r._row: r.status for r in out.collect()} == {
        -1: "error", 0: "inserted", 1: "error", 2: "inserted", 3: "error", 4: "duplicate"}
