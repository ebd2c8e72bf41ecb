"""The CSV export is read back with its columns given: account ids stay as they are."""

import datetime as dt

from tally.plans import q_ingest as Q
from tally.sources.ledger import staged
from tests.test_maintain import LEDGER


def test_account_ids_of_the_export(spark, monkeypatch):
    day, at = dt.date(2024, 1, 2), dt.datetime(2024, 5, 1)
    rows = [("t1", "007", "", "Rent", 5, "inflow", "USD", day, at), ("t2", "7", 'a "b", c', None, 6, "outflow", "USD", day, at),
            ("t3", "8", "x", "Rent", 7, "inflow", "USD", dt.date(1999, 1, 1), at)]
    led = staged(spark.createDataFrame(rows, LEDGER), "t-led")
    monkeypatch.setattr(Q, "_led", lambda spark, d: led)
    out = Q.export_csv(spark, "")
    assert sorted(map(tuple, out.collect())) == sorted(
        (r.transaction_id, r.account_id, r.description, r.category, r.amount, r.direction, r.transaction_date, r.posted_at)
        for r in led.where("transaction_date >= '2000-01-01'").collect())
    assert out.columns == ["transaction_id", "account_id", "description", "category", "amount", "direction", "transaction_date", "posted_at"]
