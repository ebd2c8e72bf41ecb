"""CSV import / insert classification against hand-checked expectations."""

import os
import tempfile

from pyspark.sql import functions as F

from tally.operators import maintain as K
from tally.sources import csv as CSV

LEDGER = [("L1", "acct1"), ("L2", "acct2")]


def _ledger(spark):
    return spark.createDataFrame(LEDGER, "transaction_id string, account_id string")


def test_upload_classification(spark):
    rows = [
        ("L1", "acct1", "x", "", "100", "inflow", "2025-01-01"),   # in ledger, same account
        ("L2", "acct1", "x", "", "100", "inflow", "2025-01-01"),   # id held by another account
        ("N1", "acct1", "x", "", "3.5", "inflow", "2025-01-01"),   # bad amount, first copy
        ("N1", "acct1", "x", "", "100", "inflow", "2025-01-01"),   # first valid copy
        ("N1", "acct1", "x", "", "bad", "inflow", "2025-01-01"),   # later copy
        ("N2", "acct1", "x", "", "5", "Inflow", "2025-01-01"),     # direction is case-sensitive
        ("", "acct1", "Office Rent", "", "7", "outflow", "2025-01-01"),  # generated id
    ]
    df = spark.createDataFrame(rows, "transaction_id string, account_id string, description string, category string, "
                                     "amount string, direction string, transaction_date string")
    df = df.withColumn("_row", F.monotonically_increasing_id())
    rank = {r._row: i for i, r in enumerate(df.select("_row").orderBy("_row").collect())}
    out = K.import_csv(df, _ledger(spark), mode="upload").collect()
    got = sorted((rank[r._row], r.transaction_id if r.transaction_id.startswith(("L", "N")) else "gen", r.status)
                 for r in out)
    assert [g[2] for g in got] == ["duplicate", "error", "error", "inserted", "duplicate", "error", "inserted"]
    cat = [r.category for r in out if r.description == "Office Rent"]
    assert cat == ["Rent"]


def test_import_mode_requires_id(spark):
    rows = [("", "acct1", "x", "", "1", "inflow", "2025-01-01"), ("L2", "acct1", "x", "", "1", "inflow", "2025-01-01")]
    df = spark.createDataFrame(rows, "transaction_id string, account_id string, description string, category string, "
                                     "amount string, direction string, transaction_date string")
    out = K.import_csv(df.withColumn("_row", F.monotonically_increasing_id()), _ledger(spark), mode="import")
    assert sorted(r.status for r in out.collect()) == ["duplicate", "error"]


def test_row_numbers(spark):
    d = tempfile.mkdtemp(prefix="tally-csv-")
    p = os.path.join(d, "upload.csv")
    with open(p, "w") as f:
        f.write("transaction_id,amount\n")
        for i in range(1000):
            f.write(f"t{i},{i}\n")
    rows = CSV.with_row_numbers(CSV.read_raw(spark, p)).collect()
    assert all(int(r.transaction_id[1:]) == r._row for r in rows)
    assert len(rows) == 1000


def test_account_maintenance(spark):
    acc = spark.createDataFrame([("1", 1, "0000000001", 100, "USD", None)],
                                "account_id string, user_id long, account_number string, starting_balance long, "
                                "currency string, last_updated date")
    req = spark.createDataFrame([("2", 1, "0000000002", 5, "USD", 0), ("3", 1, "0000000001", 5, "USD", 1),
                                 ("4", 1, "12", 5, "USD", 2), ("5", 1, "0000000005", -5, "usd", 3)],
                                "account_id string, user_id long, account_number string, starting_balance long, "
                                "currency string, _row long")
    st = {r.account_id: r.status for r in K.account_create(acc, req, "2025-06-30").collect()}
    assert st == {"2": "created", "3": "duplicate", "4": "error", "5": "error"}
    led = spark.createDataFrame([("t", "1")], "transaction_id string, account_id string")
    keys = spark.createDataFrame([("1",), ("9",)], "account_id string")
    status, after = K.account_delete(acc, led, keys)
    assert {r.account_id: r.status for r in status.collect()} == {"1": "has_transactions", "9": "not_found"}
    assert after.count() == 1


def test_insert_single_mode_duplicate_is_error(spark):
    req = spark.createDataFrame(
        [("L1", "acct1", "Office Rent", None, 5, "outflow", "2025-01-01", None, 0),
         ("N9", "acct1", "Office Rent", None, 5, "outflow", "2025-01-01", None, 1)],
        "transaction_id string, account_id string, description string, category string, amount long, "
        "direction string, transaction_date string, posted_at string, _row long")
    acc = spark.createDataFrame([("acct1", "NGN")], "account_id string, currency string")
    bulk = {r.transaction_id: r.status for r in K.insert_tx(req, _ledger(spark), acc, "2025-06-30 12:00:00").collect()}
    single = {r.transaction_id: r.status
              for r in K.insert_tx(req, _ledger(spark), acc, "2025-06-30 12:00:00", mode="single").collect()}
    assert bulk == {"L1": "duplicate", "N9": "inserted"} and single == {"L1": "error", "N9": "inserted"}


def test_row_numbers_across_files_and_splits(spark):
    d = tempfile.mkdtemp(prefix="tally-csv-multi-")
    sizes = {"a.csv": 5000, "b.csv": 1, "c.csv": 7000}
    for name, n in sizes.items():
        with open(os.path.join(d, name), "w") as f:
            f.write("transaction_id,note\n")
            for i in range(n):
                f.write(f"{name}:{i},{'x' * (i % 17)}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        raw = CSV.read_raw(spark, d)
        assert raw.rdd.getNumPartitions() > 3  # files really are split
        rows = CSV.with_row_numbers(raw).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == sum(sizes.values())
    assert all(int(r.transaction_id.split(":")[1]) == r._row for r in rows)
