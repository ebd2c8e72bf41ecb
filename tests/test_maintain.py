"""Repeated requests, generated ids, real-world CSV, failing reads."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from tally.errors import ModelNotFoundError, ValidationError
from tally.operators import categorize as C
from tally.operators import listing as LS
from tally.operators import maintain as K
from tally.operators.joins import first_in_batch
from tally.sources import csv as CSV
from tally.sources import ledger as LG
from tally.session import scratch_path
from tally.streaming import ingest as STREAM

LEDGER = ("transaction_id string, account_id string, description string, category string, amount bigint, "
          "direction string, currency string, transaction_date date, posted_at timestamp_ntz")


def _ledger(spark):
    import datetime as dt
    day, at = dt.date(2024, 1, 2), dt.datetime(2024, 1, 2)
    return spark.createDataFrame([("t1", "a1", "old", "Rent", 5, "inflow", "USD", day, at),
                                  ("t2", "a1", "x", "Rent", 6, "inflow", "USD", day, at)], LEDGER)


def _accounts(spark):
    return spark.createDataFrame([("a1", 1, "1234567890", 10, "USD", None)],
                                 "account_id string, user_id bigint, account_number string, starting_balance bigint, "
                                 "currency string, last_updated date")


def test_inserts_without_ids_lose_no_row(spark):
    rows = spark.range(400_000).select(
        F.lit(None).cast("string").alias("transaction_id"), F.lit("a1").alias("account_id"), F.lit("d").alias("description"),
        F.lit(None).cast("string").alias("category"), F.lit(5).cast("bigint").alias("amount"), F.lit("inflow").alias("direction"),
        F.lit("2024-01-02").alias("transaction_date"), F.lit(None).cast("string").alias("posted_at"), F.col("id").alias("_row"))
    got = K.insert_tx(rows, _ledger(spark), _accounts(spark), "2024-01-03 00:00:00")
    assert {r["status"]: r["count"] for r in got.groupBy("status").count().collect()} == {"inserted": 400_000}
    assert got.select("transaction_id").distinct().count() == 400_000


def test_insert_for_an_unknown_account_is_an_error(spark):
    rows = spark.createDataFrame([("n1", "nobody", "d", None, 5, "inflow", "2024-01-02", None, 0)],
                                 "transaction_id string, account_id string, description string, category string, "
                                 "amount bigint, direction string, transaction_date string, posted_at string, _row bigint")
    got = K.insert_tx(rows, _ledger(spark), _accounts(spark), "2024-01-03 00:00:00").collect()
    assert [(r.status, r.errors) for r in got] == [("error", "account_unknown")]


def test_import_with_a_bad_date_is_an_error(spark):
    rows = spark.createDataFrame([("n1", "a1", "d", "", "5", "inflow", "notadate", 0)],
                                 "transaction_id string, account_id string, description string, category string, "
                                 "amount string, direction string, transaction_date string, _row bigint")
    assert [r.status for r in K.import_csv(rows, _ledger(spark)).collect()] == ["error"]


def test_two_patches_of_one_row(spark):
    patches = spark.createDataFrame([("a1", "t1", "first", "Sales", 0), ("a1", "t1", "second", "", 1)],
                                    "account_id string, transaction_id string, description string, category string, _row bigint")
    got = {r.transaction_id: (r.description, r.category) for r in K.update_tx(_ledger(spark), patches).collect()}
    assert K.update_tx(_ledger(spark), patches).count() == 2
    assert got["t1"] == ("second", "Sales")
    accounts = spark.createDataFrame([("a1", 7, None, 0), ("a1", None, "EUR", 1)],
                                     "account_id string, starting_balance bigint, currency string, _row bigint")
    got = K.account_update(_accounts(spark), accounts, "2024-05-05").collect()
    assert [(r.starting_balance, r.currency) for r in got] == [(7, "EUR")]


def test_append_stores_a_repeated_id_once(spark):
    batch = _ledger(spark).withColumn("transaction_id", F.lit("n1"))
    path = scratch_path(spark, "append-test")
    LG.ledger_append(batch, _ledger(spark), path)
    assert LG.read_ledger(spark, path).count() == 1


def test_new_rows_picks_the_same_copy_at_equal_times(spark):
    batch = _ledger(spark).withColumn("transaction_id", F.lit("n1"))
    got = {first_in_batch(batch.repartition(n), order=("posted_at",)).collect()[0].description for n in (1, 2, 5)}
    assert got == {"old"}


def test_csv_with_quotes_and_line_breaks(spark):
    path = scratch_path(spark, "quoted")
    values = ['He said ""hi"", ok'.replace('""', '"'), "two\nlines", "plain, with comma"]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, description string").coalesce(1)
    CSV.write_csv(df, path)
    back = CSV.read_raw(spark, path, multi_line=True).orderBy("id").collect()
    assert [r.description for r in back] == values
    (name,) = glob.glob(f"{path.removeprefix('file:')}/part-*.csv")
    with open(name, newline="") as f:
        assert [r[1] for r in csv.reader(f)][1:] == values


def test_a_failing_ledger_read_fails_the_batch(spark, monkeypatch):
    def broken(*_args, **_options):
        raise OSError("storage is away")
    assert STREAM._existing(spark, scratch_path(spark, "nothing-here")) is None
    monkeypatch.setattr(LG, "read_ledger", broken)
    with pytest.raises(OSError):
        STREAM._existing(spark, "anywhere")


UPLOAD = "transaction_id,account_id,description,category,amount,direction,transaction_date\n"


def _upload(spark, **files):
    path = scratch_path(spark, "upload-files")
    os.makedirs(path.removeprefix("file:"), exist_ok=True)
    for name, text in files.items():
        with open(f"{path.removeprefix('file:')}/{name}.csv", "w") as f:
            f.write(text)
    return path


def test_import_of_several_files(spark):
    """Shared ids, missing ids at the same index, and a repeated id in one file."""
    path = _upload(spark, a=UPLOAD + "n1,a1,first,,5,inflow,2024-01-02\n,a1,no id,,6,inflow,2024-01-02\n",
                   b=UPLOAD + "n1,a1,second,,5,inflow,2024-01-02\n,a1,no id either,,7,inflow,2024-01-02\nn2,a9,x,,1,inflow,soon\n")
    rows = CSV.stage_csv(spark, path, scratch_path(spark, "staged"))
    got = K.import_csv(rows, _ledger(spark), as_of_ts="2024-05-05 00:00:00", accounts=_accounts(spark)).collect()
    assert {r.description: r.status for r in got} == {"first": "inserted", "second": "duplicate", "no id": "inserted",
                                                      "no id either": "inserted", "x": "error"}
    assert len({r.transaction_id for r in got if r.status == "inserted"}) == 3
    assert {(r.currency, str(r.posted_at)) for r in got if r.status == "inserted"} == {("USD", "2024-05-05 00:00:00")}
    errors = K.import_errors(K.import_csv(rows, _ledger(spark), accounts=_accounts(spark))).collect()
    assert [(r.file.rsplit("/", 1)[1], r.row, r.error) for r in errors] == [("b.csv", 4, "account_unknown,transaction_date_invalid")]


def test_import_without_optional_columns(spark):
    rows = spark.createDataFrame([("n1", "a1", 0)], "transaction_id string, account_id string, _row bigint")
    (r,) = K.import_csv(rows, _ledger(spark), as_of_ts="2024-05-05 00:00:00").collect()
    assert (r.status, r.amount, r.direction, str(r.transaction_date), r.description) == (
        "inserted", 0, "outflow", "2024-05-05", "")


def test_files_with_another_header_fail(spark):
    path = _upload(spark, a="transaction_id,amount\nt1,5\n", b="amount,transaction_id\n5,t2\n")
    with pytest.raises(Exception, match="CSV header"):
        CSV.read_raw(spark, path).collect()
    same = _upload(spark, a="transaction_id, amount\nt1,5\n", b="transaction_id, amount\nt2,6\n")
    assert sorted((r.transaction_id, r.amount) for r in CSV.read_raw(spark, same).collect()) == [("t1", "5"), ("t2", "6")]


def test_refused_accounts_block_no_other(spark):
    rows = [("1", "0000000001", 0), ("1", "0000000002", 1), ("2", "0000000002", 2), ("2", "0000000003", 3), ("3", "0000000003", 4)]
    req = spark.createDataFrame([(i, 1, n, 5, "USD", k) for i, n, k in rows],
                                "account_id string, user_id bigint, account_number string, starting_balance bigint, "
                                "currency string, _row bigint")
    got = {r._row: r.status for r in K.account_create(_accounts(spark), req, "2024-05-05").collect()}
    ids, numbers, expected = set(), set(), {}
    for i, n, k in rows:
        expected[k] = "duplicate" if i in ids or n in numbers else "created"
        if expected[k] == "created":
            ids.add(i), numbers.add(n)
    assert got == expected


def test_backup_keeps_the_existing_copy(spark):
    led = _ledger(spark)
    new = led.withColumn("description", F.lit("new")).unionByName(
        led.withColumn("transaction_id", F.lit("t3")).withColumn("description", F.lit("added")))
    for n in (1, 3):
        got = {r.transaction_id: r.description for r in LG.processed_merge(led, new.repartition(n)).collect()}
        assert got == {"t1": "old", "t2": "x", "t3": "added"}


ACCOUNT_REQUEST = "account_id string, user_id bigint, account_number string, starting_balance bigint, currency string, _row bigint"


def test_account_requests_always_end(spark):
    """Null and empty ids, null numbers, repeated requests and chains, against a plain reading in order."""
    import random
    import time
    rng = random.Random(2)
    rows = [(rng.choice([None, "", "1", "2", "3", "4"]), 1, rng.choice([None, *(f"000000000{n}" for n in range(1, 5))]),
             rng.choice([5, 5, 5, 0, None]), "USD", k) for k in range(40)]
    ids, numbers = ({r[c] for r in _accounts(spark).collect()} for c in ("account_id", "account_number"))
    new_ids, new_numbers, want = set(), set(), {}
    for i, _, n, b, _, k in rows:
        if i in ids or n in numbers:
            want[k] = "duplicate"
        elif not i or n is None or not b:
            want[k] = "error"
        elif i in new_ids or n in new_numbers:
            want[k] = "duplicate"
        else:
            want[k] = "created"
            new_ids.add(i), new_numbers.add(n)
    t0 = time.time()
    got = K.account_create(_accounts(spark), spark.createDataFrame(rows, ACCOUNT_REQUEST), "2024-05-05").collect()
    assert {r._row: r.status for r in got} == want and len(got) == len(rows)
    assert all("account_id_missing" in r.errors for r in got if not r.account_id)
    assert time.time() - t0 < 120
    for bad in ([(*rows[5][:5], 1), (*rows[6][:5], 1)], [(*rows[5][:5], None)]):
        with pytest.raises(ValidationError):
            K.account_create(_accounts(spark), spark.createDataFrame(bad, ACCOUNT_REQUEST), "2024-05-05")


def test_a_model_that_cannot_be_read_is_not_missing(spark):
    with pytest.raises(ModelNotFoundError):
        C.load_model(scratch_path(spark, "no-model"))
    path = scratch_path(spark, "broken-model")
    spark.createDataFrame([("no model",)], "value string").write.text(f"{path}/metadata")
    with pytest.raises(Exception) as e:
        C.load_model(path)
    assert not isinstance(e.value, ModelNotFoundError)


def test_an_empty_page_has_its_total(spark):
    page = LS.list_page(_ledger(spark), offset=5, limit=5).collect()
    assert [(r.account_id, r.total, r.transaction_id, r.position) for r in page] == [("a1", 2, None, None)]
