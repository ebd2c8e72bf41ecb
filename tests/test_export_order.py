"""The JSON export brings its rows into order once."""

import json

from pyspark.sql import functions as F

from tally.schema import LISTING_COLUMNS
from tally.session import scratch_path
from tally.sources import export as EX


def _ledger(spark):
    rows = [(f"t{i:02d}", str(i % 2), "d", None, i, "inflow", "USD", f"2025-01-{1 + i % 5:02d}") for i in range(20)]
    return spark.createDataFrame(rows, "transaction_id string, account_id string, description string, category string, "
                                       "amount bigint, direction string, currency string, transaction_date string").selectExpr(
        "*", "cast(transaction_date as timestamp_ntz) as posted_at").withColumn(
        "transaction_date", F.col("transaction_date").cast("date"))


def test_json_lines_are_ordered_by_one_range_shuffle(spark):
    plan = EX.json_lines(_ledger(spark), "2025-06-30")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1


def test_json_export_holds_a_header_then_rows_newest_first(spark):
    path = scratch_path(spark, "t-export")
    led = _ledger(spark)
    EX.export_json(led, path, "2025-06-30")
    lines = [r.value for r in spark.read.text(f"{path}/account_id=1").coalesce(1).collect()]
    want = [r.transaction_id for r in led.where("account_id = '1'").orderBy(F.col("transaction_date").desc(), "transaction_id").collect()]
    assert json.loads(lines[0])["transaction_count"] == 10
    assert [json.loads(x)["transaction_id"] for x in lines[1:]] == want
    assert set(json.loads(lines[1])) <= set(LISTING_COLUMNS)
