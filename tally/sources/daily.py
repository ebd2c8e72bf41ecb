"""The account-day table of a stored ledger: ``<ledger>/_daily``.

One row per account and day (inflow, outflow, rows), partitioned by month like
the ledger.  A batch or a rewrite refreshes the months it touched from the
ledger's rows of these months; whole months are replaced, so doing it twice is
harmless.  Cash-flow reports, forecasters and model status read this table
instead of the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources import files
from tally.sources import ledger as LG

SCHEMA = "account_id string, transaction_date date, inflow bigint, outflow bigint, n_rows bigint"


def _path(ledger_path: str) -> str:
    return f"{ledger_path.rstrip('/')}/_daily"


def exists(spark: SparkSession, ledger_path: str) -> bool:
    return files.exists(spark, _path(ledger_path))


def of(ledger: DataFrame) -> DataFrame:
    """The account-day rows of ledger rows (one partial aggregate and a shuffle of days)."""
    sums = [F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0)).alias(d) for d in ("inflow", "outflow")]
    return ledger.groupBy("account_id", "transaction_date").agg(*sums, F.count(F.lit(1)).alias("n_rows"))


def refresh(spark: SparkSession, ledger_path: str, months: list[str]) -> None:
    """Bring the days of ``months`` up to the ledger; other months stay as they are."""
    held = [n.split("=", 1)[1] for n in files.children(spark, ledger_path) if n.startswith("txn_month=")]
    there = [m for m in months if m in held]
    if there:
        rows = LG.read_ledger(spark, ledger_path, with_month=True).where(F.col("txn_month").isin(there))
        days = of(rows).withColumn("txn_month", F.date_format("transaction_date", "yyyy-MM"))
        (days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("txn_month")
         .parquet(_path(ledger_path), compression="zstd"))
    for month in set(months) - set(there):
        files.remove(spark, f"{_path(ledger_path)}/txn_month={month}")


def ensure(spark: SparkSession, ledger_path: str) -> None:
    """Make the table if there is none yet: the one reading of the whole ledger."""
    if not files.written(spark, _path(ledger_path)):
        refresh(spark, ledger_path, [n.split("=", 1)[1] for n in files.children(spark, ledger_path) if n.startswith("txn_month=")])


def read(spark: SparkSession, ledger_path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, txn_month string").parquet(_path(ledger_path)).drop("txn_month")


def as_ledger(days: DataFrame) -> DataFrame:
    """The days as ledger-shaped rows, at most one a direction, for every
    operator that only sums by account and day or a longer period (D1, D7-D10, J1-J4)."""
    sides = F.array(*[F.struct(F.lit(d).alias("direction"), F.col(d).alias("amount")) for d in ("inflow", "outflow")])
    return days.select("account_id", "transaction_date", F.inline(F.when(
        (F.col("inflow") == 0) & (F.col("outflow") == 0), F.slice(sides, 1, 1)).otherwise(F.filter(sides, lambda s: s["amount"] != 0))))


def history_counts(days: DataFrame) -> DataFrame:
    """C6 from the table: ledger rows and distinct days of each account."""
    return days.groupBy("account_id").agg(F.sum("n_rows").alias("days_history"), F.count(F.lit(1)).alias("distinct_days"))
