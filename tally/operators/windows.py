"""Window operators.

Windows partition by account over *daily aggregates* (one row per account
and day), never over raw ledger rows, so a window partition is bounded by
the number of calendar days however skewed the accounts are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.operators.joins import first_in_batch


def running_balance(daily: DataFrame, starting: DataFrame, value: str = "net") -> DataFrame:
    """Starting balance + cumulative daily net, per account in date order."""
    w = (Window.partitionBy("account_id").orderBy("ds")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (daily.join(starting.select("account_id", "starting_balance"), "account_id", "left")
            .withColumn("balance",
                        (F.coalesce("starting_balance", F.lit(0).cast("bigint"))
                         + F.sum(value).over(w)).cast("bigint"))
            .drop("starting_balance"))


def series_index(daily: DataFrame) -> DataFrame:
    """0-based row number per account in date order."""
    w = Window.partitionBy("account_id").orderBy("ds")
    return daily.withColumn("i", (F.row_number().over(w) - 1).cast("bigint"))


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """First row per key by ``order`` (its first column a number, date or time)."""
    return first_in_batch(df, tuple(keys), tuple(order))
