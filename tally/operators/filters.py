"""Predicates.  All are plain ``where`` clauses so Catalyst pushes them to
the parquet scan (and to partition pruning on a month-partitioned ledger)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.money import signed_amount as _signed


def _as_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def date_range(df: DataFrame, start=None, end=None, col: str = "transaction_date") -> DataFrame:
    """Inclusive on both ends, each optional."""
    if start is not None:
        df = df.where(F.col(col) >= _as_col(start).cast("date"))
    if end is not None:
        df = df.where(F.col(col) <= _as_col(end).cast("date"))
    return df


def attr_filter(df: DataFrame, category: str | None = None, direction: str | None = None) -> DataFrame:
    """Equality on category and/or direction."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if direction is not None:
        df = df.where(F.col("direction") == direction)
    return df


def lookback_cutoff(as_of, years: int) -> Column:
    """as_of minus whole calendar years (Feb 29 -> Feb 28)."""
    return F.add_months(_as_col(as_of).cast("date"), -12 * years)


def lookback_filter(df: DataFrame, years: int | None, as_of, col: str = "transaction_date") -> DataFrame:
    """Keep rows on or after as_of - N years when N is given."""
    if not years:
        return df
    return df.where(F.col(col) >= lookback_cutoff(as_of, years))


def with_signed_amount(df: DataFrame) -> DataFrame:
    """+amount for inflow, -amount for outflow."""
    return df.withColumn("signed_amount", _signed(F.col("amount"), F.col("direction")))


def point_lookup(ledger: DataFrame, keys: DataFrame, on=("account_id", "transaction_id")) -> DataFrame:
    """Ledger rows whose key is in ``keys`` (a frame of keys)."""
    return ledger.join(keys.select(*on), list(on), "left_semi")


def missing_keys(ledger: DataFrame, keys: DataFrame, on=("account_id", "transaction_id")) -> DataFrame:
    """B14 'not found': requested keys absent from the ledger."""
    return keys.select(*on).join(ledger.select(*on), list(on), "left_anti")
