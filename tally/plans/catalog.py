"""Registered queries: name -> (Spark job, DuckDB oracle SQL or None).

Each Spark job takes ``(spark, sf_dir)``, reads the given tables through
``tally.sources.testviews`` and returns a DataFrame without collecting.
The oracle SQL computes the same result with DuckDB over the same parquet
files (views ``lineitem``, ``supplier``, ... are registered by the caller).
Column names and types agree on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources import testviews as tv


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    op: str  # SURVEY operator id(s)


REGISTRY: dict[str, Entry] = {}


def register(name: str, op: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Entry(fn, sql, op)
        return fn
    return deco


def _led(spark, d):
    return tv.transactions(spark, d)


def _acc(spark, d):
    return tv.accounts(spark, d)


def as_of_of(ledger: DataFrame):
    """as_of ("today") = the last transaction date, as a date literal.

    One tiny aggregate job (a single column, partial max per task) returns
    one scalar.  A literal run date, unlike a scalar subquery repeated in
    every cutoff, is planned once and is pushed into the parquet scans as a
    data filter.
    """
    return F.lit(ledger.agg(F.max("transaction_date")).first()[0]).cast("date")


AS_OF_SQL = "(SELECT max(transaction_date) FROM ledger)"
ORDER_AS_OF_SQL = "(SELECT max(transaction_date) FROM order_ledger)"

# Import the query modules so they register themselves.
from tally.plans import q_reports, q_ledger, q_forecast, q_ingest  # noqa: E402,F401
