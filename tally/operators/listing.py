"""Sorted listings: pages per account, log tail, account lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.operators.filters import attr_filter, date_range
from tally.schema import LISTING_COLUMNS, LOG_LIMIT_MAX, PAGE_LIMIT_MAX


def list_page(ledger: DataFrame, offset: int = 0, limit: int = 50, category=None, direction=None,
              start=None, end=None) -> DataFrame:
    """per account, rows offset+1 .. offset+limit in (date desc, id)
    order after the filters, with the account's filtered ``total``.  An
    account whose page is empty has one row with its total and no transaction.

    The row_number filter lets Spark insert a partial WindowGroupLimit
    before the shuffle, so each input partition forwards at most
    offset+limit rows per account: a hot account does not move all its
    rows to one task.  ``total`` is a partial-aggregated count.
    """
    if not 1 <= limit <= PAGE_LIMIT_MAX or offset < 0:
        raise ValueError(f"limit must be 1..{PAGE_LIMIT_MAX} and offset >= 0")
    f = attr_filter(date_range(ledger, start, end), category, direction)
    w = Window.partitionBy("account_id").orderBy(F.col("transaction_date").desc(),
                                                 F.col("transaction_id").asc())
    page = (f.select(*LISTING_COLUMNS, F.row_number().over(w).cast("bigint").alias("position"))
            .where(F.col("position") <= offset + limit)
            .where(F.col("position") > offset))
    totals = f.groupBy("account_id").agg(F.count(F.lit(1)).alias("total"))
    return totals.join(page, "account_id", "left").select(*LISTING_COLUMNS, "position", "total")


def log_matches(log: DataFrame, level=None, start=None, end=None, account_id=None, user_id=None) -> DataFrame:
    """log records that pass the filters.  Dates compare on the record's
    own local date; a record without a time passes them."""
    day = F.to_date("ts")
    if level is not None:
        log = log.where(F.col("level") == F.upper(F.lit(level)))
    if start is not None:
        log = log.where(day.isNull() | (day >= F.lit(start).cast("date")))
    if end is not None:
        log = log.where(day.isNull() | (day <= F.lit(end).cast("date")))
    if account_id is not None:
        log = log.where(F.col("account_id") == F.lit(str(account_id)))
    if user_id is not None:
        log = log.where(F.col("user_id") == F.lit(str(user_id)))
    return log


def log_query(log: DataFrame, level=None, start=None, end=None, account_id=None, user_id=None,
              limit: int = 100) -> DataFrame:
    """matching log records, newest first, the last ``limit`` of them
    (0: none); ``log_total`` counts all matches."""
    if limit < 0 or limit > LOG_LIMIT_MAX:
        raise ValueError(f"limit must be 0..{LOG_LIMIT_MAX}")
    out = log_matches(log, level, start, end, account_id, user_id)
    return out.orderBy(F.col("ts").desc(), F.col("message").desc()).limit(limit)


def log_total(log: DataFrame, **filters) -> DataFrame:
    """the number of matching records, whatever the limit."""
    return log_matches(log, **filters).agg(F.count(F.lit(1)).alias("total"))


def account_list(accounts: DataFrame, user_id=None) -> DataFrame:
    """accounts of a user (or of every user) in account_id text order.

    A global sort (range partitioning on user, account) rather than a
    window per user: range boundaries are sampled, so a user owning a
    large share of the accounts is split over several tasks.
    """
    a = accounts if user_id is None else accounts.where(F.col("user_id") == F.lit(user_id))
    return a.orderBy("user_id", "account_id")
