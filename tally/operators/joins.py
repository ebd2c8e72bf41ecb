"""Key lookups and ownership checks as joins.

Accounts and models are small dimension tables: Spark's size-checked
broadcast (autoBroadcastJoinThreshold + AQE) picks broadcast-hash joins
for them without a hint; if a dimension outgrows the threshold the same
plan falls back to a shuffle join instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.errors import PermissionDenied, ValidationError


def owner_lookup(keys: DataFrame, accounts: DataFrame) -> DataFrame:
    """Owner user_id per account_id (null = unknown account)."""
    return (keys.select("account_id").distinct()
            .join(accounts.select("account_id", "user_id"), "account_id", "left"))


def owned_accounts(accounts: DataFrame, user_id) -> DataFrame:
    return accounts.where(F.col("user_id") == F.lit(user_id)).select("account_id")


def owned_scope(df: DataFrame, accounts: DataFrame, user_id) -> DataFrame:
    """Keep rows of accounts owned by ``user_id``."""
    return df.join(owned_accounts(accounts, user_id), "account_id", "left_semi")


def unauthorized_accounts(batch: DataFrame, accounts: DataFrame, user_id) -> DataFrame:
    """Distinct incoming account_ids the user does not own."""
    return (batch.select("account_id").distinct()
            .join(owned_accounts(accounts, user_id), "account_id", "left_anti"))


def assert_authorized(batch: DataFrame, accounts: DataFrame, user_id) -> None:
    """C3 as a gate: raise with the sorted offending ids (bounded sample in
    the message; the full list stays a DataFrame)."""
    if owned_accounts(accounts, user_id).isEmpty():
        raise ValidationError(f"User {user_id} has no accounts")
    bad = unauthorized_accounts(batch, accounts, user_id)
    sample = [r.account_id for r in bad.orderBy("account_id").limit(20).collect()]
    if sample:
        raise PermissionDenied(f"Unauthorized account_ids: {sample}")


def _number(batch: DataFrame, c: str) -> Column:
    """A column as a number of the same order, nulls lowest; columns that have
    no such number stay as they are (their minimum is not a hash aggregate)."""
    kind = batch.schema[c].dataType
    if isinstance(kind, T.TimestampNTZType):
        x = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
    elif isinstance(kind, T.TimestampType):
        x = F.unix_micros(c)
    elif isinstance(kind, T.DateType):
        x = F.unix_date(c).cast("bigint")
    elif isinstance(kind, T.DecimalType):
        return F.coalesce(F.col(c).cast("decimal(38,0)") if kind.scale == 0 else F.col(c), F.lit(-10 ** 37).cast("decimal(38,0)"))
    elif isinstance(kind, T.IntegralType):
        x = F.col(c).cast("bigint")
    else:
        return F.col(c)
    return F.coalesce(x, F.lit(-(1 << 63)))


def earliest(batch: DataFrame, keys=("transaction_id",), order=("_row",)) -> DataFrame:
    """One narrow row per key: the least first order value, as a number
    (``_lead``), and how many rows have it (``_n``).

    Two hash aggregates over the keys and a number, so a key with very many
    copies is combined before each shuffle and nothing is sorted.
    """
    narrow = batch.select(*keys, _number(batch, order[0]).alias("_lead"))
    return (narrow.groupBy(*keys, "_lead").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*keys).agg(F.min("_lead").alias("_lead"), F.min_by("_n", "_lead").alias("_n")))


def take_earliest(batch: DataFrame, least: DataFrame, keys=("transaction_id",), order=("_row",)) -> DataFrame:
    """The rows of ``batch`` that ``least`` (see ``earliest``) names, one a key.

    Rows are dealt by key and order value, so copies of a hot key part, and
    are found by semi-joins.  Only where several rows share the least value
    do the other columns decide, in a window that each input partition limits
    to one row before its shuffle.
    """
    rows = batch.withColumn("_lead", _number(batch, order[0]))

    def named(n: Column) -> DataFrame:
        b, w = rows.alias("b"), least.where(n).alias("w")
        return b.join(w, F.expr(" AND ".join([f"b.`{k}` <=> w.`{k}`" for k in keys] + ["b._lead = w._lead"])), "left_semi")

    ties = [c for c, t in batch.dtypes if c not in keys and c not in order and "map<" not in t]
    w = Window.partitionBy(*keys).orderBy(*order, *ties)
    tied = named(F.col("_n") > 1).withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")
    return named(F.col("_n") == 1).unionByName(tied).drop("_lead")


def first_in_batch(batch: DataFrame, keys=("transaction_id",), order=("_row",)) -> DataFrame:
    """Rows earlier in the batch win over later copies of the same key.

    The order's columns decide, then the other columns, so a retried task
    picks the same copy.  The first order column should be a number, a date or
    a time: its least value per key is a hash aggregate over narrow rows, and
    whole rows are shuffled once, unsorted before.
    """
    return take_earliest(batch, earliest(batch, keys, order), keys, order)


def new_rows_only(batch: DataFrame, ledger: DataFrame, keys=("transaction_id",),
                  order=("_row",)) -> DataFrame:
    """C4: first copy within the batch, then drop keys already in the ledger.
    The ledger's keys meet the narrow rows of ``earliest``; whole rows are
    shuffled once."""
    least = earliest(batch, keys, order).join(ledger.select(*keys), list(keys), "left_anti")
    return take_earliest(batch, least, keys, order)


def balance_lookup(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Starting balance and currency per row's account; missing -> 0 / null."""
    return (df.join(accounts.select("account_id", "starting_balance",
                                    F.col("currency").alias("account_currency")),
                    "account_id", "left")
            .withColumn("starting_balance", F.coalesce("starting_balance", F.lit(0).cast("bigint"))))


def history_counts(ledger: DataFrame) -> DataFrame:
    """Rows and distinct days of each account."""
    return (ledger.groupBy("account_id")
            .agg(F.count(F.lit(1)).alias("days_history"),
                 F.countDistinct("transaction_date").alias("distinct_days")))


def model_status(accounts: DataFrame, models: DataFrame, ledger: DataFrame | None = None,
                 counts: DataFrame | None = None) -> DataFrame:
    """Per account, whether a forecaster exists, when it was trained,
    how many ledger rows it has (days_history counts rows) and distinct days;
    these two from ``counts`` where given (as of the account-day table)."""
    counts = history_counts(ledger) if counts is None else counts
    m = models.select("account_id", "trained_at", F.lit(True).alias("_has"))
    return (accounts.select("account_id", "user_id")
            .join(m, "account_id", "left")
            .join(counts, "account_id", "left")
            .select("account_id", "user_id",
                    F.when(F.col("_has"), "trained").otherwise("missing").alias("status"),
                    "trained_at",
                    F.coalesce("days_history", F.lit(0).cast("bigint")).alias("days_history"),
                    F.coalesce("distinct_days", F.lit(0).cast("bigint")).alias("distinct_days"),
                    F.when(F.col("_has").isNull(), F.lit("Model not trained yet")).alias("last_error")))
