"""Versions of the account forecasters: ``<path>/version=.../kind=...``.

An append-only table.  A training at a time writes the models it fitted under
that version, a removal (J11) writes the accounts it removes; nothing is
rewritten.  Writing a version again replaces that version only, so a job that
died is run again.  Reading as of a time takes, per account, the last thing
that was said about it up to then, and so gives the models that a past
forecast was made from.  A removal counts after a training of the same second,
so a training that follows it needs a later one.
An account without enough history keeps its earlier model; its status row is
stored, too.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators import forecast as FC
from tally.operators.joins import model_status
from tally.sources import files

SCHEMA = ("account_id string, user_id bigint, lookback_years int, n_days bigint, first_ds date, last_ds date, "
          "currency string, intercept double, slope double, weekday_offsets map<int,double>, sigma double, "
          "status string, error string, trained_at timestamp_ntz")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def version_of(at) -> int:
    """The version number of a time: yyyyMMddHHmmss (a date: its first second)."""
    if isinstance(at, str):
        at = datetime.fromisoformat(at)
    if isinstance(at, date) and not isinstance(at, datetime):
        at = datetime(at.year, at.month, at.day)
    if at.tzinfo is not None:
        raise ValueError("a version's time has no zone")
    return int(at.strftime("%Y%m%d%H%M%S"))


def _write(rows: DataFrame, path: str, at, kind: Column, mode: str = "overwrite") -> None:
    types = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
    wide = rows.withColumn("_kind", kind)
    wide = wide.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()],
                       F.lit(version_of(at)).alias("version"), F.col("_kind").alias("kind"))
    (wide.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("version", "kind").parquet(path))


def record(models: DataFrame, path: str, at) -> None:
    """Write the rows of J8 as the trained models (and status rows) of ``at``."""
    _write(models, path, at, F.when(F.col("status") == "trained", "trained").otherwise("failed"))


def forget(keys: DataFrame, path: str, at) -> None:
    """From ``at`` on these accounts have no model (null ids name none)."""
    _write(keys.where(F.col("account_id").isNotNull()).select("account_id").distinct(), path, at, F.lit("removed"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """All that was recorded: the columns of J8, ``version`` and ``kind``."""
    schema = f"{SCHEMA}, version bigint, kind string"
    return spark.read.schema(schema).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], schema)


def as_of(spark: SparkSession, path: str, at=None) -> DataFrame:
    """The models in force at ``at`` (now, if None): one row per account.

    Files of later versions are not read (a partition filter).  The last
    version per account is a hash aggregate over two columns; only then are
    the models themselves joined.
    """
    said = history(spark, path).where(F.col("kind").isin("trained", "removed"))
    if at is not None:
        said = said.where(F.col("version") <= version_of(at))
    place = F.col("version") * 2 + (F.col("kind") == "removed").cast("bigint")
    last = said.groupBy("account_id").agg(F.max(place).alias("_place"))
    return (said.where(F.col("kind") == "trained").withColumn("_place", place)
            .join(last, ["account_id", "_place"], "left_semi").select(*COLUMNS))


def lazy_fit(spark: SparkSession, requested: DataFrame, path: str, ledger: DataFrame, accounts: DataFrame, at) -> DataFrame:
    """J10 on the store: the requested accounts' models in force at ``at``; the
    others are fitted from the ledger up to ``at`` and added to that version.
    A job run again finds them there; one job at a time fits lazily."""
    ts = F.lit(str(at)).cast("timestamp_ntz")
    wanted = requested.select("account_id").distinct()
    missing = wanted.join(as_of(spark, path, at).select("account_id"), "account_id", "left_anti")
    got = FC.retrain_all(ledger.join(missing, "account_id", "left_semi").where(F.col("transaction_date") <= F.to_date(ts)),
                         accounts.join(missing, "account_id", "left_semi"), F.to_date(ts), ts)
    _write(got, path, at, F.when(F.col("status") == "trained", "trained").otherwise("failed"), "append")
    return as_of(spark, path, at).join(wanted, "account_id", "left_semi")


def status(spark: SparkSession, path: str, accounts: DataFrame, ledger: DataFrame, at) -> DataFrame:
    """C6 as of ``at``: models and ledger rows up to that time."""
    day = F.to_date(F.lit(str(at)).cast("timestamp_ntz"))
    return model_status(accounts, as_of(spark, path, at), ledger.where(F.col("transaction_date") <= day))
