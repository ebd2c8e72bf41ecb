"""Scheduled jobs (the timed tasks): each reads tables, writes a new
snapshot directory and returns a small report frame.  An outside scheduler
starts them; Spark's task retry replaces the in-process retry loop, and
per-account failures become status rows instead of stopping the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators import analytics as A
from tally.operators import forecast as FC
from tally.operators import maintain as K
from tally.sources import ledger as LG
from tally.sources import models as MODELS


def _as_of(ledger: DataFrame, as_of):
    if as_of is not None:
        return F.lit(as_of).cast("date")
    return F.lit(ledger.agg(F.max("transaction_date")).first()[0]).cast("date")


def retrain_forecasters(spark: SparkSession, ledger: DataFrame, accounts: DataFrame, models_path: str,
                        as_of=None) -> DataFrame:
    """J8 (weekly): fit every account and write the models table; returns
    the status count per outcome."""
    d = _as_of(ledger, as_of)
    FC.retrain_all(ledger, accounts, d).write.parquet(models_path)
    return spark.read.parquet(models_path).groupBy("status").agg(F.count(F.lit(1)).alias("accounts"))


def retrain_versions(spark: SparkSession, ledger: DataFrame, accounts: DataFrame, store: str, at) -> DataFrame:
    """J8 (weekly) into a model store: the models fitted from the ledger up to
    ``at`` become its version; earlier ones stay readable as of their time."""
    ts = F.lit(str(at)).cast("timestamp_ntz")
    day = F.to_date(ts)
    MODELS.record(FC.retrain_all(ledger.where(F.col("transaction_date") <= day), accounts, day, ts), store, at)
    done = MODELS.history(spark, store).where(F.col("version") == MODELS.version_of(at)).where(F.col("status").isNotNull())
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("accounts"))


def run_forecasts(spark: SparkSession, models_path: str, out_path: str, horizon: int = 7, at=None) -> DataFrame:
    """J9 (daily): forecast rows for every trained account, written out
    (partitioned by forecast date); returns rows per account.  With ``at``,
    ``models_path`` is a model store, read as of that time."""
    models = MODELS.as_of(spark, models_path, at) if at is not None else spark.read.parquet(models_path)
    models = models.where(F.col("status") == "trained")
    pts = FC.forecast_points(models, horizon).join(models.select("account_id", "user_id"), "account_id")
    pts.write.partitionBy("date").parquet(out_path)
    return spark.read.schema(pts.schema).parquet(out_path).groupBy("account_id").agg(F.count(F.lit(1)).alias("points"))


def cleanup(spark: SparkSession, ledger_path: str, out_path: str, days: int, as_of=None,
            dry_run: bool = False) -> DataFrame:
    """K8 + D14: write the retained ledger to a new snapshot (unless a dry
    run) and report the rows removed and the space they freed."""
    ledger = LG.read_ledger(spark, ledger_path)
    d = _as_of(ledger, as_of)
    report = A.retention_count(ledger, d, days)
    if not dry_run:
        LG.write_snapshot(K.retention_purge(ledger, d, days), out_path)
    return report.withColumn("dry_run", F.lit(dry_run))
