"""The stored ledger: parquet snapshots partitioned by transaction month.

Writers never overwrite the path they read from: each job writes a new
snapshot directory and returns its path.  Month partitioning lets date
ranges and lookbacks prune whole directories at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators.joins import first_in_batch, new_rows_only
from tally.schema import CURRENCY_DECIMALS, LEDGER_COLUMNS, LEDGER_SCHEMA
from tally.session import scratch_path
from tally.sources import ids


def read_ledger(spark: SparkSession, path: str, with_month: bool = False) -> DataFrame:
    """A ledger snapshot; ``with_month`` keeps the txn_month partition column
    (for partition-pruned joins)."""
    df = spark.read.parquet(path)
    cols = [F.col(f.name).cast(f.dataType) for f in LEDGER_SCHEMA.fields]
    return df.select(*cols, *(["txn_month"] if with_month else []))


def write_snapshot(df: DataFrame, path: str, mode: str = "errorifexists", with_ids: bool = True) -> str:
    """Write ledger rows partitioned by month; rows of one month are
    clustered by account so account filters skip row groups.

    Range partitioning on (month, account, id) samples the keys, so a hot
    month or account is split over several tasks instead of one, and each
    task writes into few month directories.  A ledger with an id table gets
    the ids of appended rows there, too (``df`` is read twice then), unless
    ``with_ids`` is off because the caller adds them.
    """
    out = df.withColumn("txn_month", F.date_format("transaction_date", "yyyy-MM"))
    (out.repartitionByRange("txn_month", "account_id", "transaction_id")
     .sortWithinPartitions("txn_month", "account_id", "transaction_date")
     .write.mode(mode).partitionBy("txn_month").parquet(path, compression="zstd"))
    if with_ids and mode == "append" and ids.exists(df.sparkSession, path):
        ids.append(df, path)
    return path


def ledger_append(new_rows: DataFrame, ledger: DataFrame | None, path: str) -> DataFrame:
    """A4: rows whose id is not yet in the ledger, appended to ``path``.

    Row-wise skip of existing ids (the all-or-nothing batch drop of the
    original is replaced by an anti-join).  Of several rows with one id in
    the batch the smallest by posted_at, then by the other values, is stored.
    Returns the appended rows, staged once before they are appended.
    """
    order = ("posted_at",) if "posted_at" in new_rows.columns else tuple(new_rows.columns[-1:])
    fresh = (first_in_batch(new_rows, order=order) if ledger is None
             else new_rows_only(new_rows, ledger, order=order))
    fresh = staged(fresh, "append")
    write_snapshot(fresh.select(*LEDGER_COLUMNS), path, mode="append")
    from tally.sources import daily  # it reads ledgers
    if daily.exists(fresh.sparkSession, path):
        months = fresh.select(F.date_format("transaction_date", "yyyy-MM")).distinct().collect()
        daily.refresh(fresh.sparkSession, path, [m[0] for m in months])
    return fresh


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Written once in the shared scratch folder and read back.  ``compression``:
    of its files, the session's unless given."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def processed_merge(existing: DataFrame | None, new_rows: DataFrame) -> DataFrame:
    """A5: existing backup union new rows, first row per transaction_id with
    the existing copy winning.  On the first write (no backup) rows are
    taken as they are, without de-duplication.  Of several copies on one side
    the smallest by posted_at, then by the other values, is kept."""
    if existing is None:
        return new_rows
    tagged = existing.withColumn("_src", F.lit(0)).unionByName(new_rows.withColumn("_src", F.lit(1)))
    order = ["_src"] + [c for c in ("posted_at",) if c in new_rows.columns]
    return first_in_batch(tagged, order=order).select(*new_rows.columns)


def strict_load(raw: DataFrame) -> DataFrame:
    """A10: seed load with strict casts (ANSI: a bad date or number raises).

    Amount is scaled by the currency's own exponent (JPY 0, others 2).
    """
    factor = F.element_at(F.create_map(*[x for k, v in CURRENCY_DECIMALS.items()
                                         for x in (F.lit(k), F.lit(10 ** v))]), F.col("currency"))
    return raw.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.col("account_id").cast("string").alias("account_id"),
        F.col("description"), F.col("category"),
        F.rint(F.col("amount").cast("double") * factor).cast("bigint").alias("amount"),
        F.col("direction"), F.col("currency"),
        F.col("transaction_date").cast("date").alias("transaction_date"),
        F.col("posted_at").cast("timestamp_ntz").alias("posted_at"),
    )
