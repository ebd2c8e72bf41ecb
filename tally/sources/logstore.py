"""The parsed application log as a stored table: ``<path>/log_day=.../batch=...``.

Each batch of log files is parsed once (A3) and written by day.  A batch owns
its folders: writing it again replaces them, so a job that died is run again
and nothing stands twice.  Queries prune by day; the newest records are looked
for in the newest days first.  A record without a time lies under the day
``none``.  Batches of different names may be added at once; the name of a
batch is its identity, whatever it holds.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators.listing import log_matches, log_query, log_total
from tally.sources import files
from tally.sources.logs import read_log

SCHEMA = "ts timestamp_ntz, level string, message string, account_id string, user_id string"
COLUMNS = ["ts", "level", "message", "account_id", "user_id"]
NO_DAY = "none"


def add(log: DataFrame, path: str, batch: str) -> None:
    """Write the parsed records of ``batch``; range partitions by day and time
    split a busy day over several tasks and keep a quiet one in one file."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError("a batch name has letters, digits, _ and - only")
    days = log.select(*COLUMNS).withColumns({
        "log_day": F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(NO_DAY)), "batch": F.lit(batch)})
    (days.repartitionByRange("log_day", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("log_day", "batch").parquet(path))


def add_files(spark: SparkSession, source: str, path: str, batch: str) -> None:
    """A3 into the store: the JSON-lines files at ``source`` as one batch."""
    add(read_log(spark, source), path, batch)


def days(spark: SparkSession, path: str) -> list[str]:
    """The stored days, newest first (folder names: at most one a calendar day)."""
    names = [n.split("=", 1)[1] for n in files.children(spark, path) if n.startswith("log_day=")]
    return sorted((n for n in names if n != NO_DAY), reverse=True) + [n for n in names if n == NO_DAY]


def _day(text) -> str:
    return text.isoformat()[:10] if isinstance(text, date) else date.fromisoformat(str(text)[:10]).isoformat()


def read(spark: SparkSession, path: str, start=None, end=None, untimed: bool = True) -> DataFrame:
    """Records of the days from ``start`` to ``end`` and, if ``untimed``, those without a time."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    log, day = spark.read.schema(f"{SCHEMA}, log_day string, batch string").parquet(path), F.col("log_day")
    none = day == NO_DAY
    for bound, cond in ((start, lambda d: day >= d), (end, lambda d: day <= d)):
        if bound is not None:
            log = log.where(cond(_day(bound)) | none)
    return (log if untimed else log.where(~none)).select(*COLUMNS)


def total(spark: SparkSession, path: str, start=None, end=None, **filters) -> DataFrame:
    """F2's total from the days in range."""
    return log_total(read(spark, path, start, end), start=start, end=end, **filters)


def query(spark: SparkSession, path: str, start=None, end=None, limit: int = 100, **filters) -> DataFrame:
    """F2 from the store: the newest ``limit`` matches.

    The newest day in range is counted first, then twice as many days, and so
    on until they hold ``limit`` matches: a look at the last records does not
    read the log's years, and there are at most log2(days) counts.  Records
    without a time are older than all others.
    """
    log_query(spark.createDataFrame([], SCHEMA), limit=limit)  # the limit's bounds
    low, high = (None if x is None else _day(x) for x in (start, end))
    held = days(spark, path)
    dated = [d for d in held if d != NO_DAY and (low is None or d >= low) and (high is None or d <= high)]
    width = 1
    while width < len(dated):
        part = read(spark, path, dated[width - 1], dated[0], untimed=False)
        if log_matches(part, **filters).limit(limit).count() >= limit:
            return log_query(part, limit=limit, **filters)
        width *= 2
    return log_query(read(spark, path, start, end), start=start, end=end, limit=limit, **filters)
