"""Account exports.

Exports are written per account (``partitionBy('account_id')``) rather
than assembled into one in-memory document, so an account of any size
streams out of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.operators.filters import date_range
from tally.schema import LISTING_COLUMNS
from tally.sources.ledger import staged


#: The folder to which Spark writes rows without a value of the partition column.
_NO_ACCOUNT = "__HIVE_DEFAULT_PARTITION__"


def _folder() -> Column:
    """The folder name of an account, never null: Spark then has no empty names
    to replace at the writer, which would sort all lines a second time."""
    return F.coalesce(F.when(F.col("account_id") != "", F.col("account_id")), F.lit(_NO_ACCOUNT))


def _write_lines(lines: DataFrame, path: str, compression: str | None) -> None:
    """``value`` as text, in a folder an account; ``lines`` come in the order of ``_folder``."""
    (lines.select(F.col("_folder").alias("account_id"), "value")
     .write.option("zlib.compress.level", "BEST_SPEED")  # of gzip: 244 MB in place of 202 at the default level, for a quarter less processor time
     .partitionBy("account_id").text(path, compression=compression))


def _export_rows(ledger: DataFrame, account_ids=None, start=None, end=None) -> DataFrame:
    """The rows of ``export_frame`` in no order, for writers that order them by account."""
    f = date_range(ledger, start, end)
    if account_ids is not None:
        f = f.where(F.col("account_id").isin(*account_ids))
    return f.select(*LISTING_COLUMNS)


def export_frame(ledger: DataFrame, account_ids=None, start=None, end=None) -> DataFrame:
    """A6 frame: the 8 listing columns, optional accounts and date range,
    newest first."""
    return _export_rows(ledger, account_ids, start, end).orderBy(F.col("transaction_date").desc(), "transaction_id")


def export_csv(ledger: DataFrame, path: str, **kw) -> None:
    """CSV with a header, one directory per account; files of an
    account hold rows newest first."""
    f = _export_rows(ledger, **kw)
    # Range partitioning splits a large account over several tasks; part
    # files of an account cover consecutive date ranges, newest first.
    (f.repartitionByRange("account_id", F.col("transaction_date").desc(), "transaction_id")
     .sortWithinPartitions("account_id", F.col("transaction_date").desc(), "transaction_id")
     .write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).partitionBy("account_id").csv(path))


def export_json_header(ledger: DataFrame, export_date, **kw) -> DataFrame:
    """A7 envelope without the rows: account_id, export_date,
    transaction_count (a partial-aggregated count)."""
    f = _export_rows(ledger, **kw)
    return f.groupBy("account_id").agg(F.count(F.lit(1)).alias("transaction_count")).select(
        "account_id", F.lit(export_date).cast("date").alias("export_date"), "transaction_count")


def _lines(ledger: DataFrame, export_date, **kw) -> DataFrame:
    """``json_lines`` with the account's ``_folder``.  The typed rows are
    shuffled, which are shorter than their JSON; a header has a
    ``transaction_count`` and no other cell."""
    head = export_json_header(ledger, export_date, **kw)
    both = _export_rows(ledger, **kw).unionByName(head, allowMissingColumns=True).withColumn("_folder", _folder())
    is_head = F.col("transaction_count").isNotNull()
    order = ["_folder", "account_id", is_head.desc(), F.col("transaction_date").desc(), "transaction_id"]
    return both.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "_folder", "account_id", F.when(is_head, F.to_json(F.struct("account_id", "export_date", "transaction_count")))
        .otherwise(F.to_json(F.struct(*LISTING_COLUMNS))).alias("value"))


def json_lines(ledger: DataFrame, export_date, **kw) -> DataFrame:
    """A7 as lines: ``account_id, value``, per account a header line, then its
    transactions newest first.  One shuffle brings the rows into this order."""
    return _lines(ledger, export_date, **kw).drop("_folder")


def export_json(ledger: DataFrame, path: str, export_date, compression: str | None = None, **kw) -> None:
    """Per account a header line then its transactions, as JSON lines.
    ``compression`` of the files (``gzip``): plain text unless given."""
    _write_lines(_lines(ledger, export_date, **kw), path, compression)


def json_documents(ledger: DataFrame, export_date, part_rows: int = 10_000, accounts: DataFrame | None = None, **kw) -> DataFrame:
    """A7 as documents: ``account_id, part, document``, where a document holds
    account_id, export_date, transaction_count (of the whole account), its part
    number, how many parts there are, and an array ``transactions`` of at most
    ``part_rows`` rows.  Parts in order hold an account's rows newest first.

    Rows are dealt to tasks by ranges of (account, date, id), so a hot account
    spans several, and staged with their places; a run of a task's rows of one
    account is a part.  The rows of an account and task are brought together by
    one shuffle, in which the documents stay.  With ``accounts``, those without
    a transaction have a document with an empty array.  Empty text fields stay,
    null ones are left out.
    """
    order = ["account_id", F.col("transaction_date").desc(), "transaction_id"]
    placed = staged(_export_rows(ledger, **kw).repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_at": F.monotonically_increasing_id()}), "export", "zstd")
    placed = placed.withColumns({"_task": F.shiftright("_at", 33),  # the low 33 bits count a task's rows
                                 "_run": F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / part_rows)})
    spans = placed.groupBy("account_id", "_task").agg(
        F.min("_run").alias("_first"), (F.max("_run") - F.min("_run") + 1).alias("_parts"), F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy("account_id")  # one narrow row an account and task
    before = every.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    numbered = spans.select("account_id", "_task", (F.coalesce(F.sum("_parts").over(before), F.lit(0)) - F.col("_first") + 1).alias("_from"),
                            F.sum("_parts").over(every).alias("parts"), F.sum("_n").over(every).alias("transaction_count"))
    runs = placed.repartition("account_id", "_task").groupBy("account_id", "_task", "_run").agg(
        F.array_sort(F.collect_list(F.struct("_at", F.struct(*LISTING_COLUMNS).alias("row")))).alias("rows"))
    whole = runs.join(numbered, ["account_id", "_task"]).select(
        "account_id", (F.col("_from") + F.col("_run")).cast("int").alias("part"), "parts", "transaction_count",
        F.col("rows.row").alias("transactions"))
    if accounts is not None:
        kind = whole.schema["transactions"].dataType.simpleString()
        whole = whole.unionByName(accounts.select("account_id").distinct().join(spans, "account_id", "left_anti").select(
            "account_id", F.lit(1).alias("part"), F.lit(1).cast("bigint").alias("parts"), F.lit(0).cast("bigint").alias("transaction_count"),
            F.array().cast(kind).alias("transactions")))
    return whole.select("account_id", "part", F.to_json(F.struct(
        "account_id", F.lit(export_date).cast("date").alias("export_date"), "transaction_count", "part", "parts",
        "transactions")).alias("document"))


def export_json_documents(ledger: DataFrame, path: str, export_date, compression: str | None = None, **kw) -> None:
    """The documents as text, a line each, in a folder per account.
    ``compression`` of the files (``gzip``): plain text unless given."""
    docs = json_documents(ledger, export_date, **kw)  # an account's documents of one task are in one task: no shuffle of them
    docs = docs.withColumn("_folder", _folder()).sortWithinPartitions("_folder", "account_id", "part")
    _write_lines(docs.select("_folder", F.col("document").alias("value")), path, compression)
