"""The transaction ids of a stored ledger, bucketed by hash.

A ledger folder keeps its ids in ``_ids/buckets-<n>`` (Spark passes over names
that start with an underscore): a table clustered by transaction_id, so an
incoming batch is joined bucket to bucket and the stored ids are never
shuffled.  A small batch names its ids in the query; then only the buckets
that can hold them are read.  An id may stand there twice (a repeated append
is harmless to the existence check), and none is missing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources import files

#: Batches of up to this many ids name them in the query.
FEW_IDS = 1000


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/_ids"


def _stored(spark: SparkSession, path: str) -> str | None:
    """The complete id table below ``path``, if there is one."""
    names = [n for n in files.children(spark, _folder(path)) if n.startswith("buckets-")]
    return f"{_folder(path)}/{names[-1]}" if names else None


def exists(spark: SparkSession, path: str) -> bool:
    return _stored(spark, path) is not None


def _table(spark: SparkSession, location: str, buckets: int) -> str:
    """The name under which this session's catalog knows the folder."""
    name = "tally_ids_" + hashlib.sha256(location.encode()).hexdigest()[:32]
    place = location.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (transaction_id STRING) USING parquet "
              f"OPTIONS (compression 'zstd') "  # sorted ids take two thirds of the default codec's size
              f"CLUSTERED BY (transaction_id) SORTED BY (transaction_id) INTO {buckets} BUCKETS LOCATION '{place}'")
    spark.catalog.refreshTable(name)
    return name


def _open(spark: SparkSession, path: str) -> str:
    location = _stored(spark, path)
    return _table(spark, location, int(location.rsplit("-", 1)[1]))


def _insert(rows: DataFrame, name: str, buckets: int) -> None:
    """One task, and so one file, a bucket."""
    rows.select("transaction_id").repartition(buckets, "transaction_id").write.insertInto(name)


def ensure(spark: SparkSession, path: str, ledger: DataFrame | None, buckets: int | None = None) -> None:
    """Make the id table of ``path`` if it has none yet, from the ids of
    ``ledger``.  It is built aside and moved into place, so it is whole or
    absent.  ``buckets``: as many as the session's shuffle partitions unless
    given; with fewer than these, Spark prefers to shuffle both sides."""
    if exists(spark, path):
        return
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    aside = f"{_folder(path)}/building-{uuid.uuid4().hex}"
    if ledger is not None:
        name = _table(spark, aside, buckets)
        _insert(ledger, name, buckets)
        spark.sql(f"DROP TABLE {name}")
    else:
        files.touch(spark, f"{aside}/_SUCCESS")
    files.move(spark, aside, f"{_folder(path)}/buckets-{buckets}")


def append(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    buckets = int(_stored(spark, path).rsplit("-", 1)[1])
    _insert(rows, _open(spark, path), buckets)


def held(rows: DataFrame, path: str) -> DataFrame:
    """The ids of ``rows`` that the id table of ``path`` holds; nothing but ids is shuffled."""
    return rows.select("transaction_id").join(rows.sparkSession.table(_open(rows.sparkSession, path)), "transaction_id", "left_semi")


def unseen(rows: DataFrame, path: str, few: bool = False) -> DataFrame:
    """The rows whose transaction_id the id table of ``path`` does not hold.

    Only ``rows`` are shuffled, into the table's buckets.  ``few`` (at most
    ``FEW_IDS`` rows): their ids become a filter on the table, which leaves
    only the buckets and row groups that can hold them.  Null ids are unseen.
    """
    spark = rows.sparkSession
    held = spark.table(_open(spark, path))
    if few:
        own = [r[0] for r in rows.select("transaction_id").where("transaction_id is not null").collect()]
        held = held.where(F.col("transaction_id").isin(own))
    return rows.join(held, "transaction_id", "left_anti")
