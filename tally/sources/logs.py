"""A3: the JSON-lines application log as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.schema import LOG_SCHEMA


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Blank and malformed lines are dropped (DROPMALFORMED with a fixed
    schema, so no inference pass).  ``ts`` is the record's local wall time:
    the whole of ``time.repr`` without its zone offset, at any precision.  A
    record without a message shows its formatted text, one without a level is
    INFO."""
    raw = (spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)
           .where(F.col("record").isNotNull()))
    r = "record"
    return raw.select(
        F.regexp_replace(F.col(f"{r}.time.repr"), r"\s*(Z|[+-][0-9]{2}:?[0-9]{2}(:?[0-9]{2})?)$", "")
         .try_cast("timestamp_ntz").alias("ts"),
        F.upper(F.coalesce(F.col(f"{r}.level.name"), F.lit("INFO"))).alias("level"),
        F.coalesce(F.col(f"{r}.message"), F.col("text")).alias("message"),
        F.col(f"{r}.extra.extra.account_id").alias("account_id"),
        F.col(f"{r}.extra.extra.user_id").alias("user_id"),
    )


def to_log_lines(flat: DataFrame) -> DataFrame:
    """Inverse of read_log for (ts, level, message, account_id, user_id):
    one JSON line per record in the nested log format."""
    rec = F.struct(
        F.struct(F.col("level").alias("name")).alias("level"),
        F.struct(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))
                 .alias("repr")).alias("time"),
        F.col("message").alias("message"),
        F.struct(F.struct(F.col("account_id").alias("account_id"),
                          F.col("user_id").alias("user_id")).alias("extra")).alias("extra"),
    )
    return flat.select(F.to_json(F.struct(rec.alias("record"), F.col("message").alias("text")))
                       .alias("value"))
