"""Ingestion checks: schema, type normalisation, value checks, money units.

The batch-level semantics (first violation rejects the batch) are kept as
``strict=True``; the default annotates each row with violation codes so a
job can split valid rows from a quarantine in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.errors import ValidationError
from tally.functions.constraints import violations
from tally.functions.money import currency_factor, to_smallest_unit
from tally.functions.text import strip_ws
from tally.schema import ALLOWED_DIRECTIONS, BROKEN, DEFAULT_CURRENCY, REQUIRED_COLUMNS

# Order in which value checks report (first hit is the batch error).
VALUE_CHECKS = ["direction_invalid", "amount_invalid", "transaction_date_invalid"]


def schema_check(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> None:
    """B1: raise if required columns are missing.  Driver-side; runs no job."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValidationError(f"Missing required columns: {missing}")


def parse_timestamp(c: Column) -> Column:
    """Lenient ISO date or date-time parse; malformed -> null."""
    return strip_ws(c).try_cast("timestamp_ntz")


def parse_double(c: Column) -> Column:
    """Lenient number parse; malformed, NaN and infinite -> null."""
    x = strip_ws(c).try_cast("double")
    # NaN compares above infinity in Spark, so one test rejects NaN and +-inf.
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def normalize_types(df: DataFrame) -> DataFrame:
    """B2: typed dates and amount (bad -> null), currency default when the
    column is absent, direction lower-cased and stripped."""
    out = df.withColumns({
        "transaction_date": parse_timestamp(F.col("transaction_date")).cast("date"),
        "posted_at": parse_timestamp(F.col("posted_at")),
        "amount": parse_double(F.col("amount").cast("string")),
        "direction": F.lower(strip_ws(F.col("direction"))),
    })
    if "currency" not in df.columns:
        out = out.withColumn("currency", F.lit(DEFAULT_CURRENCY))
    return out


def value_violations() -> Column:
    """B3 + B4 checks of a normalised frame as a string of codes."""
    return violations([
        (F.col("direction").isNull() | ~F.col("direction").isin(*ALLOWED_DIRECTIONS),
         "direction_invalid"),
        (F.col("amount").isNull(), "amount_invalid"),
        (F.col("transaction_date").isNull(), "transaction_date_invalid"),
        (F.col("amount").isNotNull() & currency_factor(F.col("currency")).isNull(), "currency_unsupported"),
        (F.col("amount").isNotNull() & currency_factor(F.col("currency")).isNotNull()
         & to_smallest_unit(F.col("amount"), F.col("currency")).isNull(), "amount_out_of_range"),
    ])


def derive_smallest_unit(df: DataFrame) -> DataFrame:
    """Amount in major units -> bigint smallest units by currency."""
    return df.withColumn("amount", to_smallest_unit(F.col("amount"), F.col("currency")))


def annotate(df: DataFrame) -> DataFrame:
    """B1 -> B2 -> B3 -> B4 in one projection; adds ``violations``."""
    schema_check(df)
    n = normalize_types(df).withColumn("transaction_id", strip_ws(F.col("transaction_id")))
    codes = value_violations()
    if BROKEN in df.columns:  # such a record's cells may be those of other columns
        codes = F.concat_ws(",", F.when(F.col(BROKEN).isNotNull(), "record_broken"), F.when(codes != "", codes))
    n = n.withColumn("violations", codes)
    return derive_smallest_unit(n)


def is_valid() -> Column:
    """The B3/B4 checks as one boolean: each parsed value is referenced once
    (filters are pushed below projections, so a lean predicate matters)."""
    return (F.col("direction").isin(*ALLOWED_DIRECTIONS)
            & to_smallest_unit(F.col("amount"), F.col("currency")).isNotNull()
            & F.col("transaction_date").isNotNull())


def validate_transactions(df: DataFrame) -> DataFrame:
    """Valid rows only, amounts in smallest units."""
    schema_check(df)
    n = normalize_types(df).withColumn("transaction_id", strip_ws(F.col("transaction_id")))
    if BROKEN in df.columns:
        n = n.where(F.col(BROKEN).isNull()).drop(BROKEN)
    return derive_smallest_unit(n.where(is_valid()))


def quarantine(df: DataFrame) -> DataFrame:
    """Rows failing B3/B4 with their violation codes."""
    return annotate(df).where(F.col("violations") != "")


def assert_valid(df: DataFrame) -> None:
    """Strict batch mode: one aggregation counts every code, then the first
    failing check (in the reference order) raises."""
    a = annotate(df)
    counts = a.agg(*[F.sum(F.col("violations").contains(c).cast("int")).alias(c)
                     for c in VALUE_CHECKS + ["currency_unsupported", "amount_out_of_range"]]).first()
    for code in VALUE_CHECKS + ["currency_unsupported", "amount_out_of_range"]:
        if counts[code]:
            raise ValidationError(f"{code}: {counts[code]} rows")


def default_fill(df: DataFrame, as_of_ts: str, mode: str = "upload") -> DataFrame:
    """Defaults for **absent columns** of an uploaded CSV.

    description '', amount 0, direction 'outflow', transaction_date today
    (upload) or '' (import), posted_at now.  ``as_of_ts`` stands in for now.
    """
    today = F.date_format(F.lit(as_of_ts).cast("timestamp_ntz"), "yyyy-MM-dd")
    defaults = {
        "description": F.lit(""),
        "amount": F.lit("0"),
        "direction": F.lit("outflow"),
        "transaction_date": today if mode == "upload" else F.lit(""),
        "posted_at": F.date_format(F.lit(as_of_ts).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"),
    }
    missing = {k: v for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df
