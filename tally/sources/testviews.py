"""The given test tables seen as a ledger.

accounts      <- supplier   (one account per supplier, owner = nation)
transactions  <- lineitem   (one transaction per line, account = supplier)
order_ledger  <- orders x customer (account = nation + market segment;
                 sparse histories that exercise the adaptive lookback)
log           <- events
labels        <- documents  (text -> language as the class)

Each view is a projection over one parquet scan (plus one join for the
order ledger), so filters and column pruning still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions.money import rint_bigint

# Fixture phrases for ledger descriptions, with the category stored on the
# ledger row (None = not yet categorized).  Our own test fixture: rule hits,
# rule misses, empty markers and the "rent inside current" trap.
DESCRIPTION_FIXTURE = [
    ("Monthly Salary Payment", "Salaries"),
    ("Electricity Bill", "Utilities"),
    ("Office Rent", "Rent"),
    ("Cash Sale", "Revenue"),
    ("Facebook Ads Campaign", "Marketing"),
    ("Inventory Restock", "Inventory"),
    ("Equipment repair", "Supplies"),
    ("Client consultation", "Revenue"),
    ("Annual subscription", None),
    ("", None),
    ("bonus payment", "Salaries"),
    ("internet service", "Utilities"),
    ("pos transaction", "Revenue"),
    ("random unknown expense", None),
    (" N/A ", None),
    ("nil", "Miscellaneous"),
    ("-", None),
    ("Current account fee", "Rent"),
    ("driver salary and fuel cost", "Salaries"),
    ("Medical supplies order", "Supplies"),
    ("Freight to Lagos", "Miscellaneous"),
    ("Supplier payment - bulk product", "Inventory"),
    ("Tools & Hardware", "Supplies"),
    ("Shop lease renewal", "Rent"),
]
N_PHRASES = len(DESCRIPTION_FIXTURE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read plainly: the plan is the same at every size."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list, index) -> "F.Column":
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (index + F.lit(1)).cast("int"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("account_id"),
        F.col("s_nationkey").cast("bigint").alias("user_id"),
        F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("account_number"),
        rint_bigint(F.col("s_acctbal") * 100).alias("starting_balance"),
        F.lit("USD").alias("currency"),
        F.lit("2025-01-01").cast("date").alias("last_updated"),
    )


def transaction_id_expr() -> "F.Column":
    return F.concat_ws("-", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                       F.date_format("l_shipdate", "yyyyMMdd"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    idx = F.col("l_partkey") % N_PHRASES
    return li.select(
        transaction_id_expr().alias("transaction_id"),
        F.col("l_suppkey").cast("string").alias("account_id"),
        _pick([p for p, _ in DESCRIPTION_FIXTURE], idx).alias("description"),
        _pick([c for _, c in DESCRIPTION_FIXTURE], idx).alias("category"),
        rint_bigint(F.col("l_extendedprice") * 100).alias("amount"),
        F.when(F.col("l_returnflag") == "R", "outflow").otherwise("inflow").alias("direction"),
        F.lit("USD").alias("currency"),
        F.col("l_shipdate").cast("date").alias("transaction_date"),
        F.col("l_shipdate").alias("posted_at"),
    )


def order_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per (customer nation, market segment)."""
    c = table(spark, sf_dir, "customer")
    return (c.groupBy("c_nationkey", "c_mktsegment")
            .agg(rint_bigint(F.sum("c_acctbal") * 100).alias("starting_balance"))
            .select(F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment")
                    .alias("account_id"),
                    F.col("c_nationkey").cast("bigint").alias("user_id"),
                    "starting_balance",
                    F.lit("USD").alias("currency")))


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("account_id"),
        F.col("o_orderpriority").alias("description"),
        F.lit(None).cast("string").alias("category"),
        rint_bigint(F.col("o_totalprice") * 100).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "outflow").otherwise("inflow").alias("direction"),
        F.lit("USD").alias("currency"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("o_orderdate").alias("posted_at"),
    )


def raw_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incoming raw batch: all strings, some values malformed on purpose.

    Bad values come from data attributes (no row subsets are dropped):
    return flag 'R' with status 'O' gives an unknown direction, a zero
    discount gives a non-numeric amount, quantity 50 gives a bad date.
    """
    li = table(spark, sf_dir, "lineitem")
    idx = F.col("l_partkey") % N_PHRASES
    return li.select(
        F.concat(F.lit(" "), transaction_id_expr()).alias("transaction_id"),
        F.col("l_suppkey").cast("string").alias("account_id"),
        _pick([p for p, _ in DESCRIPTION_FIXTURE], idx).alias("description"),
        F.lit("").alias("category"),
        F.when(F.col("l_discount") == 0, F.lit("n/a"))
         .otherwise(F.col("l_extendedprice").cast("string")).alias("amount"),
        F.when(F.col("l_returnflag") == "A", F.lit(" Inflow"))
         .when(F.col("l_returnflag") == "N", F.lit("OUTFLOW\t"))
         .when(F.col("l_linestatus") == "F", F.lit("outflow"))
         .otherwise(F.lit("refund")).alias("direction"),
        F.when(F.col("l_quantity") == 50, F.lit("not a date"))
         .when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy-MM-dd"))
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("transaction_date"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm").alias("posted_at"),
        F.when(F.col("l_returnflag") == "N", F.lit("JPY"))
         .when(F.col("l_tax") == 0, F.lit("XOF"))
         .otherwise(F.lit("USD")).alias("currency"),
    )


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flat log records (what A3 yields after parsing)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts"),
        F.upper("event_type").alias("level"),
        F.concat(F.col("event_type"), F.lit(" #"), F.col("event_id").cast("string")).alias("message"),
        F.get_json_object("props", "$.k").alias("account_id"),
        F.col("user_id").cast("string").alias("user_id"),
    )


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id"), F.col("text").alias("description"), F.col("lang").alias("category"))
