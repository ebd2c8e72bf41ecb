"""Account reports as aggregations over all accounts at once.

Every report groups by ``account_id`` (plus a day/week/category key).  All
aggregates used here (sum, count, min, max of a struct, stddev) are
algebraic, so Spark runs a partial aggregate on each input partition and
shuffles only one row per key and partition: an account holding a third
of all rows costs no more shuffle than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.dates import period_label, week_label
from tally.functions.money import signed_amount
from tally.operators.filters import date_range



def _zero():
    return F.lit(0).cast("bigint")


def _inflow(c="amount"):
    return F.when(F.col("direction") == "inflow", F.col(c))


def _outflow(c="amount"):
    return F.when(F.col("direction") == "outflow", F.col(c))


def _sum0(c):
    return F.coalesce(F.sum(c), _zero()).cast("bigint")


def direction_totals(ledger: DataFrame, keys=("account_id",)) -> DataFrame:
    """Total inflow, outflow and net per key (0 when none)."""
    return (ledger.groupBy(*keys)
            .agg(_sum0(_inflow()).alias("total_inflow"), _sum0(_outflow()).alias("total_outflow"))
            .withColumn("net_change", F.col("total_inflow") - F.col("total_outflow")))


def _largest(ledger: DataFrame) -> DataFrame:
    """D3: ``account_id, li, lo``: the largest inflow and outflow (amount and
    description); ties go to the latest date, then the larger id.

    The largest amounts are a hash aggregate over numbers.  Only the rows that
    hold them meet again, one of each kept per input partition, so the raw
    ledger is never sorted.
    """
    key = ["account_id", "direction"]
    top = ledger.groupBy(*key).agg(F.max("amount").alias("amount"))
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in ("transaction_date", "transaction_id", "description")])
    rows = (ledger.select(*key, "amount", "transaction_date", "transaction_id", "description")
            .join(top, [*key, "amount"]).withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1))
    # at most one row a direction
    each = F.map_from_entries(F.collect_list(F.struct("direction", F.struct("amount", "description"))))
    got = rows.groupBy("account_id").agg(each.alias("m"))
    return got.select("account_id", F.col("m")["inflow"].alias("li"), F.col("m")["outflow"].alias("lo"))


def largest_tx(ledger: DataFrame) -> DataFrame:
    """D3 alone: largest inflow / outflow per account; none -> 0 / 'N/A'."""
    return _largest(ledger).select("account_id", *_largest_cols())


def _largest_cols():
    return [
        F.coalesce(F.col("li.amount"), _zero()).alias("largest_inflow_amount"),
        F.coalesce(F.col("li.description"), F.lit("N/A")).alias("largest_inflow_description"),
        F.coalesce(F.col("lo.amount"), _zero()).alias("largest_outflow_amount"),
        F.coalesce(F.col("lo.description"), F.lit("N/A")).alias("largest_outflow_description"),
    ]


def account_summary(ledger: DataFrame, accounts: DataFrame, start=None, end=None) -> DataFrame:
    """One row per account.

    current_balance = starting_balance + net of the *filtered* period (an
    account missing from ``accounts`` gets 0 as starting balance);
    avg_daily_balance mirrors current_balance; an account with no rows in
    the period gets an all-zero row with 'N/A' descriptions and null bounds
    unless the bounds were given.
    """
    led = date_range(ledger, start, end)
    agg = (led.groupBy("account_id")
           .agg(_sum0(_inflow()).alias("total_inflow"),
                _sum0(_outflow()).alias("total_outflow"),
                F.count(F.lit(1)).alias("transaction_count"),
                F.min("transaction_date").alias("_min_d"),
                F.max("transaction_date").alias("_max_d")))
    j = (accounts.select("account_id", "starting_balance").join(agg, "account_id", "left")
         .join(_largest(led), "account_id", "left"))
    has = F.coalesce(F.col("transaction_count"), _zero()) > 0
    net = F.coalesce(F.col("total_inflow"), _zero()) - F.coalesce(F.col("total_outflow"), _zero())
    balance = F.when(has, F.coalesce(F.col("starting_balance"), _zero()) + net).otherwise(_zero())
    s = F.lit(start).cast("date") if start is not None else F.lit(None).cast("date")
    e = F.lit(end).cast("date") if end is not None else F.lit(None).cast("date")
    return j.select(
        "account_id",
        F.coalesce(s, F.col("_min_d")).alias("period_start"),
        F.coalesce(e, F.col("_max_d")).alias("period_end"),
        F.coalesce(F.col("total_inflow"), _zero()).alias("total_inflow"),
        F.coalesce(F.col("total_outflow"), _zero()).alias("total_outflow"),
        net.alias("net_change"),
        balance.alias("current_balance"),
        balance.alias("avg_daily_balance"),
        F.coalesce(F.col("transaction_count"), _zero()).alias("transaction_count"),
        *_largest_cols(),
    )


def category_breakdown(ledger: DataFrame) -> DataFrame:
    """Per account and category, row count and total amount (both
    directions added).  Null categories are excluded."""
    return (ledger.where(F.col("category").isNotNull())
            .groupBy("account_id", "category")
            .agg(F.count(F.lit(1)).alias("count"), _sum0("amount").alias("total")))


def category_analytics(ledger: DataFrame, start=None) -> DataFrame:
    """Count, total, share of the account's total (2 dp, half-even),
    integer average, and the constant trend 'stable'.

    The account total includes rows without a category, so the grouping
    keeps the null-category group until the window total is taken; the
    window runs over at most nine rows per account.
    """
    led = date_range(ledger, start, None)
    per = led.groupBy("account_id", "category").agg(
        F.count(F.lit(1)).alias("count"), _sum0("amount").alias("total_amount"))
    w = Window.partitionBy("account_id")
    per = per.withColumn("_acct_total", F.sum("total_amount").over(w))
    pct = F.col("total_amount").cast("double") / F.col("_acct_total").cast("double") * 100.0
    return (per.where(F.col("category").isNotNull())
            .select("account_id", "category", "count", "total_amount",
                    F.when(F.col("_acct_total") > 0, F.rint(pct * 100.0) / 100.0)
                     .otherwise(F.lit(0.0)).alias("percentage"),
                    F.expr("total_amount div count").alias("avg_amount"),
                    F.lit("stable").alias("trend")))


def category_by_period(ledger: DataFrame, granularity: str = "monthly", start=None) -> DataFrame:
    """Per account x category x period: amount and count."""
    led = date_range(ledger, start, None).where(F.col("category").isNotNull())
    return (led.groupBy("account_id", "category",
                        period_label(F.col("transaction_date"), granularity).alias("period"))
            .agg(_sum0("amount").alias("amount"), F.count(F.lit(1)).alias("count")))


def daily_cashflow(ledger: DataFrame) -> DataFrame:
    """Per account and day: inflow, outflow, net."""
    return direction_totals(ledger.withColumnRenamed("transaction_date", "date"),
                            ("account_id", "date")).select(
        "account_id", "date", F.col("total_inflow").alias("inflow"),
        F.col("total_outflow").alias("outflow"), F.col("net_change").alias("net"))


def weekly_cashflow(ledger: DataFrame) -> DataFrame:
    """Per account and 'Week ww' label (no year, so years merge)."""
    led = ledger.withColumn("week", week_label(F.col("transaction_date")))
    return direction_totals(led, ("account_id", "week")).select(
        "account_id", "week", F.col("total_inflow").alias("inflow"),
        F.col("total_outflow").alias("outflow"), F.col("net_change").alias("net"))


def cashflow_volatility(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """stddev_samp(daily net) / (mean(daily net) + 1), 2 dp.

    One day -> null (sample stddev undefined); an account without rows -> 0.0;
    a zero denominator -> null.
    """
    daily = daily_cashflow(ledger)
    v = (daily.groupBy("account_id")
         .agg(F.count(F.lit(1)).alias("n_days"),
              F.try_divide(F.stddev_samp("net"), F.avg("net") + 1.0).alias("_v")))
    return (accounts.select("account_id").join(v, "account_id", "left")
            .select("account_id",
                    F.coalesce("n_days", _zero()).alias("n_days"),
                    F.when(F.col("n_days").isNull(), F.lit(0.0))
                     .otherwise(F.rint(F.col("_v") * 100.0) / 100.0).alias("volatility"),
                    F.lit("stable").alias("trend")))


def daily_net(ledger: DataFrame) -> DataFrame:
    """Signed sum per account and day."""
    return (ledger.groupBy("account_id", F.col("transaction_date").alias("ds"))
            .agg(F.sum(signed_amount(F.col("amount"), F.col("direction"))).cast("bigint").alias("net")))


def period_bounds(ledger: DataFrame) -> DataFrame:
    """First and last transaction date per account."""
    return ledger.groupBy("account_id").agg(F.min("transaction_date").alias("first_date"),
                                            F.max("transaction_date").alias("last_date"))


def import_report(classified: DataFrame) -> DataFrame:
    """Inserted / duplicates_skipped / errors from a status column,
    one row per batch (``batch_id``)."""
    def n(s):
        return F.sum((F.col("status") == s).cast("bigint")).alias
    return (classified.groupBy("batch_id")
            .agg(n("inserted")("inserted"), n("duplicate")("duplicates_skipped"),
                 n("error")("errors")))


def distinct_categories(ledger: DataFrame) -> DataFrame:
    """Sorted distinct categories per account (as one string)."""
    return (ledger.where(F.col("category").isNotNull())
            .groupBy("account_id")
            .agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")))


def distinct_bad_directions(normalized: DataFrame) -> DataFrame:
    """Distinct invalid direction values of a normalised batch."""
    from tally.schema import ALLOWED_DIRECTIONS
    return (normalized.where(F.col("direction").isNull() | ~F.col("direction").isin(*ALLOWED_DIRECTIONS))
            .select("direction").distinct())


def retention_count(ledger: DataFrame, as_of, days: int) -> DataFrame:
    """Rows older than as_of - days (strict) and the space they free
    at 500 bytes per row, in MB with 2 dp."""
    from tally.schema import BYTES_PER_ROW_ESTIMATE
    cutoff = F.date_sub(as_of.cast("date") if hasattr(as_of, "cast") else F.lit(as_of).cast("date"), days)
    n = ledger.where(F.col("transaction_date") < cutoff).agg(F.count(F.lit(1)).alias("rows_to_delete"))
    mb = F.col("rows_to_delete").cast("double") * BYTES_PER_ROW_ESTIMATE / 1048576.0
    return n.select("rows_to_delete", (F.rint(mb * 100.0) / 100.0).alias("space_freed_mb"))
