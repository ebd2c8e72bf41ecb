"""Daily balance forecasting for every account in one job.

Model per account (fitted on the daily balance series of its adaptive
lookback window):

    y_i     = balance on the i-th active day (i = 0..n-1, row index)
    y_i    ~ a + b*i                    ordinary least squares
    off[w]  = mean residual of weekday w (Monday = 0)
    sigma   = sample stddev of residual - off[weekday], kept at 4 dp
    yhat(d) = a + b*(days since first day) + off[weekday(d)] (missing -> 0)
    bounds  = yhat -/+ 1.96 * max(sigma, 1e-6)

The fit uses exact integer sums in smallest units (decimal(38,0)) and one
floating division at the end, so the parameters do not depend on
summation order or partitioning.  Work is a chain of aggregations: ledger
-> (account, day) partial aggregate -> per-account windows over at most
one row per calendar day -> per-account sums.  No per-account Python, no
collect, and a hot account costs no more shuffle than a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.money import currency_factor, rint_bigint, signed_amount
from tally.operators.filters import lookback_cutoff
from tally.schema import (
    DEFAULT_LOOKBACK_YEARS, FORECAST_CONFIDENCE, INTERVAL_Z, MAX_HORIZON_DAYS,
    MAX_LOOKBACK_YEARS, MIN_DAYS_REQUIRED, SIGMA_FLOOR,
)

DEC = "decimal(38,0)"
LOOKBACKS = list(range(DEFAULT_LOOKBACK_YEARS, MAX_LOOKBACK_YEARS + 1))


def _date(as_of) -> Column:
    return as_of.cast("date") if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def daily_signed(ledger: DataFrame, as_of) -> DataFrame:
    """D10 restricted to the widest lookback: (account_id, ds, net).

    The daily rows (at most one per account and calendar day, so no skew
    left) are hash-partitioned by account once; every later step - the
    lookback count, the per-account windows, the fit aggregates by account
    and by (account, weekday), and the joins on account - is satisfied by
    that partitioning, so the whole fit runs without another shuffle.
    """
    return (ledger.where(F.col("transaction_date") >= lookback_cutoff(_date(as_of), MAX_LOOKBACK_YEARS))
            .groupBy("account_id", F.col("transaction_date").alias("ds"))
            .agg(F.sum(signed_amount(F.col("amount"), F.col("direction"))).cast("bigint").alias("net"))
            .repartition("account_id"))


def adaptive_lookback(daily: DataFrame, as_of) -> DataFrame:
    """Smallest N in 2..5 years whose window holds >= 90 active days.

    All four candidate counts come from one aggregation (no loop, no
    re-scan).  lookback_years is null when no N qualifies.
    """
    d = _date(as_of)
    counts = [F.sum((F.col("ds") >= lookback_cutoff(d, n)).cast("bigint")).alias(f"days_{n}y")
              for n in LOOKBACKS]
    agg = daily.groupBy("account_id").agg(*counts)
    pick = F.lit(None).cast("int")
    for n in reversed(LOOKBACKS):
        pick = F.when(F.col(f"days_{n}y") >= MIN_DAYS_REQUIRED, F.lit(n)).otherwise(pick)
    n_days = F.lit(None).cast("bigint")
    for n in reversed(LOOKBACKS):
        n_days = F.when(pick == n, F.col(f"days_{n}y")).otherwise(n_days)
    return agg.select("account_id", *[f"days_{n}y" for n in LOOKBACKS],
                      pick.alias("lookback_years"), n_days.alias("n_days"))


def insufficient_accounts(accounts: DataFrame, lookback: DataFrame) -> DataFrame:
    """Accounts with no qualifying lookback (including no rows at all)."""
    ok = lookback.where(F.col("lookback_years").isNotNull()).select("account_id")
    return (accounts.select("account_id").join(ok, "account_id", "left_anti")
            .withColumn("status", F.lit("insufficient_data"))
            .withColumn("error", F.concat(F.lit("Not enough data to train model for account "),
                                          F.col("account_id"))))


def balance_series(ledger: DataFrame, accounts: DataFrame, as_of) -> DataFrame:
    """(account_id, ds, i, balance, y) over each account's lookback.

    balance = starting_balance + running sum of daily net (smallest units,
    bigint); y = balance in major units; i = 0-based row index (E1, E2).
    The J2 counts are a window over the account's daily rows (already
    partitioned by account, at most one row per day), so choosing the
    lookback needs neither a join nor a shuffle.
    """
    d = _date(as_of)
    daily = daily_signed(ledger, d)
    whole = Window.partitionBy("account_id")
    for n in LOOKBACKS:
        daily = daily.withColumn(f"_d{n}", F.sum((F.col("ds") >= lookback_cutoff(d, n)).cast("bigint")).over(whole))
    pick = F.lit(None).cast("int")
    for n in reversed(LOOKBACKS):
        pick = F.when(F.col(f"_d{n}") >= MIN_DAYS_REQUIRED, F.lit(n)).otherwise(pick)
    s = (daily.withColumn("lookback_years", pick)
         .where(F.col("lookback_years").isNotNull()
                & (F.col("ds") >= F.add_months(d, -12 * F.col("lookback_years")))))
    w = Window.partitionBy("account_id").orderBy("ds")
    wc = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.select("account_id", "ds", "lookback_years",
                 (F.row_number().over(w) - 1).cast("bigint").alias("i"),
                 F.sum("net").over(wc).alias("_cum"))
    acc = accounts.select("account_id", "starting_balance", "currency")
    s = s.join(acc, "account_id", "left").select(
        "account_id", "ds", "lookback_years", "currency", "i",
        (F.coalesce("starting_balance", F.lit(0).cast("bigint")) + F.col("_cum")).cast("bigint").alias("balance"))
    return s.withColumn("y", F.col("balance").cast("double")
                        / currency_factor(F.col("currency")).cast("double"))


def _exact(c: str) -> Column:
    return F.col(c).cast(DEC)


def fit_forecaster(series: DataFrame) -> DataFrame:
    """One model row per account from a J1 series, in a single pass.

    The least-squares sums are window aggregates over the account's rows
    (exact decimal(38,0)), the weekday sums are window aggregates over
    (account, weekday), so every row knows its account's a, b and its
    weekday offset; the residual stddev and the model come from one final
    group-by.  The series is partitioned by account (see daily_signed), so
    the windows and the group-by need no shuffle, and a window partition is
    at most one account's days.

    Parameters are returned in major units; ``weekday_offsets`` is a
    map<int,double> (absent weekday -> no key).
    """
    wa = Window.partitionBy("account_id")
    ww = Window.partitionBy("account_id", "wd")
    s = series.withColumn("wd", F.weekday("ds")).withColumns({
        "n": F.count(F.lit(1)).over(wa),
        "si": F.sum(_exact("i")).over(wa),
        "sii": F.sum(_exact("i") * _exact("i")).over(wa),
        "sy": F.sum(_exact("balance")).over(wa),
        "siy": F.sum(_exact("i") * _exact("balance")).over(wa),
        "nw": F.count(F.lit(1)).over(ww),
        "syw": F.sum("balance").over(ww),
        "siw": F.sum("i").over(ww),
    })
    n = F.col("n").cast(DEC)
    den = (n * F.col("sii") - F.col("si") * F.col("si")).cast("double")
    s = s.withColumns({
        "b": F.try_divide((n * F.col("siy") - F.col("si") * F.col("sy")).cast("double"), den),
        "a": F.try_divide((F.col("sy") * F.col("sii") - F.col("si") * F.col("siy")).cast("double"), den),
    })
    # off[w] = mean(y_w) - a - b * mean(i_w)
    s = s.withColumn("off", F.col("syw").cast("double") / F.col("nw").cast("double") - F.col("a")
                     - F.col("b") * (F.col("siw").cast("double") / F.col("nw").cast("double")))
    s = s.withColumn("e", F.col("balance").cast("double") - F.col("a") - F.col("b") * F.col("i").cast("double")
                     - F.col("off"))
    # a, b, n are constant within an account: max() just picks them and
    # keeps the aggregation hash-based.
    m = (s.groupBy("account_id", "lookback_years", "currency")
         .agg(F.max("n").alias("n"), F.max("a").alias("a"), F.max("b").alias("b"),
              F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
              F.stddev_samp("e").alias("sigma_s"),
              F.map_from_entries(F.array_sort(F.collect_set(F.struct("wd", "off")))).alias("_offs_s")))
    f = currency_factor(F.col("currency")).cast("double")
    return m.select("account_id", "lookback_years", F.col("n").alias("n_days"), "first_ds", "last_ds",
                    "currency",
                    (F.col("a") / f).alias("intercept"),
                    (F.col("b") / f).alias("slope"),
                    F.transform_values("_offs_s", lambda k, v: v / f).alias("weekday_offsets"),
                    (F.rint(F.coalesce(F.col("sigma_s"), F.lit(0.0)) / f * 1e4) / 1e4).alias("sigma"))


def retrain_all(ledger: DataFrame, accounts: DataFrame, as_of, trained_at=None) -> DataFrame:
    """Fit every account; accounts without enough history get a status
    row instead of failing the batch.

    One fit, then a left join from the accounts table: an account gets a
    model exactly when some lookback reaches 90 days, and a ledger account
    missing from the accounts table gets none (it has no metadata).
    """
    d = _date(as_of)
    models = fit_forecaster(balance_series(ledger, accounts, d))
    ts = trained_at if trained_at is not None else F.current_timestamp()
    missing = F.col("n_days").isNull()
    return (accounts.select("account_id", "user_id").join(models, "account_id", "left")
            .withColumn("status", F.when(missing, F.lit("insufficient_data")).otherwise(F.lit("trained")))
            .withColumn("error", F.when(missing, F.concat(
                F.lit("Not enough data to train model for account "), F.col("account_id"))))
            .withColumn("trained_at", ts))


def future_dates(models: DataFrame, horizon: int) -> DataFrame:
    """Last ds + 1 .. last ds + horizon, one row per account and day."""
    if not 1 <= horizon <= MAX_HORIZON_DAYS:
        raise ValueError(f"horizon must be between 1 and {MAX_HORIZON_DAYS}")
    return models.withColumn("ds", F.explode(F.sequence(F.date_add("last_ds", 1),
                                                        F.date_add("last_ds", horizon))))


def predict_balance(future: DataFrame) -> DataFrame:
    """Yhat and bounds in major units for rows of J5."""
    day_index = F.datediff("ds", "first_ds").cast("double")
    off = F.coalesce(F.try_element_at("weekday_offsets", F.weekday("ds")), F.lit(0.0))
    yhat = F.col("intercept") + F.col("slope") * day_index + off
    half = F.greatest(F.col("sigma"), F.lit(SIGMA_FLOOR)) * INTERVAL_Z
    return future.select("account_id", "ds", "currency", yhat.alias("yhat"),
                         (yhat - half).alias("yhat_lower"), (yhat + half).alias("yhat_upper"))


def forecast_points(models: DataFrame, horizon: int = 7) -> DataFrame:
    """Forecast rows in smallest units with the 0.95 interval."""
    p = predict_balance(future_dates(models.where(F.col("intercept").isNotNull()), horizon))
    f = currency_factor(F.col("currency")).cast("double")
    return p.select("account_id", F.col("ds").alias("date"),
                    rint_bigint(F.col("yhat") * f).alias("balance"),
                    rint_bigint(F.col("yhat_lower") * f).alias("lower_bound"),
                    rint_bigint(F.col("yhat_upper") * f).alias("upper_bound"),
                    F.lit(FORECAST_CONFIDENCE).alias("confidence_interval"))


def lazy_fit(requested: DataFrame, models: DataFrame, ledger: DataFrame, accounts: DataFrame,
             as_of, trained_at=None) -> DataFrame:
    """Stored model where present; otherwise fit now.  Returns the
    models of the requested accounts (new ones flagged ``fitted_now``)."""
    req = requested.select("account_id").distinct()
    have = models.join(req, "account_id", "left_semi")
    missing = req.join(models.select("account_id"), "account_id", "left_anti")
    fresh = retrain_all(ledger.join(missing, "account_id", "left_semi"),
                        accounts.join(missing, "account_id", "left_semi"), as_of, trained_at)
    return (have.withColumn("fitted_now", F.lit(False))
            .unionByName(fresh.withColumn("fitted_now", F.lit(True)), allowMissingColumns=True))


def drop_model(models: DataFrame, keys: DataFrame) -> DataFrame:
    """Models without the given accounts."""
    return models.join(keys.select("account_id"), "account_id", "left_anti")
