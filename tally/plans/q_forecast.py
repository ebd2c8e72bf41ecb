"""Forecast queries (J*, C6) on the supplier ledger and on the sparse
order ledger (which exercises 3-5 year lookbacks and insufficient data)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import forecast as FC
from tally.operators.joins import model_status
from tally.plans.catalog import AS_OF_SQL, ORDER_AS_OF_SQL, _acc, _led, as_of_of, register
from tally.plans.sqlviews import with_views
from tally.session import scratch_path
from tally.sources import daily as DAILY
from tally.sources import ledger as LG
from tally.sources import models as MODELS
from tally.sources import testviews as tv


def _fc_ctes(L: str, AC: str, ASOF: str) -> str:
    """CTEs daily, look, series, st, ab, wdo, sig, model for ledger view L."""
    looks = ",\n    ".join(
        f"CAST(sum(CASE WHEN ds >= CAST({ASOF} - INTERVAL {n} YEAR AS DATE) THEN 1 ELSE 0 END) AS BIGINT) AS days_{n}y"
        for n in FC.LOOKBACKS)
    pick = " ".join(f"WHEN days_{n}y >= 90 THEN {n}" for n in FC.LOOKBACKS)
    ndays = " ".join(f"WHEN days_{n}y >= 90 THEN days_{n}y" for n in FC.LOOKBACKS)
    return f"""
daily AS (
  SELECT account_id, transaction_date AS ds,
         CAST(sum(CASE WHEN direction = 'inflow' THEN amount ELSE -amount END) AS BIGINT) AS net
  FROM {L} WHERE transaction_date >= CAST({ASOF} - INTERVAL 5 YEAR AS DATE)
  GROUP BY account_id, transaction_date),
look0 AS (SELECT account_id,
    {looks}
  FROM daily GROUP BY account_id),
look AS (SELECT *, CAST(CASE {pick} END AS INTEGER) AS lookback_years,
                CAST(CASE {ndays} END AS BIGINT) AS n_days FROM look0),
series AS (
  SELECT d.account_id, d.ds, l.lookback_years, a.currency,
         CAST(row_number() OVER w - 1 AS BIGINT) AS i,
         CAST(coalesce(a.starting_balance, 0) + sum(d.net) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance
  FROM daily d JOIN look l ON d.account_id = l.account_id
  LEFT JOIN {AC} a ON d.account_id = a.account_id
  WHERE l.lookback_years IS NOT NULL
    AND d.ds >= CAST({ASOF} - to_years(l.lookback_years) AS DATE)
  WINDOW w AS (PARTITION BY d.account_id ORDER BY d.ds)),
st AS (
  SELECT account_id, count(*) AS n,
         sum(CAST(i AS HUGEINT)) AS si, sum(CAST(i AS HUGEINT) * i) AS sii,
         sum(CAST(balance AS HUGEINT)) AS sy, sum(CAST(i AS HUGEINT) * balance) AS siy,
         min(ds) AS first_ds, max(ds) AS last_ds,
         any_value(lookback_years) AS lookback_years, any_value(currency) AS currency
  FROM series GROUP BY account_id),
ab AS (
  SELECT *, CAST(n * siy - si * sy AS DOUBLE) / CAST(n * sii - si * si AS DOUBLE) AS b,
            CAST(sy * sii - si * siy AS DOUBLE) / CAST(n * sii - si * si AS DOUBLE) AS a
  FROM st),
wdo AS (
  SELECT w.account_id, w.wd,
         CAST(w.syw AS DOUBLE) / CAST(w.nw AS DOUBLE) - ab.a - ab.b * (CAST(w.siw AS DOUBLE) / CAST(w.nw AS DOUBLE)) AS off
  FROM (SELECT account_id, isodow(ds) - 1 AS wd, count(*) AS nw, sum(balance) AS syw, sum(i) AS siw
        FROM series GROUP BY ALL) w JOIN ab ON w.account_id = ab.account_id),
sig AS (
  SELECT s.account_id,
         stddev_samp(CAST(s.balance AS DOUBLE) - ab.a - ab.b * CAST(s.i AS DOUBLE) - o.off) AS sigma_s
  FROM series s JOIN ab ON s.account_id = ab.account_id
  JOIN wdo o ON o.account_id = s.account_id AND o.wd = isodow(s.ds) - 1
  GROUP BY s.account_id),
model AS (
  SELECT ab.account_id, ab.lookback_years, ab.n AS n_days, ab.first_ds, ab.last_ds, ab.currency,
         ab.a / 100.0 AS intercept, ab.b / 100.0 AS slope,
         round_even(coalesce(sig.sigma_s, 0.0) / 100.0 * 1e4, 0) / 1e4 AS sigma
  FROM ab LEFT JOIN sig ON ab.account_id = sig.account_id)"""


def _offset_cols_sql(alias="m"):
    return ",\n       ".join(
        f"(SELECT o.off / 100.0 FROM wdo o WHERE o.account_id = {alias}.account_id AND o.wd = {k}) AS off_{k}"
        for k in range(7))


def _flat_spark(models):
    return models.select(
        "account_id", "lookback_years", "n_days", "first_ds", "last_ds", "currency",
        "intercept", "slope", "sigma",
        *[F.try_element_at("weekday_offsets", F.lit(k)).alias(f"off_{k}") for k in range(7)])


def _fit_sql(L, AC, ASOF):
    return f"""WITH {_fc_ctes(L, AC, ASOF)}
SELECT m.account_id, m.lookback_years, m.n_days, m.first_ds, m.last_ds, m.currency,
       m.intercept, m.slope, m.sigma,
       {_offset_cols_sql()}
FROM model m"""


def _forecast_sql(L, AC, ASOF, horizon):
    return f"""WITH {_fc_ctes(L, AC, ASOF)},
fut AS (SELECT m.*, CAST(m.last_ds + CAST(k AS INTEGER) AS DATE) AS ds
        FROM model m, range(1, {horizon + 1}) r(k)),
p AS (SELECT f.account_id, f.ds, f.currency,
             f.intercept + f.slope * CAST(datediff('day', f.first_ds, f.ds) AS DOUBLE)
               + coalesce(o.off / 100.0, 0.0) AS yhat,
             greatest(f.sigma, 1e-6) * 1.96 AS half
      FROM fut f LEFT JOIN wdo o ON o.account_id = f.account_id AND o.wd = isodow(f.ds) - 1)
SELECT account_id, ds AS date,
       CAST(round_even(yhat * 100.0, 0) AS BIGINT) AS balance,
       CAST(round_even((yhat - half) * 100.0, 0) AS BIGINT) AS lower_bound,
       CAST(round_even((yhat + half) * 100.0, 0) AS BIGINT) AS upper_bound,
       CAST(0.95 AS DOUBLE) AS confidence_interval
FROM p"""


def _order(spark, d):
    led = tv.order_ledger(spark, d)
    return led, tv.order_accounts(spark, d), as_of_of(led)


def _supp(spark, d):
    led = _led(spark, d)
    return led, _acc(spark, d), as_of_of(led)


@register("adaptive_lookback", "J2", with_views(f"""WITH {_fc_ctes('order_ledger', 'order_accounts', ORDER_AS_OF_SQL)}
SELECT account_id, days_2y, days_3y, days_4y, days_5y, lookback_years, n_days FROM look""",
                                                "order_ledger", "order_accounts"))
def adaptive_lookback(spark, d):
    led, acc, as_of = _order(spark, d)
    return FC.adaptive_lookback(FC.daily_signed(led, as_of), as_of)


@register("insufficient_accounts", "J3", with_views(f"""WITH {_fc_ctes('order_ledger', 'order_accounts', ORDER_AS_OF_SQL)}
SELECT a.account_id, 'insufficient_data' AS status,
       'Not enough data to train model for account ' || a.account_id AS error
FROM order_accounts a
WHERE a.account_id NOT IN (SELECT account_id FROM look WHERE lookback_years IS NOT NULL)""",
                                                    "order_ledger", "order_accounts"))
def insufficient_accounts(spark, d):
    led, acc, as_of = _order(spark, d)
    return FC.insufficient_accounts(acc, FC.adaptive_lookback(FC.daily_signed(led, as_of), as_of))


@register("balance_series", "J1 E1 E2 B12 B5", with_views(f"""WITH {_fc_ctes('ledger', 'accounts', AS_OF_SQL)}
SELECT account_id, ds, i, balance, CAST(balance AS DOUBLE) / 100.0 AS y, lookback_years FROM series""",
                                                          "ledger", "accounts"))
def balance_series(spark, d):
    led, acc, as_of = _supp(spark, d)
    return FC.balance_series(led, acc, as_of).select("account_id", "ds", "i", "balance", "y",
                                                     "lookback_years")


@register("fit_forecaster", "J4", with_views(_fit_sql("ledger", "accounts", AS_OF_SQL), "ledger", "accounts"))
def fit_forecaster(spark, d):
    led, acc, as_of = _supp(spark, d)
    return _flat_spark(FC.fit_forecaster(FC.balance_series(led, acc, as_of)))


@register("fit_forecaster_orders", "J4 J2", with_views(
    _fit_sql("order_ledger", "order_accounts", ORDER_AS_OF_SQL), "order_ledger", "order_accounts"))
def fit_forecaster_orders(spark, d):
    led, acc, as_of = _order(spark, d)
    return _flat_spark(FC.fit_forecaster(FC.balance_series(led, acc, as_of)))


@register("forecast_points", "J5 J6 J7", with_views(
    _forecast_sql("ledger", "accounts", AS_OF_SQL, 7), "ledger", "accounts"))
def forecast_points(spark, d):
    led, acc, as_of = _supp(spark, d)
    return FC.forecast_points(FC.fit_forecaster(FC.balance_series(led, acc, as_of)), 7)


@register("forecast_30_orders", "J5 J6 J7", with_views(
    _forecast_sql("order_ledger", "order_accounts", ORDER_AS_OF_SQL, 30), "order_ledger", "order_accounts"))
def forecast_30_orders(spark, d):
    led, acc, as_of = _order(spark, d)
    return FC.forecast_points(FC.fit_forecaster(FC.balance_series(led, acc, as_of)), 30)


@register("retrain_all", "J8 J3", with_views(f"""WITH {_fc_ctes('order_ledger', 'order_accounts', ORDER_AS_OF_SQL)}
SELECT a.account_id, a.user_id, m.lookback_years, m.n_days, m.intercept, m.slope, m.sigma,
       CASE WHEN m.account_id IS NULL THEN 'insufficient_data' ELSE 'trained' END AS status,
       CASE WHEN m.account_id IS NULL THEN 'Not enough data to train model for account ' || a.account_id END AS error,
       CAST({ORDER_AS_OF_SQL} AS TIMESTAMP) AS trained_at
FROM order_accounts a LEFT JOIN model m ON a.account_id = m.account_id""", "order_ledger", "order_accounts"))
def retrain_all(spark, d):
    led, acc, as_of = _order(spark, d)
    m = FC.retrain_all(led, acc, as_of, trained_at=as_of.cast("timestamp_ntz"))
    return m.select("account_id", "user_id", "lookback_years", "n_days", "intercept", "slope", "sigma",
                    "status", "error", "trained_at")


@register("retrain_from_daily", "J8 D10", with_views(f"""WITH {_fc_ctes('order_ledger', 'order_accounts', ORDER_AS_OF_SQL)}
SELECT a.account_id, a.user_id, m.lookback_years, m.n_days, m.intercept, m.slope, m.sigma,
       CASE WHEN m.account_id IS NULL THEN 'insufficient_data' ELSE 'trained' END AS status,
       CASE WHEN m.account_id IS NULL THEN 'Not enough data to train model for account ' || a.account_id END AS error,
       CAST({ORDER_AS_OF_SQL} AS TIMESTAMP) AS trained_at
FROM order_accounts a LEFT JOIN model m ON a.account_id = m.account_id""", "order_ledger", "order_accounts"))
def retrain_from_daily(spark, d):
    """J8 on the account-day table: no ledger row is read."""
    led, acc, as_of = _order(spark, d)
    path = LG.write_snapshot(led, scratch_path(spark, "daily-fit"))
    DAILY.ensure(spark, path)
    m = FC.retrain_all(DAILY.as_ledger(DAILY.read(spark, path)), acc, as_of, trained_at=as_of.cast("timestamp_ntz"))
    return m.select("account_id", "user_id", "lookback_years", "n_days", "intercept", "slope", "sigma",
                    "status", "error", "trained_at")


@register("forecast_all", "J9", with_views(f"""WITH f AS ({_forecast_sql('ledger', 'accounts', AS_OF_SQL, 7)})
SELECT a.user_id, f.* FROM f JOIN accounts a ON a.account_id = f.account_id""", "ledger", "accounts"))
def forecast_all(spark, d):
    led, acc, as_of = _supp(spark, d)
    models = FC.retrain_all(led, acc, as_of, trained_at=as_of.cast("timestamp_ntz"))
    pts = FC.forecast_points(models.where(F.col("status") == "trained"), 7)
    return pts.join(acc.select("account_id", "user_id"), "account_id").select(
        "user_id", *pts.columns)


def _region_accounts(spark, d, acc, regions):
    n = tv.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    r = tv.table(spark, d, "region").where(F.col("r_name").isin(*regions)).select("r_regionkey")
    keys = n.join(r, n.n_regionkey == r.r_regionkey, "left_semi").select(
        F.col("n_nationkey").cast("bigint").alias("user_id"))
    return acc.join(keys, "user_id", "left_semi").select("account_id")


def _region_sql(regions):
    rs = ", ".join(f"'{x}'" for x in regions)
    return (f"SELECT a.account_id FROM accounts a JOIN nation n ON a.user_id = n.n_nationkey "
            f"JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name IN ({rs})")


@register("lazy_fit", "J10", with_views(f"""WITH {_fc_ctes('ledger', 'accounts', AS_OF_SQL)},
req AS ({_region_sql(['EUROPE', 'ASIA'])}),
have AS ({_region_sql(['EUROPE'])})
SELECT m.account_id, m.n_days, m.intercept, m.slope, m.sigma,
       m.account_id NOT IN (SELECT account_id FROM have) AS fitted_now
FROM model m WHERE m.account_id IN (SELECT account_id FROM req)""", "ledger", "accounts"))
def lazy_fit(spark, d):
    """Stored models exist for the EUROPE accounts (a models table written
    first); EUROPE and ASIA accounts are requested: the missing ones are
    fitted, appended to the table, and the requested models returned."""
    led, acc, as_of = _supp(spark, d)
    ts = as_of.cast("timestamp_ntz")
    have_keys = _region_accounts(spark, d, acc, ["EUROPE"])
    path = scratch_path(spark, "models")
    FC.retrain_all(led, acc.join(have_keys, "account_id", "left_semi"), as_of, ts).write.parquet(path)
    stored = spark.read.parquet(path).where(F.col("status") == "trained")
    req = _region_accounts(spark, d, acc, ["EUROPE", "ASIA"])
    out = FC.lazy_fit(req, stored, led, acc, as_of, ts)
    fresh = out.where(F.col("fitted_now")).drop("fitted_now")
    fresh.select(*stored.columns).write.mode("append").parquet(path)
    table = spark.read.parquet(path).where(F.col("status") == "trained")
    return (table.join(req, "account_id", "left_semi")
            .join(have_keys.withColumn("_stored", F.lit(True)), "account_id", "left")
            .select("account_id", "n_days", "intercept", "slope", "sigma",
                    F.col("_stored").isNull().alias("fitted_now")))


@register("drop_model", "J11", with_views(f"""WITH {_fc_ctes('ledger', 'accounts', AS_OF_SQL)}
SELECT account_id, n_days, intercept, slope FROM model
WHERE account_id NOT IN ({_region_sql(['AFRICA'])})""", "ledger", "accounts"))
def drop_model(spark, d):
    led, acc, as_of = _supp(spark, d)
    models = FC.fit_forecaster(FC.balance_series(led, acc, as_of))
    return FC.drop_model(models, _region_accounts(spark, d, acc, ["AFRICA"])).select(
        "account_id", "n_days", "intercept", "slope")


@register("model_status", "C6", with_views(f"""WITH {_fc_ctes('order_ledger', 'order_accounts', ORDER_AS_OF_SQL)},
cnt AS (SELECT account_id, count(*) AS days_history, count(DISTINCT transaction_date) AS distinct_days
        FROM order_ledger GROUP BY account_id)
SELECT a.account_id, a.user_id,
       CASE WHEN m.account_id IS NULL THEN 'missing' ELSE 'trained' END AS status,
       CASE WHEN m.account_id IS NOT NULL THEN CAST({ORDER_AS_OF_SQL} AS TIMESTAMP) END AS trained_at,
       CAST(coalesce(c.days_history, 0) AS BIGINT) AS days_history,
       CAST(coalesce(c.distinct_days, 0) AS BIGINT) AS distinct_days,
       CASE WHEN m.account_id IS NULL THEN 'Model not trained yet' END AS last_error
FROM order_accounts a LEFT JOIN model m ON a.account_id = m.account_id
LEFT JOIN cnt c ON a.account_id = c.account_id""", "order_ledger", "order_accounts"))
def model_status_q(spark, d):
    led, acc, as_of = _order(spark, d)
    path = scratch_path(spark, "status-models")
    FC.retrain_all(led, acc, as_of, trained_at=as_of.cast("timestamp_ntz")).write.parquet(path)
    models = spark.read.parquet(path)
    return model_status(acc, models.where(F.col("status") == "trained"), led)


@register("future_dates", "J5 F3", with_views(f"""WITH {_fc_ctes('ledger', 'accounts', AS_OF_SQL)}
SELECT m.account_id, CAST(m.last_ds + CAST(k AS INTEGER) AS DATE) AS ds
FROM model m, range(1, 15) r(k)""", "ledger", "accounts"))
def future_dates(spark, d):
    """Only future dates are generated, so the 'last N predictions' tail is
    the whole output."""
    led, acc, as_of = _supp(spark, d)
    return FC.future_dates(FC.fit_forecaster(FC.balance_series(led, acc, as_of)), 14).select("account_id", "ds")


@register("predict_balance", "J6", with_views(f"""WITH {_fc_ctes('ledger', 'accounts', AS_OF_SQL)},
fut AS (SELECT m.*, CAST(m.last_ds + CAST(k AS INTEGER) AS DATE) AS ds FROM model m, range(1, 8) r(k)),
p AS (SELECT f.account_id, f.ds, f.currency,
             f.intercept + f.slope * CAST(datediff('day', f.first_ds, f.ds) AS DOUBLE)
               + coalesce(o.off / 100.0, 0.0) AS yhat,
             greatest(f.sigma, 1e-6) * 1.96 AS half
      FROM fut f LEFT JOIN wdo o ON o.account_id = f.account_id AND o.wd = isodow(f.ds) - 1)
SELECT account_id, ds, currency, yhat, yhat - half AS yhat_lower, yhat + half AS yhat_upper FROM p""",
                                                "ledger", "accounts"))
def predict_balance(spark, d):
    led, acc, as_of = _supp(spark, d)
    return FC.predict_balance(FC.future_dates(FC.fit_forecaster(FC.balance_series(led, acc, as_of)), 7))


#: Two trainings, a removal between them: the dates of the version queries.
_FIRST, _GONE, _SECOND = "1999-12-31", "2000-06-30", "2001-07-31"
_GONE_SQL = "SELECT account_id FROM order_accounts WHERE account_id LIKE '%-MACHINERY'"


def _model_at(day: str) -> str:
    """Models trained at a date from the ledger up to it, for DuckDB."""
    until = f"(SELECT * FROM order_ledger WHERE transaction_date <= DATE '{day}')"
    return f"(WITH {_fc_ctes(until, 'order_accounts', f'DATE {chr(39)}{day}{chr(39)}')} SELECT * FROM model)"


_IN_FORCE_SQL = f"""
second AS {_model_at(_SECOND)},
first AS {_model_at(_FIRST)},
force AS (
  SELECT DATE '{_FIRST}' AS as_at, DATE '{_FIRST}' AS trained, * FROM first
  UNION ALL SELECT DATE '{_GONE}', DATE '{_FIRST}', * FROM first WHERE account_id NOT IN ({_GONE_SQL})
  UNION ALL SELECT DATE '{_SECOND}', DATE '{_SECOND}', * FROM second
  UNION ALL SELECT DATE '{_SECOND}', DATE '{_FIRST}', * FROM first
            WHERE account_id NOT IN ({_GONE_SQL}) AND account_id NOT IN (SELECT account_id FROM second))"""


def _versions(spark, d):
    """A model store: a training, a removal, a second training."""
    led, acc = tv.order_ledger(spark, d), tv.order_accounts(spark, d)
    path = scratch_path(spark, "model-versions")
    for day in (_FIRST, _SECOND):
        at = F.lit(day).cast("date")
        MODELS.record(FC.retrain_all(led.where(F.col("transaction_date") <= at), acc, at, at.cast("timestamp_ntz")), path, day)
    MODELS.forget(acc.where(F.col("account_id").endswith("-MACHINERY")), path, _GONE)
    return led, acc, path


@register("model_versions", "J8 J11 I7", with_views(f"""WITH {_IN_FORCE_SQL}
SELECT as_at, account_id, lookback_years, n_days, intercept, slope, sigma, CAST(trained AS TIMESTAMP) AS trained_at
FROM force""", "order_ledger", "order_accounts"))
def model_versions(spark, d):
    """The forecasters in force at three dates, from an append-only store."""
    _, _, path = _versions(spark, d)
    parts = [MODELS.as_of(spark, path, day).withColumn("as_at", F.lit(day).cast("date")) for day in (_FIRST, _GONE, _SECOND)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "as_at", "account_id", "lookback_years", "n_days", "intercept", "slope", "sigma", "trained_at")


@register("model_status_versions", "C6 J11", with_views(f"""WITH {_IN_FORCE_SQL},
days(as_at) AS (VALUES (DATE '{_FIRST}'), (DATE '{_GONE}'), (DATE '{_SECOND}')),
counts AS (SELECT as_at, account_id, count(*) AS rows_held, count(DISTINCT transaction_date) AS days_held
           FROM days JOIN order_ledger ON transaction_date <= as_at GROUP BY ALL)
SELECT d.as_at, a.account_id, a.user_id, CASE WHEN f.account_id IS NULL THEN 'missing' ELSE 'trained' END AS status,
       CAST(f.trained AS TIMESTAMP) AS trained_at, coalesce(rows_held, 0) AS days_history,
       coalesce(days_held, 0) AS distinct_days,
       CASE WHEN f.account_id IS NULL THEN 'Model not trained yet' END AS last_error
FROM days d CROSS JOIN order_accounts a
LEFT JOIN force f ON f.as_at = d.as_at AND f.account_id = a.account_id
LEFT JOIN counts c ON c.as_at = d.as_at AND c.account_id = a.account_id""", "order_ledger", "order_accounts"))
def model_status_versions(spark, d):
    led, acc, path = _versions(spark, d)
    parts = [MODELS.status(spark, path, acc, led, day).withColumn("as_at", F.lit(day).cast("date"))
             for day in (_FIRST, _GONE, _SECOND)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("lazy_fit_versions", "J10", with_views(f"""WITH first AS {_model_at(_FIRST)},
again AS {_model_at(_GONE)}
SELECT account_id, n_days, intercept, slope, sigma, TIMESTAMP '{_FIRST}' AS trained_at FROM first
WHERE account_id NOT IN ({_GONE_SQL})
UNION ALL SELECT account_id, n_days, intercept, slope, sigma, TIMESTAMP '{_GONE} 12:00:00' FROM again
WHERE account_id NOT IN (SELECT account_id FROM first WHERE account_id NOT IN ({_GONE_SQL}))""",
                                          "order_ledger", "order_accounts"))
def lazy_fit_versions(spark, d):
    """All accounts requested at noon of the day some models were removed:
    these are fitted anew from the ledger up to then, the others are as stored."""
    led, acc, path = _versions(spark, d)
    got = MODELS.lazy_fit(spark, acc, path, led, acc, f"{_GONE} 12:00:00")
    return got.select("account_id", "n_days", "intercept", "slope", "sigma", "trained_at")
