"""Report queries (D*, E*): all accounts at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import analytics as A
from tally.operators import windows as W
from tally.plans.catalog import AS_OF_SQL, _acc, _led, as_of_of, register
from tally.plans.sqlviews import with_views

_DIR_SUMS = """
  CAST(coalesce(sum(amount) FILTER (WHERE direction = 'inflow'), 0) AS BIGINT) AS {i},
  CAST(coalesce(sum(amount) FILTER (WHERE direction = 'outflow'), 0) AS BIGINT) AS {o},
  CAST(coalesce(sum(amount) FILTER (WHERE direction = 'inflow'), 0)
     - coalesce(sum(amount) FILTER (WHERE direction = 'outflow'), 0) AS BIGINT) AS {n}"""

_SUMMARY_SQL = """
WITH agg AS (
  SELECT account_id,
         CAST(coalesce(sum(amount) FILTER (WHERE direction = 'inflow'), 0) AS BIGINT) AS ti,
         CAST(coalesce(sum(amount) FILTER (WHERE direction = 'outflow'), 0) AS BIGINT) AS tout,
         count(*) AS cnt, min(transaction_date) AS min_d, max(transaction_date) AS max_d,
         arg_max(amount, (amount, transaction_date, transaction_id)) FILTER (WHERE direction = 'inflow') AS li_a,
         arg_max(description, (amount, transaction_date, transaction_id)) FILTER (WHERE direction = 'inflow') AS li_d,
         arg_max(amount, (amount, transaction_date, transaction_id)) FILTER (WHERE direction = 'outflow') AS lo_a,
         arg_max(description, (amount, transaction_date, transaction_id)) FILTER (WHERE direction = 'outflow') AS lo_d
  FROM ledger {where} GROUP BY account_id)
SELECT a.account_id,
       coalesce({start}, g.min_d) AS period_start,
       coalesce({end}, g.max_d) AS period_end,
       CAST(coalesce(g.ti, 0) AS BIGINT) AS total_inflow,
       CAST(coalesce(g.tout, 0) AS BIGINT) AS total_outflow,
       CAST(coalesce(g.ti, 0) - coalesce(g.tout, 0) AS BIGINT) AS net_change,
       CAST(CASE WHEN coalesce(g.cnt, 0) > 0
                 THEN coalesce(a.starting_balance, 0) + coalesce(g.ti, 0) - coalesce(g.tout, 0)
                 ELSE 0 END AS BIGINT) AS current_balance,
       CAST(CASE WHEN coalesce(g.cnt, 0) > 0
                 THEN coalesce(a.starting_balance, 0) + coalesce(g.ti, 0) - coalesce(g.tout, 0)
                 ELSE 0 END AS BIGINT) AS avg_daily_balance,
       CAST(coalesce(g.cnt, 0) AS BIGINT) AS transaction_count,
       CAST(coalesce(g.li_a, 0) AS BIGINT) AS largest_inflow_amount,
       coalesce(g.li_d, 'N/A') AS largest_inflow_description,
       CAST(coalesce(g.lo_a, 0) AS BIGINT) AS largest_outflow_amount,
       coalesce(g.lo_d, 'N/A') AS largest_outflow_description
FROM accounts a LEFT JOIN agg g ON a.account_id = g.account_id
"""


@register("account_summary", "D2 D1 D3 D4 D11 C5", with_views(
    _SUMMARY_SQL.format(where="", start="CAST(NULL AS DATE)", end="CAST(NULL AS DATE)"),
    "accounts", "ledger"))
def account_summary(spark, d):
    return A.account_summary(_led(spark, d), _acc(spark, d))


@register("account_summary_range", "D2 B10", with_views(
    _SUMMARY_SQL.format(
        where="WHERE transaction_date >= DATE '1997-03-01' AND transaction_date <= DATE '1997-06-30'",
        start="DATE '1997-03-01'", end="DATE '1997-06-30'"),
    "accounts", "ledger"))
def account_summary_range(spark, d):
    return A.account_summary(_led(spark, d), _acc(spark, d), "1997-03-01", "1997-06-30")


@register("direction_totals", "D1", with_views(
    f"SELECT account_id, {_DIR_SUMS.format(i='total_inflow', o='total_outflow', n='net_change')} "
    "FROM ledger GROUP BY account_id", "ledger"))
def direction_totals(spark, d):
    return A.direction_totals(_led(spark, d))


@register("largest_tx", "D3", with_views("""
SELECT account_id,
  CAST(coalesce(arg_max(amount, (amount, transaction_date, transaction_id)) FILTER (WHERE direction = 'inflow'), 0) AS BIGINT) AS largest_inflow_amount,
  coalesce(arg_max(description, (amount, transaction_date, transaction_id)) FILTER (WHERE direction = 'inflow'), 'N/A') AS largest_inflow_description,
  CAST(coalesce(arg_max(amount, (amount, transaction_date, transaction_id)) FILTER (WHERE direction = 'outflow'), 0) AS BIGINT) AS largest_outflow_amount,
  coalesce(arg_max(description, (amount, transaction_date, transaction_id)) FILTER (WHERE direction = 'outflow'), 'N/A') AS largest_outflow_description
FROM ledger GROUP BY account_id""", "ledger"))
def largest_tx(spark, d):
    return A.largest_tx(_led(spark, d))


@register("category_breakdown", "D4", with_views("""
SELECT account_id, category, count(*) AS count, CAST(sum(amount) AS BIGINT) AS total
FROM ledger WHERE category IS NOT NULL GROUP BY account_id, category""", "ledger"))
def category_breakdown(spark, d):
    return A.category_breakdown(_led(spark, d))


@register("category_analytics", "D5", with_views("""
WITH per AS (
  SELECT account_id, category, count(*) AS count, CAST(sum(amount) AS BIGINT) AS total_amount
  FROM ledger GROUP BY account_id, category),
t AS (SELECT *, sum(total_amount) OVER (PARTITION BY account_id) AS acct_total FROM per)
SELECT account_id, category, count, total_amount,
       CASE WHEN acct_total > 0
            THEN round_even(CAST(total_amount AS DOUBLE) / CAST(acct_total AS DOUBLE) * 100.0 * 100.0, 0) / 100.0
            ELSE 0.0 END AS percentage,
       CAST(total_amount // count AS BIGINT) AS avg_amount,
       'stable' AS trend
FROM t WHERE category IS NOT NULL""", "ledger"))
def category_analytics(spark, d):
    return A.category_analytics(_led(spark, d))


_PERIOD_SQL = {
    "monthly": "strftime(transaction_date, '%Y-%m')",
    "weekly": "strftime(transaction_date, '%Y-W%V')",
    "daily": "strftime(transaction_date, '%Y-%m-%d')",
}


def _reg_period(gran):
    @register(f"category_by_period_{gran}", "D6", with_views(f"""
SELECT account_id, category, {_PERIOD_SQL[gran]} AS period,
       CAST(sum(amount) AS BIGINT) AS amount, count(*) AS count
FROM ledger WHERE category IS NOT NULL GROUP BY ALL""", "ledger"))
    def run(spark, d):
        return A.category_by_period(_led(spark, d), gran)
    return run


for _g in ("monthly", "weekly", "daily"):
    _reg_period(_g)


@register("daily_cashflow", "D7", with_views(
    f"SELECT account_id, transaction_date AS date, {_DIR_SUMS.format(i='inflow', o='outflow', n='net')} "
    "FROM ledger GROUP BY account_id, transaction_date", "ledger"))
def daily_cashflow(spark, d):
    return A.daily_cashflow(_led(spark, d))


@register("weekly_cashflow", "D8", with_views(
    f"SELECT account_id, 'Week ' || strftime(transaction_date, '%V') AS week, "
    f"{_DIR_SUMS.format(i='inflow', o='outflow', n='net')} FROM ledger GROUP BY ALL", "ledger"))
def weekly_cashflow(spark, d):
    return A.weekly_cashflow(_led(spark, d))


@register("cashflow_volatility", "D9", with_views(f"""
WITH daily AS (
  SELECT account_id, transaction_date, {_DIR_SUMS.format(i='inflow', o='outflow', n='net')}
  FROM ledger GROUP BY account_id, transaction_date),
v AS (SELECT account_id, count(*) AS n_days,
             CASE WHEN avg(net) + 1.0 = 0 THEN NULL ELSE stddev_samp(net) / (avg(net) + 1.0) END AS v
      FROM daily GROUP BY account_id)
SELECT a.account_id, CAST(coalesce(v.n_days, 0) AS BIGINT) AS n_days,
       CASE WHEN v.n_days IS NULL THEN 0.0 ELSE round_even(v.v * 100.0, 0) / 100.0 END AS volatility,
       'stable' AS trend
FROM accounts a LEFT JOIN v ON a.account_id = v.account_id""", "accounts", "ledger"))
def cashflow_volatility(spark, d):
    return A.cashflow_volatility(_led(spark, d), _acc(spark, d))


_DAILY_NET_SQL = """
  SELECT account_id, transaction_date AS ds,
         CAST(sum(CASE WHEN direction = 'inflow' THEN amount ELSE -amount END) AS BIGINT) AS net
  FROM ledger GROUP BY account_id, transaction_date"""


@register("daily_net", "D10 B13", with_views(_DAILY_NET_SQL, "ledger"))
def daily_net(spark, d):
    return A.daily_net(_led(spark, d))


@register("period_bounds", "D11", with_views(
    "SELECT account_id, min(transaction_date) AS first_date, max(transaction_date) AS last_date "
    "FROM ledger GROUP BY account_id", "ledger"))
def period_bounds(spark, d):
    return A.period_bounds(_led(spark, d))


@register("distinct_categories", "D13", with_views(
    "SELECT account_id, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories "
    "FROM ledger WHERE category IS NOT NULL GROUP BY account_id", "ledger"))
def distinct_categories(spark, d):
    return A.distinct_categories(_led(spark, d))


@register("retention_count", "D14", with_views(f"""
SELECT count(*) AS rows_to_delete,
       round_even(CAST(count(*) AS DOUBLE) * 500 / 1048576.0 * 100.0, 0) / 100.0 AS space_freed_mb
FROM ledger WHERE transaction_date < CAST({AS_OF_SQL} - INTERVAL 1000 DAY AS DATE)""", "ledger"))
def retention_count(spark, d):
    led = _led(spark, d)
    return A.retention_count(led, as_of_of(led), 1000)


@register("running_balance", "E1", with_views(f"""
WITH daily AS ({_DAILY_NET_SQL})
SELECT d.account_id, d.ds, d.net,
       CAST(coalesce(a.starting_balance, 0)
            + sum(d.net) OVER (PARTITION BY d.account_id ORDER BY d.ds
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance
FROM daily d LEFT JOIN accounts a ON d.account_id = a.account_id""", "accounts", "ledger"))
def running_balance(spark, d):
    return W.running_balance(A.daily_net(_led(spark, d)), _acc(spark, d))


@register("series_index", "E2", with_views(f"""
WITH daily AS ({_DAILY_NET_SQL})
SELECT account_id, ds, net,
       CAST(row_number() OVER (PARTITION BY account_id ORDER BY ds) - 1 AS BIGINT) AS i
FROM daily""", "ledger"))
def series_index(spark, d):
    return W.series_index(A.daily_net(_led(spark, d)))
