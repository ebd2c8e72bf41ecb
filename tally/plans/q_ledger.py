"""Scan / filter / join / listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import filters as FL
from tally.operators import joins as J
from tally.operators import listing as LS
from tally.operators.windows import keep_first
from tally.plans.catalog import AS_OF_SQL, _acc, _led, as_of_of, register
from tally.plans.sqlviews import with_views
from tally.schema import LISTING_COLUMNS
from tally.session import scratch_path
from tally.sources import logs as LG
from tally.sources import logstore as LOGSTORE
from tally.sources import testviews as tv

_COLS = ", ".join(LISTING_COLUMNS)


@register("ledger_scan", "A8 B10 B11", with_views(f"""
SELECT {_COLS} FROM ledger
WHERE transaction_date >= DATE '1996-01-01' AND transaction_date <= DATE '1996-12-31'
  AND category = 'Rent'""", "ledger"))
def ledger_scan(spark, d):
    led = FL.date_range(_led(spark, d), "1996-01-01", "1996-12-31")
    return FL.attr_filter(led, category="Rent").select(*LISTING_COLUMNS).orderBy(
        F.col("transaction_date").desc())


@register("attr_filter", "B11", with_views(
    "SELECT transaction_id, account_id, amount FROM ledger WHERE category = 'Revenue' AND direction = 'inflow'",
    "ledger"))
def attr_filter(spark, d):
    return FL.attr_filter(_led(spark, d), "Revenue", "inflow").select("transaction_id", "account_id", "amount")


@register("history_scan", "A9 B12", with_views(f"""
SELECT account_id, transaction_date AS txn_date, amount, direction, category FROM ledger
WHERE transaction_date >= CAST({AS_OF_SQL} - INTERVAL 2 YEAR AS DATE)""", "ledger"))
def history_scan(spark, d):
    led = _led(spark, d)
    h = FL.lookback_filter(led, 2, as_of_of(led))
    return h.select("account_id", F.col("transaction_date").alias("txn_date"), "amount", "direction",
                    "category").orderBy("account_id", "txn_date")


@register("signed_amount", "B13", with_views("""
SELECT transaction_id, CASE WHEN direction = 'inflow' THEN amount ELSE -amount END AS signed_amount
FROM ledger""", "ledger"))
def signed_amount(spark, d):
    return FL.with_signed_amount(_led(spark, d)).select("transaction_id", "signed_amount")


def _urgent_keys(spark, d):
    li = tv.table(spark, d, "lineitem")
    o = tv.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "left_semi")
            .select(F.col("l_suppkey").cast("string").alias("account_id"),
                    tv.transaction_id_expr().alias("transaction_id")))


@register("point_lookup", "B14", with_views("""
SELECT transaction_id, account_id, amount, transaction_date FROM ledger
WHERE transaction_id IN (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))""",
                                          "ledger"))
def point_lookup(spark, d):
    return FL.point_lookup(_led(spark, d), _urgent_keys(spark, d)).select(
        "transaction_id", "account_id", "amount", "transaction_date")


def _mixed_keys(spark, d):
    """Known account ids (from the ledger) and unknown ones (order-ledger ids)."""
    return (_led(spark, d).select("account_id")
            .unionByName(tv.order_accounts(spark, d).select("account_id")))


_MIXED_SQL = "(SELECT account_id FROM ledger UNION SELECT account_id FROM order_accounts)"


@register("owner_lookup", "C1", with_views(f"""
SELECT k.account_id, a.user_id FROM {_MIXED_SQL} k LEFT JOIN accounts a ON k.account_id = a.account_id""",
                                           "ledger", "accounts", "order_accounts"))
def owner_lookup(spark, d):
    return J.owner_lookup(_mixed_keys(spark, d), _acc(spark, d))


@register("owned_scope", "C2", with_views("""
SELECT transaction_id, account_id, amount FROM ledger
WHERE account_id IN (SELECT account_id FROM accounts WHERE user_id = 7)""", "ledger", "accounts"))
def owned_scope(spark, d):
    return J.owned_scope(_led(spark, d), _acc(spark, d), 7).select("transaction_id", "account_id", "amount")


@register("unauthorized_accounts", "C3", with_views("""
SELECT DISTINCT account_id FROM raw_batch
WHERE account_id NOT IN (SELECT account_id FROM accounts WHERE user_id = 7)""", "raw_batch", "accounts"))
def unauthorized_accounts(spark, d):
    return J.unauthorized_accounts(tv.raw_batch(spark, d), _acc(spark, d), 7)


def _line_batch(spark, d):
    """Line items keyed by (order, line number) only: the key repeats, so
    the batch carries in-batch duplicates; _LINE_ORDER orders copies."""
    li = tv.table(spark, d, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("transaction_id"),
        F.col("l_suppkey").cast("string").alias("account_id"),
        F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"),
        F.col("l_shipdate").cast("date").alias("transaction_date"),
        *[F.col(c).alias(f"_{c}") for c in ("l_shipdate", "l_partkey", "l_suppkey")])


_LINE_ORDER = ("_l_shipdate", "_l_partkey", "_l_suppkey")

_LINE_BATCH_SQL = """
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS transaction_id,
         CAST(l_suppkey AS VARCHAR) AS account_id,
         CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS amount,
         CAST(l_shipdate AS DATE) AS transaction_date,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                            ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn
  FROM lineitem"""


@register("keep_first", "E3 A5", f"""
WITH b AS ({_LINE_BATCH_SQL})
SELECT transaction_id, account_id, amount, transaction_date FROM b WHERE rn = 1""")
def keep_first_q(spark, d):
    return keep_first(_line_batch(spark, d), ["transaction_id"], _LINE_ORDER).drop(*_LINE_ORDER)


@register("new_rows_only", "C4", f"""
WITH b AS ({_LINE_BATCH_SQL}),
existing AS (SELECT transaction_id FROM b WHERE transaction_date < DATE '1997-01-01')
SELECT transaction_id, account_id, amount, transaction_date FROM b
WHERE rn = 1 AND transaction_id NOT IN (SELECT transaction_id FROM existing)""")
def new_rows_only(spark, d):
    b = _line_batch(spark, d)
    existing = b.where(F.col("transaction_date") < F.lit("1997-01-01").cast("date"))
    return J.new_rows_only(b, existing, ("transaction_id",), _LINE_ORDER).drop(*_LINE_ORDER)


@register("balance_lookup", "C5", with_views(f"""
SELECT k.account_id, CAST(coalesce(a.starting_balance, 0) AS BIGINT) AS starting_balance,
       a.currency AS account_currency
FROM (SELECT DISTINCT account_id FROM {_MIXED_SQL}) k LEFT JOIN accounts a ON k.account_id = a.account_id""",
                                             "ledger", "accounts", "order_accounts"))
def balance_lookup(spark, d):
    keys = _mixed_keys(spark, d).distinct()
    return J.balance_lookup(keys, _acc(spark, d))


@register("list_page", "F1", with_views(f"""
WITH f AS (SELECT * FROM ledger WHERE direction = 'inflow'),
r AS (SELECT {_COLS}, row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC,
                                              transaction_id ASC) AS position,
             count(*) OVER (PARTITION BY account_id) AS total FROM f)
SELECT * FROM r WHERE position > 10 AND position <= 30""", "ledger"))
def list_page(spark, d):
    return LS.list_page(_led(spark, d), offset=10, limit=20, direction="inflow")


@register("list_page_end", "F1", with_views(f"""
WITH f AS (SELECT * FROM ledger WHERE direction = 'outflow'),
r AS (SELECT {_COLS}, row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC,
                                              transaction_id ASC) AS position FROM f),
t AS (SELECT account_id, count(*) AS total FROM f GROUP BY account_id)
SELECT r.* REPLACE (t.account_id AS account_id), t.total
FROM t LEFT JOIN r ON r.account_id = t.account_id AND position > 150 AND position <= 250""", "ledger"))
def list_page_end(spark, d):
    """A page beyond the end of some accounts: these still have their total."""
    return LS.list_page(_led(spark, d), offset=150, limit=100, direction="outflow")


@register("account_list", "F4", with_views("SELECT * FROM accounts ORDER BY user_id, account_id", "accounts"))
def account_list(spark, d):
    return LS.account_list(_acc(spark, d))


_LOG_SQL = """
SELECT ts, level, message, account_id, user_id FROM log
WHERE level = 'ERROR' AND CAST(ts AS DATE) >= DATE '2024-01-02'
ORDER BY ts DESC, message DESC LIMIT 1000"""


@register("log_query", "F2", with_views(_LOG_SQL, "log"))
def log_query(spark, d):
    return LS.log_query(tv.log_events(spark, d), level="error", start="2024-01-02", limit=1000)


@register("log_total", "F2", with_views("""
SELECT count(*) AS total FROM log WHERE level = 'ERROR' AND CAST(ts AS DATE) >= DATE '2024-01-02'""", "log"))
def log_total(spark, d):
    return LS.log_total(tv.log_events(spark, d), level="error", start="2024-01-02")


@register("log_scan_query", "A3 F2", with_views(_LOG_SQL, "log"))
def log_scan_query(spark, d):
    """Events written out as JSON-lines log records (plus one malformed line
    per signup event), read back through A3, then queried with F2."""
    flat = tv.log_events(spark, d)
    good = LG.to_log_lines(flat)
    broken = (flat.where(F.col("level") == "SIGNUP")
              .select(F.concat(F.lit('{"record": {"level": '), F.col("message")).alias("value")))
    path = scratch_path(spark, "log")
    good.unionByName(broken).write.text(path)
    return LS.log_query(LG.read_log(spark, path), level="error", start="2024-01-02", limit=1000)


@register("date_range", "B10", with_views("""
SELECT transaction_id, account_id, transaction_date FROM ledger
WHERE transaction_date >= DATE '1998-02-01' AND transaction_date <= DATE '1998-02-28'""", "ledger"))
def date_range(spark, d):
    """Both bounds inclusive on dates (the last day is kept)."""
    return FL.date_range(_led(spark, d), "1998-02-01", "1998-02-28").select(
        "transaction_id", "account_id", "transaction_date")


@register("lookback_filter", "B12", with_views(f"""
SELECT account_id, count(*) AS rows_in_lookback FROM ledger
WHERE transaction_date >= CAST({AS_OF_SQL} - INTERVAL 3 YEAR AS DATE) GROUP BY account_id""", "ledger"))
def lookback_filter(spark, d):
    led = _led(spark, d)
    return (FL.lookback_filter(led, 3, as_of_of(led)).groupBy("account_id")
            .agg(F.count(F.lit(1)).alias("rows_in_lookback")))


@register("distinct_values", "D13", with_views("""
SELECT DISTINCT category FROM ledger WHERE category IS NOT NULL""", "ledger"))
def distinct_values(spark, d):
    """Distinct categories of the whole ledger, one row each."""
    return _led(spark, d).where(F.col("category").isNotNull()).select("category").distinct()


@register("log_scan", "A3", with_views("SELECT ts, level, message, account_id, user_id FROM log", "log"))
def log_scan(spark, d):
    """A3 alone: every record of the JSON-lines log; a malformed line per
    view event and a blank line per click event are dropped on read."""
    flat = tv.log_events(spark, d)
    broken = (flat.where(F.col("level") == "VIEW")
              .select(F.concat(F.lit('{"record": '), F.col("message")).alias("value")))
    path = scratch_path(spark, "log-all")
    blank = flat.where(F.col("level") == "CLICK").select(F.lit("").alias("value"))
    LG.to_log_lines(flat).unionByName(broken).unionByName(blank).write.text(path)
    return LG.read_log(spark, path)


def _log_store(spark, d):
    """The log as a stored table, by two batches of files; one is added twice."""
    flat, path = tv.log_events(spark, d), scratch_path(spark, "log-store")
    some = F.col("level").isin("ERROR", "VIEW")
    for batch, rows in (("a", flat.where(some)), ("b", flat.where(~some)), ("a", flat.where(some))):
        source = scratch_path(spark, f"log-{batch}")
        LG.to_log_lines(rows).write.text(source)
        LOGSTORE.add_files(spark, source, path, batch)
    return path


@register("log_store_query", "A3 F2", with_views("""
SELECT ts, level, message, account_id, user_id FROM log
WHERE level = 'ERROR' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'
ORDER BY ts DESC, message DESC LIMIT 500""", "log"))
def log_store_query(spark, d):
    """F2 on the stored log: the days in range only, newest first."""
    return LOGSTORE.query(spark, _log_store(spark, d), start="2024-01-05", end="2024-01-12", level="error", limit=500)


@register("log_store_total", "A3 F2", with_views("""
SELECT count(*) AS total FROM log WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""", "log"))
def log_store_total(spark, d):
    return LOGSTORE.total(spark, _log_store(spark, d), start="2024-01-05", end="2024-01-12")
