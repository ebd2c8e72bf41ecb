"""Ingest, categorize and maintenance queries (A1, A4-A7, A10, A11, B2-B9,
B15, I1-I8, D12, K1-K8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tally.errors import PermissionDenied
from tally.functions.constraints import account_constraints, label_constraints, tx_constraints
from tally.functions.money import from_smallest_unit, to_smallest_unit
from tally.operators import analytics as A
from tally.operators import categorize as C
from tally.operators import joins as J
from tally.operators import maintain as K
from tally.operators import validate as V
from tally.plans import ingest as ING
from tally.plans.catalog import AS_OF_SQL, _acc, _led, as_of_of, register
from tally.plans.sqlviews import rule_sql, strip_sql, with_views
from tally.schema import CATEGORIES, LISTING_COLUMNS
from tally.session import scratch_path
from tally.sources import csv as CSV
from tally.sources import daily as DAILY
from tally.sources import export as EX
from tally.sources import ledger as LGR
from tally.sources import rewrite as RW
from tally.sources import testviews as tv
from tally.streaming.ingest import stream_ingest


_CATS = "(" + ", ".join(f"'{c}'" for c in CATEGORIES) + ")"


def _strip(c):
    return strip_sql(c)


_NORM_SQL = f"""
norm AS (
  SELECT {_strip('transaction_id')} AS transaction_id, account_id, description,
         CAST(try_cast({_strip('transaction_date')} AS TIMESTAMP) AS DATE) AS transaction_date,
         try_cast({_strip('posted_at')} AS TIMESTAMP) AS posted_at,
         CASE WHEN abs(try_cast({_strip('amount')} AS DOUBLE)) < 'inf'::DOUBLE
              THEN try_cast({_strip('amount')} AS DOUBLE) END AS amount,
         lower({_strip('direction')}) AS direction,
         currency
  FROM raw_batch),
annot AS (
  SELECT *,
    CASE currency WHEN 'NGN' THEN 100 WHEN 'USD' THEN 100 WHEN 'EUR' THEN 100 WHEN 'JPY' THEN 1 END AS factor,
    concat_ws(',',
      CASE WHEN direction IS NULL OR direction NOT IN ('inflow', 'outflow') THEN 'direction_invalid' END,
      CASE WHEN amount IS NULL THEN 'amount_invalid' END,
      CASE WHEN transaction_date IS NULL THEN 'transaction_date_invalid' END,
      CASE WHEN amount IS NOT NULL AND currency NOT IN ('NGN', 'USD', 'EUR', 'JPY') THEN 'currency_unsupported' END,
      CASE WHEN amount IS NOT NULL AND currency IN ('NGN', 'USD', 'EUR', 'JPY')
                AND abs(amount) >= 9.2e18 THEN 'amount_out_of_range' END) AS violations
  FROM norm)"""


@register("normalize_types", "B2", with_views(f"""WITH {_NORM_SQL}
SELECT transaction_id, transaction_date, posted_at, amount, direction, currency FROM norm""", "raw_batch"))
def normalize_types(spark, d):
    n = V.normalize_types(tv.raw_batch(spark, d)).withColumn("transaction_id", V.strip_ws(F.col("transaction_id")))
    return n.select("transaction_id", "transaction_date", "posted_at", "amount", "direction", "currency")


@register("validate_transactions", "B6 B1 B3 B4", with_views(f"""WITH {_NORM_SQL}
SELECT transaction_id, account_id, CAST(round_even(amount * factor, 0) AS BIGINT) AS amount, currency,
       direction, transaction_date, posted_at
FROM annot WHERE violations = ''""", "raw_batch"))
def validate_transactions(spark, d):
    return V.validate_transactions(tv.raw_batch(spark, d)).select(
        "transaction_id", "account_id", "amount", "currency", "direction", "transaction_date", "posted_at")


@register("quarantine", "B3", with_views(f"""WITH {_NORM_SQL}
SELECT transaction_id, violations FROM annot WHERE violations <> ''""", "raw_batch"))
def quarantine(spark, d):
    return V.quarantine(tv.raw_batch(spark, d)).select(
        "transaction_id", "violations")


@register("to_smallest_unit", "B4", with_views(f"""WITH {_NORM_SQL}
SELECT transaction_id, currency, CAST(round_even(amount * factor, 0) AS BIGINT) AS amount_minor FROM annot""",
                                               "raw_batch"))
def to_smallest(spark, d):
    n = V.normalize_types(tv.raw_batch(spark, d)).withColumn("transaction_id", V.strip_ws(F.col("transaction_id")))
    return n.select("transaction_id", "currency",
                    to_smallest_unit(F.col("amount"), F.col("currency")).alias("amount_minor"))


@register("from_smallest_unit", "B5", with_views(
    "SELECT transaction_id, CAST(amount AS DOUBLE) / 100.0 AS amount_major FROM ledger", "ledger"))
def from_smallest(spark, d):
    return _led(spark, d).select("transaction_id",
                                 from_smallest_unit(F.col("amount"), F.col("currency")).alias("amount_major"))


def _api_batch(spark, d):
    """The raw batch read as API requests (amount must be an integer)."""
    r = tv.raw_batch(spark, d)
    return r.withColumn("amount", F.when(F.col("amount").rlike(r"^\s*[+-]?[0-9]+\s*$"),
                                         F.col("amount").try_cast("bigint")))


@register("tx_constraints", "B7", with_views("""
WITH b AS (SELECT *, CASE WHEN regexp_matches(amount, '^\\s*[+-]?[0-9]+\\s*$') THEN try_cast(amount AS BIGINT) END AS amt
           FROM raw_batch)
SELECT transaction_id, concat_ws(',',
  CASE WHEN transaction_id IS NOT NULL AND length(transaction_id) > 100 THEN 'transaction_id_too_long' END,
  CASE WHEN description IS NULL OR length(description) < 1 OR length(description) > 500 THEN 'description_length' END,
  CASE WHEN category IS NOT NULL AND category NOT IN __CATS__ THEN 'category_unknown' END,
  CASE WHEN amt IS NULL OR amt <= 0 THEN 'amount_not_positive' END,
  CASE WHEN direction IS NULL OR direction NOT IN ('inflow', 'outflow') THEN 'direction_invalid' END,
  CASE WHEN transaction_date IS NULL OR NOT regexp_matches(transaction_date, '^\\p{Nd}{4}-\\p{Nd}{2}-\\p{Nd}{2}\\z')
       THEN 'date_format' END) AS violations
FROM b""".replace("__CATS__", _CATS), "raw_batch"))
def tx_constraints_q(spark, d):
    return _api_batch(spark, d).select("transaction_id", tx_constraints().alias("violations"))


@register("account_constraints", "B8", with_views("""
SELECT account_id, concat_ws(',',
  CASE WHEN account_number IS NULL OR length(account_number) < 5 OR length(account_number) > 20
       THEN 'number_length' END,
  CASE WHEN account_number IS NOT NULL
        AND NOT regexp_matches(replace(account_number, ' ', ''), '^[\\p{L}\\p{N}]+$') THEN 'number_not_alnum' END,
  CASE WHEN account_number IS NULL OR NOT regexp_matches(account_number, '^\\d{10}$') THEN 'number_not_10_digits' END,
  CASE WHEN starting_balance IS NULL OR starting_balance <= 0 THEN 'balance_not_positive' END,
  CASE WHEN currency IS NULL OR length(currency) <> 3 OR currency <> upper(currency) OR currency = lower(currency)
       THEN 'currency_format' END) AS violations
FROM accounts""", "accounts"))
def account_constraints_q(spark, d):
    return _acc(spark, d).select("account_id", account_constraints().alias("violations"))


@register("label_constraints", "B9", with_views("""
SELECT transaction_id, concat_ws(',',
  CASE WHEN description IS NULL OR length(description) < 1 OR length(description) > 500 THEN 'description_length' END,
  CASE WHEN category IS NULL OR category NOT IN __CATS__ THEN 'category_unknown' END) AS violations
FROM ledger""".replace("__CATS__", _CATS), "ledger"))
def label_constraints_q(spark, d):
    return _led(spark, d).select("transaction_id", label_constraints().alias("violations"))


@register("default_fill", "B15", with_views("""
SELECT transaction_id, '' AS description, '0' AS amount, 'outflow' AS direction,
       '2025-06-30' AS transaction_date, '2025-06-30 12:00:00' AS posted_at
FROM raw_batch""", "raw_batch"))
def default_fill(spark, d):
    r = tv.raw_batch(spark, d).drop("description", "amount", "direction", "transaction_date", "posted_at")
    f = V.default_fill(r, "2025-06-30 12:00:00", mode="upload")
    return f.select("transaction_id", "description", "amount", "direction", "transaction_date", "posted_at")


@register("rule_category", "I1", with_views(
    f"SELECT transaction_id, {rule_sql()} AS rule_category FROM ledger", "ledger"))
def rule_category_q(spark, d):
    return C.with_rule_category(_led(spark, d)).select("transaction_id", "rule_category")


@register("resolve_category", "I4", with_views(f"""
SELECT transaction_id, CASE WHEN category IS NOT NULL AND category <> '' THEN category
                            ELSE coalesce({rule_sql()}, 'Miscellaneous') END AS category
FROM ledger""", "ledger"))
def resolve_category(spark, d):
    return C.resolve_category(_led(spark, d)).select("transaction_id", "category")


@register("categorize_scored", "I5", with_views(f"""
WITH s AS (SELECT transaction_id, coalesce({rule_sql()}, 'Miscellaneous') AS category FROM ledger)
SELECT transaction_id, category, CAST(CASE WHEN category = 'Miscellaneous' THEN 0.6 ELSE 0.85 END AS DOUBLE) AS confidence,
       'rule_based' AS method FROM s""", "ledger"))
def categorize_scored(spark, d):
    return C.categorize_scored(_led(spark, d)).select("transaction_id", "category", "confidence", "method")


_FILL_SQL = f"""
  SELECT transaction_id, account_id, (category IS NULL OR category = '') AS was_filled,
         CASE WHEN category IS NULL OR category = '' THEN coalesce({rule_sql()}, 'Miscellaneous')
              ELSE category END AS category
  FROM ledger"""


@register("fill_categories", "I6", with_views(f"SELECT transaction_id, category, was_filled FROM ({_FILL_SQL})",
                                              "ledger"))
def fill_categories(spark, d):
    return C.fill_categories(_led(spark, d)).select("transaction_id", "category", "was_filled")


@register("fill_report", "I6", with_views(f"""
SELECT account_id, CAST(sum(CASE WHEN was_filled THEN 1 ELSE 0 END) AS BIGINT) AS categorized,
       CAST(sum(CASE WHEN was_filled THEN 0 ELSE 1 END) AS BIGINT) AS already_categorized
FROM ({_FILL_SQL}) GROUP BY account_id""", "ledger"))
def fill_report(spark, d):
    return C.fill_report(C.fill_categories(_led(spark, d)))


# ---------------------------------------------------------------- K1 / K2

_UPLOAD_SQL = """
  SELECT CASE WHEN l_linestatus = 'F' THEN tid ELSE 'new-' || tid END AS transaction_id,
         CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN CAST(l_suppkey + 1 AS VARCHAR)
              ELSE CAST(l_suppkey AS VARCHAR) END AS account_id,
         description, '' AS category,
         CASE WHEN l_discount = 0 THEN '3.5' ELSE CAST(CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS VARCHAR) END AS amount,
         CASE l_returnflag WHEN 'R' THEN 'outflow' WHEN 'A' THEN 'inflow' ELSE 'Inflow' END AS direction,
         strftime(l_shipdate, '%Y-%m-%d') AS transaction_date
  FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS tid,
               ({phr})[CAST(l_partkey % {n} AS INTEGER) + 1] AS description FROM lineitem)"""


def _upload_sql():
    from tally.plans.sqlviews import _list
    return _UPLOAD_SQL.format(phr=_list(p for p, _ in tv.DESCRIPTION_FIXTURE), n=tv.N_PHRASES)


def _upload_rows(spark, d):
    li = tv.table(spark, d, "lineitem")
    tid = tv.transaction_id_expr()
    idx = F.col("l_partkey") % tv.N_PHRASES
    return li.select(
        F.when(F.col("l_linestatus") == "F", tid).otherwise(F.concat(F.lit("new-"), tid)).alias("transaction_id"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), (F.col("l_suppkey") + 1).cast("string"))
         .otherwise(F.col("l_suppkey").cast("string")).alias("account_id"),
        tv._pick([p for p, _ in tv.DESCRIPTION_FIXTURE], idx).alias("description"),
        F.lit("").alias("category"),
        F.when(F.col("l_discount") == 0, F.lit("3.5"))
         .otherwise(F.rint(F.col("l_extendedprice") * 100).cast("bigint").cast("string")).alias("amount"),
        F.when(F.col("l_returnflag") == "R", "outflow").when(F.col("l_returnflag") == "A", "inflow")
         .otherwise("Inflow").alias("direction"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("transaction_date"))


def _imported(spark, d):
    """Upload rows written as a CSV file set, read back with file row numbers."""
    path = scratch_path(spark, "upload")
    CSV.write_csv(_upload_rows(spark, d), path, compression="gzip")
    rows = CSV.stage_csv(spark, path, scratch_path(spark, "upload-staged"))
    return K.import_csv(rows, _led(spark, d), mode="upload", as_of_ts="2025-06-30 12:00:00")


_IMPORT_STATUS_SQL = f"""
  SELECT b.transaction_id, b.account_id,
         CASE WHEN l.account_id = b.account_id THEN 'duplicate'
              WHEN l.account_id IS NOT NULL THEN 'error'
              WHEN NOT regexp_matches(b.amount, '^\\s*[+-]?[0-9]+\\s*$') OR b.direction NOT IN ('inflow', 'outflow')
              THEN 'error' ELSE 'inserted' END AS status,
         CASE WHEN regexp_matches(b.amount, '^\\s*[+-]?[0-9]+\\s*$') THEN CAST(b.amount AS BIGINT) END AS amount,
         coalesce({rule_sql('b.description', 'b.direction')}, 'Miscellaneous') AS category
  FROM ({_upload_sql()}) b LEFT JOIN ledger l ON b.transaction_id = l.transaction_id"""


@register("import_csv", "K2 C4", with_views(f"SELECT * FROM ({_IMPORT_STATUS_SQL})", "ledger"))
def import_csv(spark, d):
    return _imported(spark, d).select("transaction_id", "account_id", "status", "amount", "category")


@register("import_report", "D12 K2", with_views(f"""
SELECT 'upload' AS batch_id,
       CAST(sum(CASE WHEN status = 'inserted' THEN 1 ELSE 0 END) AS BIGINT) AS inserted,
       CAST(sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS BIGINT) AS duplicates_skipped,
       CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors
FROM ({_IMPORT_STATUS_SQL})""", "ledger"))
def import_report(spark, d):
    return A.import_report(_imported(spark, d).withColumn("batch_id", F.lit("upload")))


@register("import_errors", "D12 K2", with_views(f"""
WITH s AS ({_IMPORT_STATUS_SQL}),
b AS (SELECT s.transaction_id, concat_ws(',', CASE WHEN s.amount IS NULL THEN 'amount_invalid' END,
        CASE WHEN u.direction NOT IN ('inflow', 'outflow') THEN 'direction_invalid' END) AS codes
      FROM s JOIN ({_upload_sql()}) u ON u.transaction_id = s.transaction_id WHERE s.status = 'error')
SELECT transaction_id, CASE WHEN codes <> '' THEN codes ELSE 'transaction_id_of_other_account' END AS error FROM b""", "ledger"))
def import_errors(spark, d):
    """The (file, row, error) rows of an import, each brought back to its line by file and row number."""
    path = scratch_path(spark, "upload")
    CSV.write_csv(_upload_rows(spark, d), path, compression="gzip")
    rows = CSV.stage_csv(spark, path, scratch_path(spark, "upload-staged"))
    errors = K.import_errors(K.import_csv(rows, _led(spark, d), mode="upload", as_of_ts="2025-06-30 12:00:00"))
    lines = rows.select("transaction_id", F.col("_file").alias("file"), (F.col("_row") + 2).alias("row"))
    return errors.join(lines, ["file", "row"]).select("transaction_id", "error")


@register("import_row_numbers", "K2", None)
def import_row_numbers(spark, d):
    """Error rows with their CSV row number (index + 2); file order is the
    writer's, so only the row count is checked against the oracle side."""
    return _imported(spark, d).where(F.col("status") == "error").select("transaction_id", "row_number")


@register("import_row_facts", "K2", with_views(f"""
SELECT count(*) AS n_rows, true AS contiguous, CAST(0 AS BIGINT) AS shared_places FROM ({_upload_sql()})""", "ledger"))
def import_row_facts(spark, d):
    """Row numbers of the staged upload files: each file's run from 0 without
    gaps, and no two rows share a place in the order over all files."""
    path = scratch_path(spark, "upload")
    CSV.write_csv(_upload_rows(spark, d), path, compression="gzip")
    rows = CSV.stage_csv(spark, path, scratch_path(spark, "upload-staged"))
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("low"), F.max("_row").alias("high"),
                                      F.countDistinct("_seq").alias("places"))
    return files.agg(F.sum("n").alias("n_rows"),
                     F.min((F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("contiguous"),
                     F.sum(F.col("n") - F.col("places")).alias("shared_places"))


def _api_requests(spark, d):
    li = tv.table(spark, d, "lineitem")
    tid = tv.transaction_id_expr()
    idx = F.col("l_partkey") % tv.N_PHRASES
    return li.select(
        F.when(F.col("l_linestatus") == "F", tid).otherwise(F.concat(F.lit("api-"), tid)).alias("transaction_id"),
        F.concat(F.when(F.col("l_tax") == 0, "unknown-").otherwise(""), F.col("l_suppkey").cast("string")).alias("account_id"),
        tv._pick([p for p, _ in tv.DESCRIPTION_FIXTURE], idx).alias("description"),
        F.when(F.col("l_returnflag") == "N", F.lit("Groceries")).alias("category"),
        F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"),
        F.when(F.col("l_returnflag") == "R", "outflow").otherwise("inflow").alias("direction"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("transaction_date"),
        F.lit(None).cast("string").alias("posted_at"),
        F.col("l_orderkey").alias("_row"))


def _phrase_sql():
    from tally.plans.sqlviews import _list
    return f"({_list(p for p, _ in tv.DESCRIPTION_FIXTURE)})[CAST(l_partkey % {tv.N_PHRASES} AS INTEGER) + 1]"


@register("insert_tx", "K1 B7 I4 C4", with_views(f"""
WITH b AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN tid ELSE 'api-' || tid END AS transaction_id,
         CASE WHEN l_tax = 0 THEN 'unknown-' ELSE '' END || l_suppkey AS account_id, description,
         CASE WHEN l_returnflag = 'N' THEN 'Groceries' END AS category,
         CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS amount,
         CASE WHEN l_returnflag = 'R' THEN 'outflow' ELSE 'inflow' END AS direction
  FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS tid,
               {_phrase_sql()} AS description FROM lineitem)),
v AS (SELECT b.*, concat_ws(',',
        CASE WHEN b.description IS NULL OR length(b.description) < 1 OR length(b.description) > 500 THEN 'description_length' END,
        CASE WHEN b.category IS NOT NULL AND b.category NOT IN {_CATS} THEN 'category_unknown' END,
        CASE WHEN starts_with(b.account_id, 'unknown-') THEN 'account_unknown' END) AS errors,
        l.account_id AS held_by
      FROM b LEFT JOIN ledger l ON b.transaction_id = l.transaction_id)
SELECT transaction_id, account_id,
       CASE WHEN category IS NOT NULL AND category <> '' THEN category
            ELSE coalesce({rule_sql()}, 'Miscellaneous') END AS category,
       amount, CASE WHEN NOT starts_with(account_id, 'unknown-') THEN 'USD' END AS currency,
       CASE WHEN errors <> '' THEN 'error' WHEN held_by = account_id THEN 'duplicate'
            WHEN held_by IS NOT NULL THEN 'error' ELSE 'inserted' END AS status,
       errors
FROM v""", "ledger"))
def insert_tx(spark, d):
    r = K.insert_tx(_api_requests(spark, d), _led(spark, d), _acc(spark, d), "2025-06-30 12:00:00")
    return r.select("transaction_id", "account_id", "category", "amount", "currency", "status", "errors")


# ---------------------------------------------------------------- K3 - K8

def _patches(spark, d):
    """Rent rows get an upper-cased description by the later of two patches;
    uncategorized rows get 'Miscellaneous'; empty values keep the old value."""
    led = _led(spark, d)
    rent = led.where(F.col("category") == "Rent").select(
        "account_id", "transaction_id", F.upper("description").alias("description"), F.lit("").alias("category"))
    unc = led.where(F.col("category").isNull()).select(
        "account_id", "transaction_id", F.lit("").alias("description"), F.lit("Miscellaneous").alias("category"))
    before = rent.withColumn("description", F.lit("superseded")).withColumn("_row", F.lit(0))
    return before.unionByName(rent.unionByName(unc).withColumn("_row", F.lit(1)))


@register("update_tx", "K3", with_views("""
WITH p AS (
  SELECT account_id, transaction_id, upper(description) AS nd, '' AS nc FROM ledger WHERE category = 'Rent'
  UNION ALL
  SELECT account_id, transaction_id, '' AS nd, 'Miscellaneous' AS nc FROM ledger WHERE category IS NULL)
SELECT l.transaction_id,
       coalesce(CASE WHEN p.nd <> '' THEN p.nd END, l.description) AS description,
       coalesce(CASE WHEN p.nc <> '' THEN p.nc END, l.category) AS category
FROM ledger l LEFT JOIN p ON l.account_id = p.account_id AND l.transaction_id = p.transaction_id""", "ledger"))
def update_tx(spark, d):
    return K.update_tx(_led(spark, d), _patches(spark, d)).select("transaction_id", "description", "category")


_URGENT_IDS_SQL = """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


@register("delete_tx", "K4", with_views(f"""
SELECT transaction_id, account_id FROM ledger WHERE transaction_id NOT IN ({_URGENT_IDS_SQL})""", "ledger"))
def delete_tx(spark, d):
    from tally.plans.q_ledger import _urgent_keys
    return K.delete_tx(_led(spark, d), _urgent_keys(spark, d)).select("transaction_id", "account_id")


def _account_requests(spark, d):
    """A request for each customer, some with a currency in small letters.
    Those are asked for again with the next customer's number, which turns
    that one's request down; some requests are repeated, some come without id."""
    c = tv.table(spark, d, "customer")

    def asked(rows, k, next_number=0, currency="USD", account_id=None):
        return rows.select(
            (F.concat(F.lit("c"), F.col("c_custkey").cast("string")) if account_id is None else account_id).alias("account_id"),
            F.col("c_nationkey").cast("bigint").alias("user_id"),
            F.lpad((F.col("c_custkey") + next_number).cast("string"), 10, "0").alias("account_number"),
            F.rint(F.col("c_acctbal") * 100).cast("bigint").alias("starting_balance"),
            F.when(F.col("c_mktsegment") == "BUILDING", F.lit(currency)).otherwise("USD").alias("currency"),
            (F.col("c_custkey") * 4 + k).alias("_row"))

    of = lambda segment: c.where(F.col("c_mktsegment") == segment)
    return (asked(c, 0, currency="usd").unionByName(asked(of("BUILDING"), 1, 1)).unionByName(asked(of("AUTOMOBILE"), 2))
            .unionByName(asked(of("HOUSEHOLD"), 3, account_id=F.lit(None).cast("string"))))


@register("account_create", "K5 B8", with_views("""
WITH c AS (SELECT *, CAST(round_even(c_acctbal * 100, 0) AS BIGINT) <= 0 AS poor,
                  lpad(CAST(c_custkey AS VARCHAR), 10, '0') IN (SELECT account_number FROM accounts) AS taken,
                  lpad(CAST(c_custkey + 1 AS VARCHAR), 10, '0') IN (SELECT account_number FROM accounts) AS next_taken
           FROM customer),
second AS (SELECT c_custkey, poor, next_taken, c_custkey + 1 AS blocked FROM c WHERE c_mktsegment = 'BUILDING'),
r AS (
  SELECT 'c' || c_custkey AS account_id, taken,
         c_custkey IN (SELECT blocked FROM second WHERE NOT poor AND NOT next_taken) AS late,
         concat_ws(',', CASE WHEN poor THEN 'balance_not_positive' END,
                   CASE WHEN c_mktsegment = 'BUILDING' THEN 'currency_format' END) AS errors
  FROM c
  UNION ALL SELECT 'c' || c_custkey, next_taken, false, CASE WHEN poor THEN 'balance_not_positive' ELSE '' END FROM second
  UNION ALL SELECT 'c' || c_custkey, taken, true, CASE WHEN poor THEN 'balance_not_positive' ELSE '' END
  FROM c WHERE c_mktsegment = 'AUTOMOBILE'
  UNION ALL SELECT NULL, taken, false, concat_ws(',', 'account_id_missing', CASE WHEN poor THEN 'balance_not_positive' END)
  FROM c WHERE c_mktsegment = 'HOUSEHOLD')
SELECT account_id, CASE WHEN taken THEN 'duplicate' WHEN errors <> '' THEN 'error' WHEN late THEN 'duplicate'
                        ELSE 'created' END AS status, errors
FROM r""", "accounts"))
def account_create(spark, d):
    r = K.account_create(_acc(spark, d), _account_requests(spark, d), "2025-06-30")
    return r.select("account_id", "status", "errors")


@register("account_update", "K6", with_views("""
SELECT account_id, user_id, account_number,
       CASE WHEN user_id = 3 THEN starting_balance + 100000 ELSE starting_balance END AS starting_balance,
       currency,
       CASE WHEN user_id = 3 THEN DATE '2025-06-30' ELSE last_updated END AS last_updated
FROM accounts""", "accounts"))
def account_update(spark, d):
    acc = _acc(spark, d)
    own = acc.where(F.col("user_id") == 3)
    patches = [own.select("account_id", (F.col("starting_balance") + by).alias("starting_balance"),
                          F.lit(None).cast("string").alias("currency"), F.lit(k).alias("_row")) for k, by in ((1, 100000), (0, 7))]
    patches = patches[0].unionByName(patches[1])
    return K.account_update(acc, patches, "2025-06-30")


@register("account_delete", "K7", with_views("""
WITH k AS (SELECT a.account_id FROM accounts a JOIN nation n ON a.user_id = n.n_nationkey
           JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'AFRICA'
           UNION SELECT account_id FROM order_accounts)
SELECT k.account_id,
       CASE WHEN k.account_id NOT IN (SELECT account_id FROM accounts) THEN 'not_found'
            WHEN k.account_id IN (SELECT account_id FROM ledger) THEN 'has_transactions'
            ELSE 'deleted' END AS status
FROM k""", "accounts", "ledger", "order_accounts"))
def account_delete(spark, d):
    from tally.plans.q_forecast import _region_accounts
    acc = _acc(spark, d)
    keys = _region_accounts(spark, d, acc, ["AFRICA"]).unionByName(
        tv.order_accounts(spark, d).select("account_id"))
    status, _ = K.account_delete(acc, _led(spark, d), keys)
    return status


@register("retention_purge", "K8 D14", with_views(f"""
SELECT transaction_id FROM ledger WHERE transaction_date >= CAST({AS_OF_SQL} - INTERVAL 1000 DAY AS DATE)""",
                                                  "ledger"))
def retention_purge(spark, d):
    led = _led(spark, d)
    return K.retention_purge(led, as_of_of(led), 1000).select("transaction_id")


# ------------------------------------- K3, K4, K6, K8, I6 on stored ledgers

def _stored(spark, d, name):
    return LGR.write_snapshot(_led(spark, d), scratch_path(spark, name))


@register("update_months", "K3", with_views("""
SELECT transaction_id, CASE WHEN category = 'Rent' AND date_trunc('month', transaction_date) = DATE '1996-03-01'
                            THEN upper(description) ELSE description END AS description, category
FROM ledger""", "ledger"))
def update_months(spark, d):
    """K3 on a stored ledger: the patches touch one month, which is rewritten."""
    path = _stored(spark, d, "update-months")
    march = F.col("transaction_date").between("1996-03-01", "1996-03-31")
    patches = LGR.read_ledger(spark, path).where(march & (F.col("category") == "Rent")).select(
        "account_id", "transaction_id", F.upper("description").alias("description"), F.lit("").alias("category"))
    if RW.update_tx(spark, path, LGR.staged(patches, "patches")) != ["1996-03"]:
        raise AssertionError("other months were rewritten")
    return LGR.read_ledger(spark, path).select("transaction_id", "description", "category")


@register("delete_months", "K4", with_views("""
SELECT transaction_id, account_id FROM ledger
WHERE date_trunc('month', transaction_date) <> DATE '1997-05-01' AND NOT (direction = 'outflow' AND year(transaction_date) = 1996)
""", "ledger"))
def delete_months(spark, d):
    """K4 on a stored ledger: a whole month, and some rows of the months of a year."""
    path = _stored(spark, d, "delete-months")
    day = F.col("transaction_date")
    keys = LGR.read_ledger(spark, path).where(day.between("1997-05-01", "1997-05-31") | (
        (F.col("direction") == "outflow") & (F.year(day) == 1996))).select("account_id", "transaction_id")
    RW.delete_tx(spark, path, LGR.staged(keys, "keys"))
    return LGR.read_ledger(spark, path).select("transaction_id", "account_id")


@register("purge_months", "K8", with_views(f"""
SELECT transaction_id FROM ledger WHERE transaction_date >= CAST({AS_OF_SQL} - INTERVAL 1000 DAY AS DATE)""", "ledger"))
def purge_months(spark, d):
    """K8 on a stored ledger: old months are removed unread, the cutoff's month is rewritten."""
    path = _stored(spark, d, "purge-months")
    RW.retention_purge(spark, path, as_of_of(LGR.read_ledger(spark, path)), 1000)
    return LGR.read_ledger(spark, path).select("transaction_id")


@register("fill_months", "I6", with_views(f"SELECT transaction_id, category FROM ({_FILL_SQL})", "ledger"))
def fill_months(spark, d):
    """I6 on a stored ledger."""
    path = _stored(spark, d, "fill-months")
    RW.fill_categories(spark, path)
    return LGR.read_ledger(spark, path).select("transaction_id", "category")


# ------------------------------------------------ A1 / A4 / A5 / A10 / A11

#: The raw batch, then part of it sent again under another date with an earlier time of posting:
#: ids that the ledger holds, ids of valid rows and ids of rows that were rejected.
_FEED_SQL = "WITH feed AS (SELECT *, 0 AS src FROM raw_batch UNION ALL SELECT * REPLACE (\
'2002-02-02' AS transaction_date, '1990-01-01 00:00' AS posted_at, 'USD' AS currency, 'Office Rent' AS description), 1 AS src \
FROM raw_batch WHERE regexp_matches(posted_at, '^199[78]-0'))," + _NORM_SQL.replace(
    "currency\n  FROM raw_batch", "currency, src FROM feed")

_FIRSTS_SQL = """SELECT * FROM annot WHERE violations = ''
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY src) = 1"""
_HELD_SQL = "SELECT transaction_id FROM ledger WHERE transaction_date < DATE '1998-01-01'"

_INGEST_SQL = f"""{_FEED_SQL}
SELECT a.transaction_id, a.account_id, CAST(round_even(a.amount * a.factor, 0) AS BIGINT) AS amount,
       coalesce({rule_sql('a.description', 'a.direction')}, 'Miscellaneous') AS category, a.transaction_date
FROM ({_FIRSTS_SQL}) a
WHERE a.transaction_id NOT IN ({_HELD_SQL})"""


def _resent(spark, d):
    new = {"transaction_date": "2002-02-02", "posted_at": "1990-01-01 00:00", "currency": "USD", "description": "Office Rent"}
    return tv.raw_batch(spark, d).where(F.col("posted_at").rlike("^199[78]-0")).withColumns(
        {c: F.lit(v) for c, v in new.items()})


def _feed_csv(spark, d):
    """Both parts as files of one folder, the second after the first by name."""
    path = scratch_path(spark, "feed")
    CSV.write_csv(tv.raw_batch(spark, d).unionByName(_resent(spark, d)), path, compression="gzip")
    return path


def _raw_csv(spark, d):
    path = scratch_path(spark, "raw")
    CSV.write_csv(tv.raw_batch(spark, d), path)
    return path


def _existing(spark, d):
    return _led(spark, d).where(F.col("transaction_date") < F.lit("1998-01-01").cast("date"))


def _batch_accounts(spark, d):
    """The accounts of the raw batch, all of one user: the ownership gate runs and lets them in."""
    ids = V.strip_ws(F.col("account_id")).alias("account_id")
    return tv.raw_batch(spark, d).select(ids).distinct().withColumn("user_id", F.lit("u1"))


_INGEST_COLS = ("transaction_id", "account_id", "amount", "category", "transaction_date")


@register("ingest_run", "A1 B6 I3 C4 A4", with_views(_INGEST_SQL, "raw_batch", "ledger"))
def ingest_run(spark, d):
    """Raw CSV -> A1 -> validate -> new rows only -> categorize -> A5 and A4
    append to a fresh ledger snapshot, read back."""
    out = scratch_path(spark, "ledger")
    ING.run_ingest(spark, _feed_csv(spark, d), out, existing=_existing(spark, d), accounts=_batch_accounts(spark, d),
                   user_id="u1", backup_path=scratch_path(spark, "backup")).collect()
    return LGR.read_ledger(spark, out).select(*_INGEST_COLS)


@register("ingest_sinks", "A4 A5 C4", with_views(f"""{_FEED_SQL},
new AS (SELECT * FROM ({_FIRSTS_SQL}) WHERE transaction_id NOT IN ({_HELD_SQL}))
SELECT 'ledger' AS sink, count(*) AS n_rows, count(DISTINCT transaction_id) AS n_ids FROM new
UNION ALL SELECT 'backup', (SELECT count(*) FROM new) + count(*), (SELECT count(*) FROM new) + count(*) FROM ({_HELD_SQL})
UNION ALL SELECT 'quarantine', count(*), count(DISTINCT transaction_id) FROM annot WHERE violations <> ''""",
                                                         "raw_batch", "ledger"))
def ingest_sinks(spark, d):
    """The three sinks of a batch that was sent twice: the second time adds nothing to any."""
    src, out = _feed_csv(spark, d), scratch_path(spark, "sinks")
    for _ in range(2):
        ING.run_ingest(spark, src, f"{out}/ledger", f"{out}/quarantine", existing=_existing(spark, d),
                       backup=_existing(spark, d), backup_path=f"{out}/backup")
    counts = [spark.read.parquet(f"{out}/{sink}").agg(
        F.lit(sink).alias("sink"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("transaction_id").alias("n_ids"))
        for sink in ("ledger", "backup", "quarantine")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("daily_maintained", "D7 D10 A4", with_views(f"""{_FEED_SQL},
new AS (SELECT account_id, transaction_date, CAST(round_even(amount * factor, 0) AS BIGINT) AS amount, direction
        FROM ({_FIRSTS_SQL}) WHERE transaction_id NOT IN ({_HELD_SQL})
        UNION ALL SELECT account_id, transaction_date, amount, direction FROM ledger WHERE transaction_date < DATE '1998-01-01')
SELECT account_id, transaction_date, CAST(sum(CASE WHEN direction = 'inflow' THEN amount ELSE 0 END) AS BIGINT) AS inflow,
       CAST(sum(CASE WHEN direction = 'outflow' THEN amount ELSE 0 END) AS BIGINT) AS outflow, count(*) AS n_rows
FROM new GROUP BY ALL""", "raw_batch", "ledger"))
def daily_maintained(spark, d):
    """The account-day table of a stored ledger after a batch was added."""
    out = LGR.write_snapshot(_existing(spark, d), scratch_path(spark, "daily"))
    ING.run_ingest(spark, _feed_csv(spark, d), out, keep_daily=True)
    return DAILY.read(spark, out)


@register("ingest_gate", "C3 A4", with_views(f"""WITH {_NORM_SQL}
SELECT a.transaction_id, a.account_id, CAST(round_even(a.amount * a.factor, 0) AS BIGINT) AS amount, a.transaction_date
FROM annot a JOIN accounts o ON a.account_id = o.account_id
WHERE a.violations = '' AND o.user_id = 3""", "raw_batch", "accounts"))
def ingest_gate(spark, d):
    """A batch that names accounts of others is refused as a whole; the user's
    own rows are then let in."""
    out, accounts = scratch_path(spark, "gate"), _acc(spark, d)
    gate = {"accounts": accounts, "user_id": 3}
    try:
        ING.run_ingest(spark, _raw_csv(spark, d), out, **gate)
    except PermissionDenied:
        pass
    else:
        raise AssertionError("the foreign accounts were let in")
    own = scratch_path(spark, "raw-own")
    CSV.write_csv(J.owned_scope(tv.raw_batch(spark, d), accounts, 3), own)
    ING.run_ingest(spark, own, out, **gate)
    return LGR.read_ledger(spark, out).select("transaction_id", "account_id", "amount", "transaction_date")


@register("stream_ingest", "A11", with_views(_INGEST_SQL, "raw_batch", "ledger"))
def stream_ingest_q(spark, d):
    """The same rows through Structured Streaming: one file per micro-batch
    (availableNow), the ledger seeded with the existing rows; the rows that
    are sent again come in a later file, and a last run finds nothing new."""
    src = _raw_csv(spark, d)
    led_path = scratch_path(spark, "stream-ledger")
    LGR.write_snapshot(_existing(spark, d), led_path)
    more = {"accounts": _batch_accounts(spark, d), "user_id": "u1", "backup_path": scratch_path(spark, "stream-backup"),
            "checkpoint": scratch_path(spark, "stream-ckpt"), "max_files_per_trigger": 1}
    stream_ingest(spark, src, led_path, **more)
    CSV.write_csv(_resent(spark, d), src, mode="append")
    stream_ingest(spark, src, led_path, **more)
    stream_ingest(spark, src, led_path, **more)
    led = LGR.read_ledger(spark, led_path)
    return led.join(_existing(spark, d).select("transaction_id"), "transaction_id", "left_anti").select(*_INGEST_COLS)


@register("processed_merge", "A5 E3", with_views("""
WITH ex AS (SELECT transaction_id, description, 0 AS src FROM ledger WHERE transaction_date < DATE '1998-01-01'),
nw AS (SELECT transaction_id, upper(description) AS description, 1 AS src FROM ledger
       WHERE transaction_date >= DATE '1997-01-01'),
u AS (SELECT * FROM ex UNION ALL SELECT * FROM nw)
SELECT transaction_id, arg_min(description, src) AS description FROM u GROUP BY transaction_id""", "ledger"))
def processed_merge(spark, d):
    led = _led(spark, d)
    ex = led.where(F.col("transaction_date") < F.lit("1998-01-01").cast("date")).select("transaction_id",
                                                                                      "description")
    nw = led.where(F.col("transaction_date") >= F.lit("1997-01-01").cast("date")).select(
        "transaction_id", F.upper("description").alias("description"))
    return LGR.processed_merge(ex, nw)


@register("strict_load", "A10", with_views("""
SELECT transaction_id, account_id,
       CAST(round_even((CAST(amount AS DOUBLE) / 100.0) * (CASE WHEN direction = 'outflow' THEN 1 ELSE 100 END), 0)
            AS BIGINT) AS amount,
       CASE WHEN direction = 'outflow' THEN 'JPY' ELSE 'USD' END AS currency, transaction_date
FROM ledger""", "ledger"))
def strict_load(spark, d):
    """Seed rows rendered as strings (major units; JPY for outflows), then
    the strict typed load."""
    led = _led(spark, d)
    seed = led.select(
        "transaction_id", "account_id", "description", "category",
        (F.col("amount") / 100.0).cast("string").alias("amount"), "direction",
        F.when(F.col("direction") == "outflow", "JPY").otherwise("USD").alias("currency"),
        F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"),
        F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))
    return LGR.strict_load(seed).select("transaction_id", "account_id", "amount", "currency", "transaction_date")


# ------------------------------------------------------------ A6 / A7

@register("export_csv", "A6", with_views(f"""
SELECT {', '.join(tv_cols for tv_cols in ('transaction_id', 'account_id', 'description', 'category', 'amount',
                                          'direction', 'transaction_date', 'posted_at'))}
FROM ledger WHERE transaction_date >= DATE '2000-01-01'""", "ledger"))
def export_csv(spark, d):
    """Writes the CSV export (one directory per account) and returns the
    rows read back from the files (an empty cell is an empty description)."""
    led = _led(spark, d)
    path = scratch_path(spark, "export-csv")
    EX.export_csv(led, path, start="2000-01-01")
    types = dict(led.dtypes)
    cells = ", ".join(f"{c} string" for c in [*(c for c in LISTING_COLUMNS if c != "account_id"), "account_id"])
    back = spark.read.schema(cells).option("header", True).option("escape", '"').csv(path)  # no look at each file for its columns
    back = back.withColumn("description", F.coalesce("description", F.lit("")))
    return back.select(*[F.col(c).cast(types[c]).alias(c) for c in LISTING_COLUMNS])


@register("export_json", "A7", with_views("""
SELECT account_id, DATE '2025-06-30' AS export_date, count(*) AS transaction_count
FROM ledger GROUP BY account_id""", "ledger"))
def export_json(spark, d):
    """Writes the JSON export and returns the header lines read back."""
    return _exported_json(spark, d, "account_id string, export_date date, transaction_count bigint").where(
        F.col("transaction_count").isNotNull())


def _exported_json(spark, d, schema):
    path = scratch_path(spark, "export-json")
    EX.export_json(_led(spark, d), path, "2025-06-30", compression="gzip")
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


@register("export_json_rows", "A7", with_views(f"SELECT {', '.join(LISTING_COLUMNS)} FROM ledger", "ledger"))
def export_json_rows(spark, d):
    """The transactions of the JSON export, read back from the files."""
    types = dict(_led(spark, d).dtypes)
    rows = _exported_json(spark, d, ", ".join(f"{c} {types[c]}" for c in LISTING_COLUMNS))
    return rows.where(F.col("transaction_id").isNotNull())


@register("export_json_documents", "A7", with_views(f"""
SELECT {', '.join(LISTING_COLUMNS)}, count(*) OVER (PARTITION BY account_id) AS transaction_count, DATE '2025-06-30' AS export_date
FROM ledger UNION ALL
SELECT NULL, a.account_id, NULL, NULL, NULL, NULL, NULL, NULL, 0, DATE '2025-06-30' FROM order_accounts a""", "ledger", "order_accounts"))
def export_json_documents(spark, d):
    """The JSON export as documents with their transactions in an array, in
    parts of 100 rows, written, parsed and joined again; accounts without a
    transaction have an empty array."""
    led, path = _led(spark, d), scratch_path(spark, "export-documents")
    accounts = led.select("account_id").unionByName(tv.order_accounts(spark, d).select("account_id"))
    EX.export_json_documents(led, path, "2025-06-30", compression="gzip", part_rows=100, accounts=accounts)
    types = dict(led.dtypes)
    row = ", ".join(f"{c}: {types[c]}" for c in LISTING_COLUMNS)
    schema = (f"account_id string, export_date date, transaction_count bigint, part int, parts int, "
              f"transactions array<struct<{row}>>")
    docs = spark.read.text(path).select(F.from_json("value", schema).alias("d")).select("d.*")
    rows = docs.select("*", F.explode_outer("transactions").alias("t"))
    return rows.select(*[F.coalesce(F.col(f"t.{c}"), F.col(c)).alias(c) if c == "account_id" else F.col(f"t.{c}").alias(c)
                         for c in LISTING_COLUMNS], "transaction_count", "export_date")


# ------------------------------------------------------------ I2 / I3 / I8

def _ledger_labels(led):
    return led.where(F.col("category").isNotNull()).select("description", "category")


@register("train_text_model", "I2 D13", None)
def train_text_model(spark, d):
    """Classifier trained on documents (text -> language); the per-class
    prediction counts over the training text (one row per class)."""
    docs = tv.labelled_text(spark, d)
    model = C.train_text_model(docs)
    scored = model.transform(docs.withColumn(C.MODEL_INPUT, F.col("description")))
    return scored.groupBy(F.col("model_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@register("categorize_model", "I3 I7 I8", None)
def categorize_model(spark, d):
    """Retrain on the ledger's categorized rows, save, load back (I7 gate),
    categorize every ledger row: rules first, model for the rest."""
    led = _led(spark, d)
    path = scratch_path(spark, "categorizer")
    C.retrain_text_model(_ledger_labels(led), path)
    model = C.load_model(path)
    return C.categorize(led, model).select("transaction_id", "category", "category_source")


@register("text_model_contract", "I2", """
SELECT lang AS category, count(*) AS n, CAST(0 AS BIGINT) AS n_null, true AS accurate
FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang""")
def text_model_contract(spark, d):
    """I2 learned from four fifths of the labelled documents, applied to all:
    no row lost, none without a category, and at most half of the held-out
    errors that naming the commonest language always would make."""
    docs = C.check_labels(tv.labelled_text(spark, d)).withColumn(
        "_held_out", F.pmod(F.xxhash64("description"), F.lit(5)) == 0)
    model = C.train_text_model(docs.where(~F.col("_held_out")))
    scored = model.transform(docs.withColumn(C.MODEL_INPUT, F.col("description")))
    right = F.col("_held_out") & (F.col("model_category") == F.col("category"))
    per = scored.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("model_category").isNull()).alias("n_null"),
                                         F.count_if("_held_out").alias("held"), F.count_if(right).alias("right"))
    every = Window.partitionBy()  # one row a language
    return per.select("category", "n", "n_null",
                      (2 * F.sum(F.col("held") - F.col("right")).over(every)
                       <= F.sum("held").over(every) - F.max("held").over(every)).alias("accurate"))


@register("categorize_contract", "I3 I7 I8", with_views(f"""
SELECT transaction_id, CASE WHEN rule IS NULL THEN 'model' ELSE 'rule' END AS category_source, rule AS rule_category,
       true AS known FROM (SELECT transaction_id, {rule_sql()} AS rule FROM ledger)""", "ledger"))
def categorize_contract(spark, d):
    """I3 row by row with a model retrained, saved and loaded: what the rules
    decide is I1's, all else is one of the classes learned."""
    led, path = _led(spark, d), scratch_path(spark, "categorizer")
    C.retrain_text_model(_ledger_labels(led), path)
    model = C.load_model(path)
    out = C.categorize(led, model)
    ruled = F.col("category_source") == "rule"
    return out.select("transaction_id", "category_source", F.when(ruled, F.col("category")).alias("rule_category"),
                      (ruled | F.coalesce(F.col("category").isin(C.model_classes(model)), F.lit(False))).alias("known"))


def _accuracy(model, rows):
    scored = model.transform(rows.withColumn(C.MODEL_INPUT, F.col("description")))
    hit = (F.col("model_category") == F.col("category")).cast("int")
    return scored, F.coalesce(F.avg(F.when(F.col("_held_out"), hit)), F.lit(0.0))


def _part_labels(spark, d):
    """Part names with their type; the category needs two words at once."""
    p = tv.table(spark, d, "part")
    color, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    mixed = color.isin("red", "blue") != F.col("p_type").isin("ECONOMY", "PROMO")  # one of the two, not both
    return p.select(F.concat_ws(" ", "p_name", "p_type").alias("description"),
                    F.when(mixed, "Supplies").when(noun.isin("ring", "bolt"), "Inventory").otherwise("Marketing").alias("category"),
                    (F.col("p_partkey") % 5 == 0).alias("_held_out"))


@register("train_tree_model", "I2", """
SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_null, true AS accurate, true AS above_linear FROM part""")
def train_tree_model(spark, d):
    """I2 by boosted trees, learned from four fifths of the parts' texts and
    applied to all: 19 of 20 held-out rows right, and more than by the linear model."""
    rows = _part_labels(spark, d)
    train = rows.where(~F.col("_held_out"))
    trees, accuracy = _accuracy(C.train_tree_model(train), rows)
    linear, other = _accuracy(C.train_text_model(train), rows)
    got = trees.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("model_category").isNull()).alias("n_null"), accuracy.alias("a"))
    return got.join(linear.agg(other.alias("b")).hint("broadcast")).select(
        "n", "n_null", (F.col("a") >= 0.95).alias("accurate"), (F.col("a") > F.col("b")).alias("above_linear"))


@register("labeled_scan", "A2", with_views("""
SELECT description, category FROM ledger WHERE category IS NOT NULL""", "ledger"))
def labeled_scan(spark, d):
    """Ledger rows with a stored category written as a labelled CSV, read
    back through A2 and the label checks."""
    path = scratch_path(spark, "labels")
    CSV.write_csv(_ledger_labels(_led(spark, d)), path)
    return C.check_labels(CSV.labeled_scan(spark, path)).select("description", "category")


@register("distinct_bad_directions", "D13 B2", with_views(f"""WITH {_NORM_SQL}
SELECT DISTINCT direction FROM norm WHERE direction IS NULL OR direction NOT IN ('inflow', 'outflow')""",
                                                          "raw_batch"))
def distinct_bad_directions(spark, d):
    return A.distinct_bad_directions(V.normalize_types(tv.raw_batch(spark, d)))


_IMPORT_MODE_SQL = f"""
  SELECT b.transaction_id, b.account_id,
         CASE WHEN b.transaction_id IS NULL OR b.transaction_id = '' THEN 'error'
              WHEN l.transaction_id IS NOT NULL THEN 'duplicate'
              WHEN NOT regexp_matches(b.amount, '^\\s*[+-]?[0-9]+\\s*$') OR b.direction NOT IN ('inflow', 'outflow')
              THEN 'error' ELSE 'inserted' END AS status,
         CASE WHEN regexp_matches(b.amount, '^\\s*[+-]?[0-9]+\\s*$') THEN CAST(b.amount AS BIGINT) END AS amount
  FROM (SELECT * REPLACE (CASE WHEN direction = 'Inflow' AND starts_with(transaction_id, 'new-') THEN ''
                               ELSE transaction_id END AS transaction_id)
        FROM ({_upload_sql()})) b
  LEFT JOIN ledger l ON b.transaction_id = l.transaction_id"""


@register("import_csv_id_mode", "K2", with_views(f"SELECT * FROM ({_IMPORT_MODE_SQL})", "ledger"))
def import_csv_id_mode(spark, d):
    """The /import variant: a missing id is an error row; duplicates match
    on the id alone, whatever the account."""
    rows = _upload_rows(spark, d)
    rows = rows.withColumn("transaction_id", F.when(
        (F.col("direction") == "Inflow") & F.col("transaction_id").startswith("new-"), F.lit(""))
        .otherwise(F.col("transaction_id")))
    path = scratch_path(spark, "import")
    CSV.write_csv(rows, path, compression="gzip")
    staged = CSV.stage_csv(spark, path, scratch_path(spark, "import-staged"))
    out = K.import_csv(staged, _led(spark, d), mode="import", as_of_ts="2025-06-30 12:00:00")
    return out.select(F.coalesce(F.col("transaction_id"), F.lit("")).alias("transaction_id"), "account_id",
                      "status", "amount")


@register("csv_scan", "A1", with_views(f"""
SELECT transaction_id, account_id, description, direction, transaction_date, currency,
       try_cast({_strip('amount')} AS DOUBLE) AS amount
FROM raw_batch""", "raw_batch"))
def csv_scan(spark, d):
    """A1 alone: the raw batch as CSV files, read back with the declared
    all-string schema (amount parsed only for the comparison)."""
    raw = CSV.csv_scan(spark, _raw_csv(spark, d))
    return raw.select("transaction_id", "account_id", F.coalesce("description", F.lit("")).alias("description"),
                      "direction", "transaction_date", "currency",
                      V.strip_ws(F.col("amount")).try_cast("double").alias("amount"))


@register("value_check", "B3", with_views(f"""WITH {_NORM_SQL}
SELECT CAST(count(*) FILTER (WHERE contains(violations, 'direction_invalid')) AS BIGINT) AS direction_invalid,
       CAST(count(*) FILTER (WHERE contains(violations, 'amount_invalid')) AS BIGINT) AS amount_invalid,
       CAST(count(*) FILTER (WHERE contains(violations, 'transaction_date_invalid')) AS BIGINT) AS transaction_date_invalid,
       CAST(count(*) FILTER (WHERE contains(violations, 'currency_unsupported')) AS BIGINT) AS currency_unsupported,
       CAST(count(*) FILTER (WHERE violations = '') AS BIGINT) AS valid
FROM annot""", "raw_batch"))
def value_check(spark, d):
    """B3 in batch form: one aggregation counts each violation (the strict
    mode raises on the first non-zero count, in this order)."""
    a = V.annotate(tv.raw_batch(spark, d))
    codes = ["direction_invalid", "amount_invalid", "transaction_date_invalid", "currency_unsupported"]
    return a.agg(*[F.count(F.when(F.col("violations").contains(c), 1)).alias(c) for c in codes],
                 F.count(F.when(F.col("violations") == "", 1)).alias("valid"))


@register("ledger_append", "A4", with_views("""
SELECT transaction_id, account_id, amount, transaction_date FROM ledger""", "ledger"))
def ledger_append(spark, d):
    """A4: a snapshot holding the rows before 1998, then an append of the
    rows from 1997 on (1997 overlaps): ids already stored are skipped row by
    row, so the table ends up with every transaction exactly once."""
    led = _led(spark, d)
    path = scratch_path(spark, "append")
    LGR.write_snapshot(led.where(F.col("transaction_date") < F.lit("1998-01-01").cast("date")), path)
    batch = led.where(F.col("transaction_date") >= F.lit("1997-01-01").cast("date"))
    LGR.ledger_append(batch, LGR.read_ledger(spark, path), path)
    return LGR.read_ledger(spark, path).select("transaction_id", "account_id", "amount", "transaction_date")
