"""Table maintenance as batch jobs: each takes a DataFrame of requests
(many rows, many accounts) and the current table, and returns the new
table (or a classified batch).  Writers put the result in a new snapshot
directory (``tally.sources.ledger``); nothing is updated in place.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.errors import ValidationError
from tally.functions.constraints import account_constraints, tx_constraints
from tally.functions.text import rule_category_col, with_normalized
from tally.operators.validate import default_fill
from tally.schema import ALLOWED_DIRECTIONS, BROKEN, LEDGER_COLUMNS
from tally.sources.ledger import staged

STATUSES = ("inserted", "duplicate", "error")


def _nonempty(c: str):
    return F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c))


def _resolved_category():
    """I4 over a frame prepared by ``with_normalized``."""
    return F.coalesce(_nonempty("category"), rule_category_col(), F.lit("Miscellaneous"))


def classify_batch(batch: DataFrame, ledger: DataFrame, key_mode: str = "account", order: str = "_row") -> DataFrame:
    """Status of each incoming row: inserted / duplicate / error.

    ``batch`` needs transaction_id, account_id, a numeric ``order`` column and
    a boolean ``_valid``.  Checks run in this order, per row:
      1. the key already exists in the ledger -> duplicate.  key_mode
         'account' matches (account_id, id); an id held by another account
         is an error (primary key).  key_mode 'id' matches on id alone.
      2. within the batch, the first *valid* copy of an id is inserted;
         later copies are duplicates (same account) or errors (other
         account, 'account' mode); earlier copies were invalid -> error.
    The first valid copy depends on the batch alone (an id in the ledger
    settles all its rows), so it is one hash aggregate over numbers and the
    ledger's ids are joined once.  Rows without an id get a key of their own:
    they match nothing and spread over the joins' partitions.
    """
    has_id = _nonempty("transaction_id").isNotNull()
    # the last one makes the key not nullable: Spark then adds no filter on it, which would write out all of its terms at the scan
    b = batch.withColumn("_key", F.coalesce(
        _nonempty("transaction_id"), F.concat(F.lit("\0"), F.col(order).cast("string")), F.lit("\0")))
    account = F.xxhash64("account_id")
    # a condition in the aggregate: a filter would be pushed down to the scan with every check and id written out again
    at = F.when(F.col("_valid") & has_id, F.col(order))
    win = (b.groupBy("_key").agg(F.min(at).alias("_first"), F.min_by(account, at).alias("_first_account"))
           .where(F.col("_first").isNotNull()))
    held = ledger.select(F.col("transaction_id").alias("_key"), F.col("account_id").alias("_held_by"))
    b = b.join(win, "_key", "left").join(held, "_key", "left")
    by_account = key_mode == "account"
    same_holder = F.col("_held_by").eqNullSafe(F.col("account_id")) if by_account else F.lit(True)
    same_account = (F.col("_first_account") == account) if by_account else F.lit(True)
    status = (F.when(F.col("_held_by").isNotNull(), F.when(same_holder, "duplicate").otherwise("error"))
              .when(F.col("_first").isNull(), "error")
              .when(F.col(order) == F.col("_first"), "inserted")
              .when((F.col(order) > F.col("_first")) & same_account, "duplicate")
              .otherwise("error"))
    return b.withColumn("status", status).drop("_key", "_first", "_first_account", "_held_by")


def insert_tx(requests: DataFrame, ledger: DataFrame, accounts: DataFrame, as_of_ts,
              mode: str = "bulk", batch_id: str = "") -> DataFrame:
    """K1: API inserts (amount already in smallest units).

    mode 'bulk' skips duplicates (status 'duplicate'); mode 'single' treats
    a duplicate as an error, as a one-row create does.

    Missing ids get a deterministic generated id (``batch_id`` and the time keep
    batches apart); B7 violations and accounts that don't exist make a row an
    error; duplicates on (account_id, id) are skipped; the category is
    resolved (I4); currency comes from the account; posted_at defaults to
    ``as_of_ts``.  Returns the classified batch (ledger columns + status).
    """
    # the whole digest over batch, row and values: ids of different rows stay different
    gen = F.concat(F.lit("tx_bulk_"), F.sha2(F.concat_ws(
        "|", F.lit(str(batch_id)), F.lit(as_of_ts).cast("string"), F.col("_row").cast("string"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
          ("account_id", "description", "amount", "direction", "transaction_date")]), 256))
    # the constraints are on the request's own id; a generated one may be longer
    r = requests.withColumn("_tx_viol", tx_constraints())
    r = r.withColumn("transaction_id", F.coalesce(_nonempty("transaction_id"), gen))
    acc = accounts.select("account_id", F.col("currency").alias("_acct_currency"), F.lit(True).alias("_known"))
    r = r.join(acc, "account_id", "left")
    r = r.withColumn("_viol", F.concat_ws(",", F.when(F.col("_tx_viol") != "", F.col("_tx_viol")),
                                          F.when(F.col("_known").isNull(), F.lit("account_unknown"))))
    r = r.withColumn("_valid", F.col("_viol") == "")
    c = classify_batch(r, ledger, "account")
    c = c.withColumn("status", F.when(~F.col("_valid"), "error").otherwise(F.col("status")))
    if mode == "single":
        c = c.withColumn("status", F.when(F.col("status") == "duplicate", "error").otherwise(F.col("status")))
    return (with_normalized(c)
            .select("transaction_id", "account_id", "description", _resolved_category().alias("category"),
                    F.col("amount").cast("bigint").alias("amount"), "direction",
                    F.col("_acct_currency").alias("currency"),
                    F.col("transaction_date").try_cast("date").alias("transaction_date"),
                    F.coalesce(F.col("posted_at").try_cast("timestamp_ntz"),
                               F.lit(as_of_ts).cast("timestamp_ntz")).alias("posted_at"),
                    "_row", "status", F.col("_viol").alias("errors")))


def import_csv(rows: DataFrame, ledger: DataFrame, mode: str = "upload", as_of_ts=None,
               accounts: DataFrame | None = None) -> DataFrame:
    """K2: CSV rows (all strings, with ``_row`` = 0-based index in the file
    and ``row_number`` = index + 2) -> classified rows.

    Absent columns get their defaults (B15; ``as_of_ts`` stands in for now).
    upload: a missing id becomes 'tx_csv_<index>', with the file's hash in it
    where the rows name their file, and duplicates match on (account_id, id).
    import: a missing id is an error, duplicates match on id.  Rows of several
    files count in the order of the files' names.  amount must be an integer
    in smallest units ('3.5' is an error row); direction must be exactly
    'inflow' or 'outflow', and the date a date.  With ``accounts`` an unknown
    account is an error and the currency is the account's; else it is null.
    ``errors`` holds the codes of an error row.
    """
    now = as_of_ts if as_of_ts is not None else dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    rows = default_fill(rows, str(now), mode)
    if "category" not in rows.columns:
        rows = rows.withColumn("category", F.lit(""))
    order = "_seq" if "_seq" in rows.columns else "_row"
    codes = [F.when(F.col(BROKEN).isNotNull(), "record_broken")] if BROKEN in rows.columns else []
    if mode == "upload":
        file = [F.sha2("_file", 256)] if "_file" in rows.columns else []
        made = F.concat_ws("_", F.lit("tx_csv"), *file, F.col("_row").cast("string"))
        rows = rows.withColumn("transaction_id", F.coalesce(_nonempty("transaction_id"), made))
    else:
        codes.append(F.when(_nonempty("transaction_id").isNull(), "transaction_id_missing"))
    # int() semantics: optional sign and digits only ('3.5' is an error).
    amount = F.when(F.col("amount").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.col("amount").try_cast("bigint"))
    known = F.lit(None).cast("string")
    if accounts is not None:
        rows = rows.join(accounts.select("account_id", F.col("currency").alias("_acct_currency"),
                                         F.lit(True).alias("_known")), "account_id", "left")
        known = F.col("_acct_currency")
        codes.append(F.when(F.col("_known").isNull(), "account_unknown"))
    codes += [F.when(F.col("_amount").isNull(), "amount_invalid"),
              F.when(~F.coalesce(F.col("direction").isin(*ALLOWED_DIRECTIONS), F.lit(False)), "direction_invalid"),
              F.when(F.col("transaction_date").try_cast("date").isNull(), "transaction_date_invalid")]
    r = rows.withColumn("_amount", amount).withColumn("_codes", F.concat_ws(",", *codes))
    r = r.withColumn("_valid", F.col("_codes") == "")
    c = with_normalized(classify_batch(r, ledger, "account" if mode == "upload" else "id", order))
    errors = F.when(F.col("status") != "error", "").when(F.col("_codes") != "", F.col("_codes")).otherwise(
        "transaction_id_of_other_account")
    # Spark reads an empty CSV cell as null; the ledger stores ''.
    return c.select("transaction_id", "account_id",
                    F.coalesce(F.col("description"), F.lit("")).alias("description"),
                    _resolved_category().alias("category"),
                    F.col("_amount").alias("amount"), "direction", known.alias("currency"),
                    F.col("transaction_date").try_cast("date").alias("transaction_date"),
                    F.coalesce(F.col("posted_at").try_cast("timestamp_ntz"),
                               F.lit(str(now)).cast("timestamp_ntz")).alias("posted_at"),
                    *(["_file"] if "_file" in rows.columns else []),
                    "_row", (F.col("_row") + 2).alias("row_number"), "status", errors.alias("errors"))


def import_errors(classified: DataFrame) -> DataFrame:
    """K2: the error rows of an import as (file, row, error)."""
    file = [F.col("_file").alias("file")] if "_file" in classified.columns else []
    return classified.where(F.col("status") == "error").select(
        *file, F.col("row_number").alias("row"), F.col("errors").alias("error"))


def inserted_rows(classified: DataFrame) -> DataFrame:
    """Ledger-shaped rows of a classified batch that are to be appended."""
    c = classified.where(F.col("status") == "inserted")
    cols = [x for x in LEDGER_COLUMNS if x in c.columns]
    return c.select(*cols)


def _last_values(patches: DataFrame, keys: list[str], values: dict) -> DataFrame:
    """One row per key with the last non-null of each value: by ``_row`` where
    the patches have it, else by the value, so that reruns agree."""
    one = patches.select(*keys, *[v.alias(n) for n, v in values.items()],
                         F.col("_row").alias("_at") if "_row" in patches.columns else F.lit(0).alias("_at"))
    return one.groupBy(*keys).agg(*[F.max(F.when(F.col(n).isNotNull(), F.struct("_at", n)))[n].alias(n) for n in values])


def update_tx(ledger: DataFrame, patches: DataFrame) -> DataFrame:
    """K3: description / category replaced where the patch value is
    non-empty, else kept.  Patches match on (account_id, transaction_id);
    several patches of a row apply in the order of ``_row``."""
    p = _last_values(patches, ["account_id", "transaction_id"],
                     {"_new_desc": _nonempty("description"), "_new_cat": _nonempty("category")})
    j = ledger.join(p, ["account_id", "transaction_id"], "left")
    return j.select(*[F.coalesce("_new_desc", "description").alias("description") if c == "description"
                      else F.coalesce("_new_cat", "category").alias("category") if c == "category"
                      else F.col(c) for c in ledger.columns])


def not_found(ledger: DataFrame, keys: DataFrame, on=("account_id", "transaction_id")) -> DataFrame:
    """K3 / K4 'not found': requested keys with no ledger row."""
    return keys.select(*on).join(ledger.select(*on), list(on), "left_anti")


def delete_tx(ledger: DataFrame, keys: DataFrame, on=("account_id", "transaction_id")) -> DataFrame:
    """K4: ledger without the given keys."""
    return ledger.join(keys.select(*on), list(on), "left_anti")


def account_create(accounts: DataFrame, requests: DataFrame, as_of_date) -> DataFrame:
    """K5: classified account requests.  B8 violations -> error; an id or
    number already taken (in the table or by an account created earlier in the
    batch) -> duplicate.  Accepted rows get last_updated = as_of.

    Requests apply in the order of ``_row``, which must differ from row to row;
    one without an account_id is an error, one that is turned down blocks no
    other.  Each round creates the requests that are first with both their id
    and their number, and turns down those that share either; it repeats for
    what is left, once for each link of the longest chain of such clashes.
    """
    spark = requests.sparkSession
    taken_id = accounts.select("account_id", F.lit(True).alias("_id_taken"))
    taken_no = accounts.select("account_number", F.lit(True).alias("_no_taken"))
    if not requests.groupBy("_row").count().where("count > 1 OR _row IS NULL").isEmpty():
        raise ValidationError("Account requests need a _row of their own each")
    codes = F.concat_ws(",", F.when(_nonempty("account_id").isNull(), "account_id_missing"),
                        F.when(account_constraints() != "", account_constraints()))
    r = (requests.withColumn("_viol", codes)
         .join(taken_id, "account_id", "left").join(taken_no, "account_number", "left"))
    in_table = F.col("_id_taken").isNotNull() | F.col("_no_taken").isNotNull()
    left = staged(r.where(~in_table & (F.col("_viol") == "")).select("_row", "account_id", "account_number"), "requests")
    created = spark.createDataFrame([], left.schema).select("_row")
    while not left.isEmpty():
        first_id = left.groupBy("account_id").agg(F.min("_row").alias("_by_id"))
        first_no = left.groupBy("account_number").agg(F.min("_row").alias("_by_no"))
        new = staged(left.join(first_id, "account_id").join(first_no, "account_number").where(
            (F.col("_row") == F.col("_by_id")) & (F.col("_row") == F.col("_by_no")))
            .select("_row", "account_id", "account_number"), "requests")
        if new.isEmpty():  # the first request left always comes first with its id and number
            raise RuntimeError("no request could be decided")
        created = created.unionByName(new.select("_row"))
        left = staged(left.join(new.select("account_id"), "account_id", "left_anti")
                       .join(new.select("account_number"), "account_number", "left_anti"), "requests")
    r = r.join(created.withColumn("_created", F.lit(True)), "_row", "left")
    status = (F.when(in_table, "duplicate")
              .when(F.col("_viol") != "", "error")
              .when(F.col("_created"), "created")
              .otherwise("duplicate"))
    return r.select("account_id", "user_id", "account_number", "starting_balance", "currency",
                    F.lit(as_of_date).cast("date").alias("last_updated"), "_row",
                    status.alias("status"), F.col("_viol").alias("errors"))


def accounts_after_create(accounts: DataFrame, classified: DataFrame) -> DataFrame:
    new = classified.where(F.col("status") == "created").select(*accounts.columns)
    return accounts.unionByName(new)


def account_update(accounts: DataFrame, patches: DataFrame, as_of_date) -> DataFrame:
    """K6: starting_balance / currency replaced when given (null keeps the
    old value); patched rows get last_updated = as_of.  Several patches of an
    account apply in the order of ``_row``."""
    p = _last_values(patches, ["account_id"], {"_nb": F.col("starting_balance"), "_nc": F.col("currency"),
                                               "_hit": F.lit(True)})
    j = accounts.join(p, "account_id", "left")
    return j.select(
        *[F.coalesce("_nb", "starting_balance").alias(c) if c == "starting_balance"
          else F.coalesce("_nc", "currency").alias(c) if c == "currency"
          else F.when(F.col("_hit"), F.lit(as_of_date).cast("date")).otherwise(F.col(c)).alias(c)
          if c == "last_updated" else F.col(c) for c in accounts.columns])


def account_delete(accounts: DataFrame, ledger: DataFrame, keys: DataFrame, confirm: bool = True):
    """K7: per requested account: deleted / not_found / has_transactions
    (the ledger references it, so the foreign key refuses) / not_confirmed.
    Returns (status frame, accounts after deletion)."""
    k = keys.select("account_id").distinct()
    used = ledger.select("account_id").distinct().withColumn("_used", F.lit(True))
    exist = accounts.select("account_id").withColumn("_exists", F.lit(True))
    s = k.join(exist, "account_id", "left").join(used, "account_id", "left")
    status = (F.when(F.col("_exists").isNull(), "not_found")
              .when(F.lit(not confirm), "not_confirmed")
              .when(F.col("_used").isNotNull(), "has_transactions")
              .otherwise("deleted"))
    st = s.select("account_id", status.alias("status"))
    gone = st.where(F.col("status") == "deleted").select("account_id")
    return st, accounts.join(gone, "account_id", "left_anti")


def retention_purge(ledger: DataFrame, as_of, days: int, dry_run: bool = False) -> DataFrame:
    """K8: drop rows dated strictly before as_of - days (dry run: keep all)."""
    if dry_run:
        return ledger
    d = as_of.cast("date") if hasattr(as_of, "cast") else F.lit(as_of).cast("date")
    return ledger.where(F.col("transaction_date") >= F.date_sub(d, days))
