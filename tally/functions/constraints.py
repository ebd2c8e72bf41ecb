"""Row constraints as a comma-separated string of violation codes ('' = valid).

A string built by concat_ws over CASE expressions stays inside whole-stage
codegen; an array filtered by a lambda (array_compact) would not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally.schema import ALLOWED_DIRECTIONS, CATEGORIES, DESCRIPTION_MAX, TRANSACTION_ID_MAX


def violations(checks: list[tuple[Column, str]]) -> Column:
    """Codes whose condition is true, in check order; null conditions count
    as false.  concat_ws skips the nulls of the conditions that are false."""
    return F.concat_ws(",", *[F.when(cond, F.lit(code)) for cond, code in checks])


def tx_constraints() -> Column:
    """Constraints of an API-created transaction (amount in smallest units).

    The date pattern follows the request validator's regex semantics:
    a digit is any Unicode decimal digit and the match must end at the end
    of the text (``\\z``: Java's ``$`` would also accept a trailing newline).
    """
    d, c, a = F.col("description"), F.col("category"), F.col("amount")
    return violations([
        (F.col("transaction_id").isNotNull() & (F.length("transaction_id") > TRANSACTION_ID_MAX),
         "transaction_id_too_long"),
        (d.isNull() | (F.length(d) < 1) | (F.length(d) > DESCRIPTION_MAX), "description_length"),
        (c.isNotNull() & ~c.isin(*CATEGORIES), "category_unknown"),
        (a.isNull() | (a <= 0), "amount_not_positive"),
        (F.col("direction").isNull() | ~F.col("direction").isin(*ALLOWED_DIRECTIONS),
         "direction_invalid"),
        (F.col("transaction_date").isNull()
         | ~F.col("transaction_date").rlike(r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}\z"), "date_format"),
    ])


def account_constraints() -> Column:
    """API rules and the table rule, reported as separate codes.

    number: 5-20 characters as given; letters or digits (any script) once
    spaces are removed; the table also needs exactly 10 digits.  balance:
    > 0.  currency: 3 characters, all cased ones upper case and at least one
    cased (str.isupper()).
    """
    n, c = F.col("account_number"), F.col("currency")
    return violations([
        (n.isNull() | (F.length(n) < 5) | (F.length(n) > 20), "number_length"),
        (n.isNotNull() & ~F.replace(n, F.lit(" "), F.lit("")).rlike(r"^[\p{L}\p{N}]+$"), "number_not_alnum"),
        (n.isNull() | ~n.rlike(r"^\d{10}$"), "number_not_10_digits"),
        (F.col("starting_balance").isNull() | (F.col("starting_balance") <= 0), "balance_not_positive"),
        (c.isNull() | (F.length(c) != 3) | (c != F.upper(c)) | (c == F.lower(c)), "currency_format"),
    ])


def label_constraints() -> Column:
    """Training rows: description 1-500 chars, category one of the eight."""
    d = F.col("description")
    return violations([
        (d.isNull() | (F.length(d) < 1) | (F.length(d) > DESCRIPTION_MAX), "description_length"),
        (F.col("category").isNull() | ~F.col("category").isin(*CATEGORIES), "category_unknown"),
    ])
