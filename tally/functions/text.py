"""Text normalisation and the keyword rule categorizer as one expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally.schema import EMPTY_DESCRIPTIONS, KEYWORD_RULES


# Every character Python's str.strip() removes (derived from str.isspace).
WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def strip_ws(c: Column) -> Column:
    """str.strip(): drop leading/trailing whitespace of any kind.

    trim() with an explicit character set is a plain codegen'd scan (no
    regex); the default trim() would drop spaces only.
    """
    return F.trim(c, F.lit(WHITESPACE))


def normalize_text(c: Column) -> Column:
    return F.lower(strip_ws(c))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def is_empty_description(description: Column) -> Column:
    return description.isNull() | normalize_text(description).isin(*EMPTY_DESCRIPTIONS)


def rule_category(description: Column, direction: Column, norm: Column | None = None) -> Column:
    """First matching keyword category; empty text falls back by direction; else null.

    One CASE expression generated from the rule table: no UDF, stays in
    codegen.  Pass ``norm`` (a column already holding normalize_text of the
    description, see ``with_normalized``) to normalise once per row instead
    of once per keyword test.
    """
    norm = normalize_text(description) if norm is None else norm
    expr = F.when(description.isNull() | norm.isin(*EMPTY_DESCRIPTIONS),
                  F.when(direction == F.lit("inflow"), F.lit("Revenue"))
                  .otherwise(F.lit("Miscellaneous")))
    for category, words in KEYWORD_RULES:
        expr = expr.when(contains_any(norm, words), F.lit(category))
    return expr.otherwise(F.lit(None).cast("string"))


NORM_COL = "_desc_norm"


def with_normalized(df, description: str = "description"):
    """Add the normalised description as its own projection (kept separate
    by the optimizer because the rule CASE reads it many times)."""
    return df.withColumn(NORM_COL, normalize_text(F.col(description)))


def rule_category_col() -> Column:
    """rule_category over a frame prepared by ``with_normalized``."""
    return rule_category(F.col("description"), F.col("direction"), F.col(NORM_COL))
