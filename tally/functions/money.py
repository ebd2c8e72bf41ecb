"""Money in exact integer smallest units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally.schema import CURRENCY_DECIMALS


def _factor_map() -> Column:
    pairs = []
    for code, decimals in CURRENCY_DECIMALS.items():
        pairs += [F.lit(code), F.lit(10 ** decimals).cast("bigint")]
    return F.create_map(*pairs)


def currency_factor(currency: Column) -> Column:
    """10^decimals for a known currency, null for an unknown one."""
    return F.try_element_at(_factor_map(), currency)


def rint_bigint(x: Column) -> Column:
    """Round half to even, then to bigint (Python's round() on floats);
    out of the bigint range -> null."""
    return F.rint(x).try_cast("bigint")


def to_smallest_unit(amount: Column, currency: Column) -> Column:
    """Major units (double) -> smallest units (bigint); null if unknown currency."""
    return rint_bigint(amount * currency_factor(currency))


def from_smallest_unit(amount: Column, currency: Column) -> Column:
    """Smallest units -> major units as double."""
    return amount.cast("double") / currency_factor(currency).cast("double")


def signed_amount(amount: Column, direction: Column) -> Column:
    """+amount for inflow, -amount otherwise."""
    return F.when(direction == F.lit("inflow"), amount).otherwise(-amount)
