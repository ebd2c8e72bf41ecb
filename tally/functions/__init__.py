"""Column-expression helpers (all JVM-side, codegen-friendly)."""

from tally.functions.money import (  # noqa: F401
    currency_factor, from_smallest_unit, rint_bigint, signed_amount, to_smallest_unit,
)
from tally.functions.text import (  # noqa: F401
    contains_any, is_empty_description, normalize_text, rule_category, strip_ws,
)
from tally.functions.dates import period_label, week_label  # noqa: F401
