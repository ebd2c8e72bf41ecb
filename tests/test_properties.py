"""Brute-force property checks: the Spark expressions against plain-Python
statements of the same rules, on generated inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tally.functions.money import to_smallest_unit
from tally.functions.text import rule_category
from tally.schema import CURRENCY_DECIMALS, EMPTY_DESCRIPTIONS, KEYWORD_RULES

WORDS = [w for _, ws in KEYWORD_RULES for w in ws] + ["rental", "current", "misc", "n/a", "-", "nil", "x"]
PADS = ["", " ", "\t", " ", "\n "]


def python_rule(description, direction):
    if not description or description.strip().lower() in EMPTY_DESCRIPTIONS:
        return "Revenue" if direction == "inflow" else "Miscellaneous"
    d = description.strip().lower()
    for cat, words in KEYWORD_RULES:
        if any(w in d for w in words):
            return cat
    return None


descriptions = st.one_of(
    st.none(),
    st.builds(lambda pre, ws, post, upper: pre + (" ".join(ws).upper() if upper else " ".join(ws)) + post,
              st.sampled_from(PADS), st.lists(st.sampled_from(WORDS), max_size=4), st.sampled_from(PADS),
              st.booleans()),
    st.text(max_size=12),
)


@settings(max_examples=3, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(descriptions, st.sampled_from(["inflow", "outflow"])), min_size=300, max_size=300))
def test_rule_category_matches_python(spark, rows):
    df = spark.createDataFrame([(i, d, r) for i, (d, r) in enumerate(rows)], "i long, d string, r string")
    got = {x.i: x.c for x in df.select("i", rule_category(F.col("d"), F.col("r")).alias("c")).collect()}
    bad = [(d, r, got[i], python_rule(d, r)) for i, (d, r) in enumerate(rows) if got[i] != python_rule(d, r)]
    assert not bad, bad[:5]


amounts = st.one_of(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False),
                    st.integers(-10**6, 10**6).map(lambda n: n / 8),  # exact halves and quarters
                    st.decimals(min_value=-10**6, max_value=10**6, places=3).map(float))


@settings(max_examples=3, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(amounts, st.sampled_from(sorted(CURRENCY_DECIMALS))), min_size=300, max_size=300))
def test_smallest_unit_matches_python_round(spark, rows):
    df = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(rows)], "i long, a double, c string")
    got = {x.i: x.v for x in df.select("i", to_smallest_unit(F.col("a"), F.col("c")).alias("v")).collect()}
    for i, (a, c) in enumerate(rows):
        assert got[i] == int(round(a * 10 ** CURRENCY_DECIMALS[c])), (a, c, got[i])
