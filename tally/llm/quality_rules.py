"""Quality rules: a table of thresholds compiled into one Spark projection.

``measures`` counts, ``RULES`` bounds ratios of the counts, and ``verdict``
turns the table into one boolean expression.  Spark's own functions only; a
document never meets another, so there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import BLANKS, WORD

SYMBOL = r"[#*$%&|<>]"
#: The commonest function words of the four languages.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "with", "as", "by", "this", "be",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
    "le", "la", "les", "et", "des", "de", "un", "une", "du", "que", "est", "en", "dans", "pour", "par", "au", "sur",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "su", "al", "lo", "no", "para",
]


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high`` (a ratio over 0 is 0)."""
    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


RULES = [
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.2),
    Rule("upper_case", "n_upper", "n_chars", high=0.4),
    Rule("exclamations", "n_exclaims", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
]


def _windows(words: Column, n: int = 3) -> Column:
    """The hash of each n-word window."""
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts of each row's whole text (null: no words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    got = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    has_word = lambda line: F.length(F.translate(line, BLANKS, "")) > 0
    got = got.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"),
                     F.filter(F.split("text", "\n", -1), has_word).alias("lines"))
    got = got.select(
        "doc_id", "words", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("bigint").alias("n_exclaims"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"))
    n_stop = F.size(F.filter("words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("bigint")
    got = got.select("*", n_stop.alias("n_stop_words"), _windows(F.col("words")).alias("hashes")).drop("words")
    # only texts that repeat a window have theirs sorted with their places
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    got = got.withColumn("placed", F.when(repeats, F.array_sort(F.transform(
        "hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("hashes")
    at = lambda i: F.get("placed", i)["h"]
    places = F.filter(F.transform(F.col("placed"), lambda p, i: F.when(
        (p["h"] == at(i - 1)) | (p["h"] == at(i + 1)), p["i"])), lambda i: i.isNotNull())
    got = got.withColumn("places", F.sort_array(places)).drop("placed")
    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                          lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
                          lambda a: a["n"])
    return got.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("places")


def verdict(rules: list[Rule] = RULES) -> Column:
    """The table of thresholds as one expression."""
    out = F.lit(True)
    for r in rules:
        ratio = F.when(F.col(r.denominator) > 0, F.col(r.numerator) / F.col(r.denominator)).otherwise(F.lit(0.0))
        if r.low is not None:
            out = out & (ratio >= r.low)
        if r.high is not None:
            out = out & (ratio <= r.high)
    return out


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """All measures with ``base_failed`` (fewer than 50 words, or over half of
    them in repeated 3-word windows) and ``kept`` (the base and every rule hold).

    Null and empty texts have no words and fail the base; rows are judged one
    by one, so repeated rows give repeated results; an empty table gives an
    empty result; ids may be null; other columns are not read.
    """
    got = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def _oracle_verdict(rules: list[Rule]) -> str:
    tests = []
    for r in rules:
        ratio = f"(CASE WHEN {r.denominator} > 0 THEN CAST({r.numerator} AS DOUBLE) / {r.denominator} ELSE 0 END)"
        tests += [f"{ratio} >= {r.low}"] * (r.low is not None) + [f"{ratio} <= {r.high}"] * (r.high is not None)
    return " AND ".join(tests)


#: The same with unnested windows, for DuckDB (ids are unique).
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
three AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w),
often AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM three) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often CROSS JOIN range(0, 3) t(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS word_sum,
         CAST(len(regexp_extract_all(text, '{SYMBOL}')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         length(text) AS n_chars, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper,
         len(regexp_extract_all(text, '!')) AS n_exclaims, len(lines) AS n_lines,
         len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
f AS (SELECT *, coalesce(word_sum, 0) AS word_chars,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_oracle_verdict(RULES)} AS kept FROM f
"""
