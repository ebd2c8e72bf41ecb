"""Line dedup by winnowing over line hashes.  DataFrame operations only.

A run of lines counts as repeated if it has at least ``min_lines`` lines or
``min_words`` words and stood earlier (a smaller document id, or further up in
the same document).  Later repeats are deleted, the first occurrence stays.

Sequence: a document's lines that are not blank, each as two 64-bit hashes.
Windows: from every line the shortest qualifying run that starts there, and the
shortest one that ends there.  Fingerprints: each window's smallest line hash
with its place.  Any repeated run holds a whole window, and equal windows have
equal minima, so every repeated run shares a fingerprint: only windows around
fingerprints that stand at two places or more go on.  There the whole windows
are compared with the first place that holds them; forward windows extend a
match to the right and backward windows to the left, so their union is each
match at its full length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import BLANKS, fresh, stage

PLACE = "decimal(38,0)"


def _place(doc_id: Column, line: Column) -> Column:
    """A place as one exact number: ids first, then lines; null ids last."""
    last = F.lit((1 << 63) - 1).cast(PLACE)
    return F.coalesce(doc_id.cast(PLACE), last) * F.lit(10_000_000_000).cast(PLACE) + line.cast(PLACE)


def _spans(n: int, min_lines: int, min_words: int) -> Column:
    """The windows of ``n`` lines: runs that qualify, while the run without
    their last line or the run without their first line does not."""
    line = lambda i, k, field: F.get(F.col("seq"), i + k)[field]

    def words(i, a, b):
        return sum((line(i, k, "words") for k in range(a + 1, b)), line(i, a, "words"))

    def one(x, i):
        low = F.least(*[line(i, k, "h1") for k in range(n)]) if n > 1 else x["h1"]
        at = F.coalesce(*[F.when(line(i, k, "h1") == low, line(i, k, "line")) for k in range(n)])
        return F.struct(x["line"].alias("first"), line(i, n - 1, "line").alias("last"), low.alias("print"), at.alias("at"),
                        F.xxhash64(F.lit(n), *[line(i, k, "h1") for k in range(n)]).alias("key1"),
                        F.xxhash64(F.lit(-n), *[line(i, k, "h2") for k in range(n)]).alias("key2"))

    def wanted(x, i):
        enough = F.lit(True) if n == min_lines else words(i, 0, n) >= min_words
        if n > 1:
            enough = enough & ((words(i, 0, n - 1) < min_words) | (words(i, 1, n) < min_words))
        return (i + n <= F.size("seq")) & enough

    return F.filter(F.transform("seq", lambda x, i: F.when(wanted(x, i), one(x, i))), lambda x: x.isNotNull())


def windows(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_words: int) -> DataFrame:
    """One row per document: ``doc_id, text_hash, windows`` (windows: first and
    last line, smallest hash and its line, two hashes of the whole)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
    blanks = lambda x: F.length(x) - F.length(F.translate(x, BLANKS, ""))
    seq = F.filter(F.transform("lines", lambda x, i: F.struct(
        i.alias("line"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"),
        F.when(F.length(x) > blanks(x), blanks(F.trim(x)) + 1).alias("words"))), lambda x: x["words"].isNotNull())
    rows = rows.select("doc_id", "text_hash", seq.alias("seq"))
    every = F.concat(*[_spans(n, min_lines, min_words) for n in range(1, min_lines + 1)])
    # no filter here: pushed down, it would evaluate these expressions again for each use of seq
    return rows.select("doc_id", "text_hash", every.alias("windows"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3,
                  min_words: int = 50) -> DataFrame:
    """``doc_id, text_hash, first, last, place``: windows (first and last line,
    from 0) that stood earlier, and where (document id * 10**10 + line)."""
    own = stage(windows(docs, id_col, text_col, min_lines, min_words), "line-windows")
    prints = F.array_distinct(F.transform("windows", lambda w: F.struct(w["print"], w["at"])))
    shared = own.select(F.explode(prints).alias("p")).groupBy(F.col("p.print").alias("print")).agg(F.count("*").alias("n")).where("n > 1").select("print")
    each = (own.select("doc_id", "text_hash", F.explode("windows").alias("w"))
            .select("doc_id", "text_hash", "w.first", "w.last", "w.print", "w.key1", "w.key2"))
    each = each.join(shared, "print", "left_semi").withColumn("place", _place(F.col("doc_id"), F.col("first")))
    origin = (each.groupBy("key1", "key2").agg(F.min("place").alias("origin"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    return (each.join(origin, ["key1", "key2"]).where("place > origin")
            .select("doc_id", "text_hash", "first", "last", F.col("origin").alias("place")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3,
                min_words: int = 50) -> DataFrame:
    """The rows of ``docs`` with later repeats cut out of the text, and the
    columns ``n_lines`` and ``n_removed`` (columns of these names are replaced).

    Lines end at ``\\n``; a line's words are its blanks between words plus one;
    blank lines neither match nor separate, and go with a run that they stand
    in.  Null texts stay null (0 lines) and empty ones empty (1 line).  Rows
    that share an id count as one place: equal lines at equal line numbers of
    two such rows are no repeats of each other, so repeated rows stay alike.
    Null ids come last.  Empty tables give an empty result.
    """
    runs = repeated_runs(docs, id_col, text_col, min_lines, min_words)
    cuts = (runs.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))
            .select(F.col("doc_id").alias("__cut_id"), F.col("text_hash").alias("__cut_hash"), F.array_distinct(
                F.flatten(F.transform("cuts", lambda c: F.sequence(c["first"], c["last"])))).alias("__cut")))
    drop = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    docs = docs.drop(*drop)
    key, lines = fresh(docs, "__row_hash"), fresh(docs, "__lines")
    out = docs.withColumn(key, F.xxhash64(F.col(text_col))).alias("d").join(
        cuts, F.col(f"d.`{id_col}`").cast("bigint").eqNullSafe(F.col("__cut_id"))
        & (F.col(f"d.`{key}`") == F.col("__cut_hash")), "left")
    out = out.withColumn(lines, F.when(F.col("__cut").isNotNull(), F.split(F.col(f"d.`{text_col}`"), "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__cut"))
    text = F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(F.array_join(
        F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n"))
    breaks = F.length(text_col) - F.length(F.translate(F.col(text_col), "\n", "")) + 1
    own = [text.alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    return out.select(*own, F.coalesce(F.when(F.col(text_col).isNotNull(), breaks), F.lit(0)).cast("bigint").alias("n_lines"),
                      F.coalesce(F.size("__cut"), F.lit(0)).cast("bigint").alias("n_removed"))


#: The same by plain comparison of all windows, for DuckDB.
ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
seq AS (
  SELECT doc_id, pos, line, 1 + length(trim(line, ' ')) - length(translate(trim(line, ' '),
           ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM lines WHERE translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> ''),
near AS (
  SELECT *, lead(line) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(pos) OVER w AS a1, lead(pos, 2) OVER w AS a2,
         coalesce(lead(words) OVER w, 0) AS w1, coalesce(lead(words, 2) OVER w, 0) AS w2
  FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (
  SELECT doc_id, pos AS first, pos AS last, [line] AS body FROM near WHERE words >= 50
  UNION ALL SELECT doc_id, pos, a1, [line, l1] FROM near WHERE l1 IS NOT NULL AND words + w1 >= 50
  UNION ALL SELECT doc_id, pos, a2, [line, l1, l2] FROM near WHERE l2 IS NOT NULL),
later AS (
  SELECT doc_id, first, last FROM (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS k FROM spans) WHERE k > 1),
cut AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN later r
        ON l.doc_id = r.doc_id AND l.pos BETWEEN r.first AND r.last)
SELECT d.doc_id, count(l.pos) AS n_lines, count(c.pos) AS n_removed,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '')) AS clean_md5
FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.pos = l.pos
GROUP BY d.doc_id
"""
