"""Stupid-backoff language-model scores, computed relationally.

The model is a table of bigram counts over all documents.  A word after
another scores log(count(pair) / pairs that begin with the first word) if the
pair stands at least ``min_count`` times, else log(backoff * count(word) /
words); a document's first word follows a start mark.  Scores are summed per
document.

The ``hot`` commonest words (2**18 - 1, whatever the corpus; ties by the word)
are numbered and sent to every task.  Exploded pairs meet their counts in one
shuffle:

    both hot                keyed by the pair          both counts known
    only the second rare    keyed by the second word   its count is the group's size
    only the first rare     keyed by the first word    its pairs are the group's size
    both rare               keyed both ways: a row for the second word's count and
                            the score of a miss, one for the first's and of a hit

so no key gathers a hot word's rows: hot words spread over the pairs that they
stand in, and a rare word has at most 1/``hot`` of the rows.  All words count;
the number of hot ones changes the layout only, not the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import stage

RANK_BITS = 18
HOT = (1 << RANK_BITS) - 1
#: Low bits of a key: both hot, second rare, first rare.
BOTH, SECOND, FIRST = 0, 1, 2


def _name(word: str) -> int:
    """A rare word's number: negative, with two low bits free."""
    h = (xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42) | 1 << 63) & ~3
    return h - (1 << 64)


def word_counts(docs: DataFrame, text_col: str = "text", most: int = 400_000) -> DataFrame:
    """``word, n, n_first`` over all documents (n_first: the pairs that begin
    with it), pre-aggregated in each batch, ``most`` words or so at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, last = Counter(), Counter()
            for t in b.column(0).to_pylist():
                words = t.split() if t else []
                if words:
                    found.update(words)
                    last[words[-1]] += 1
                if len(found) >= most:
                    yield _batch(found, last)
                    found, last = Counter(), Counter()
            yield _batch(found, last)

    def _batch(found, last):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()),
             pa.array([n - last.get(w, 0) for w, n in found.items()], pa.int64())], names=["word", "n", "n_first"])

    return docs.select(F.col(text_col)).mapInArrow(run, "word string, n bigint, n_first bigint").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("n_first").alias("n_first"))


def _pairs(words: list[str], doc: np.ndarray, first: np.ndarray, hot: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(doc, key, aux, n) of the pairs of a run of documents: ``first`` marks
    the words that follow the start mark (number 0)."""
    rank = np.fromiter((hot.get(w, -1) for w in words), np.int64, len(words))
    rare = np.flatnonzero(rank < 0)
    name = rank.copy()
    name[rare] = np.fromiter((_name(words[i]) for i in rare), np.int64, len(rare))
    before = np.empty_like(name)
    before[1:] = name[:-1]
    before[first] = 0
    key = np.where(name < 0, name | SECOND, np.where(before < 0, before | FIRST, ((before << RANK_BITS) + name) << 2))
    aux = np.where(name < 0, before, np.where(before < 0, name, 0))
    both = np.flatnonzero((name < 0) & (before < 0))
    key, aux = np.concatenate([key, before[both] | FIRST]), np.concatenate([aux, name[both]])
    doc = np.concatenate([doc, doc[both]])
    mixed = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + aux.view(np.uint64)) * np.uint64(
        0xC2B2AE3D27D4EB4F) + doc.astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    doc, key, aux = doc[order], key[order], aux[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (aux[1:] != aux[:-1])]))
    times = np.diff(np.append(new, len(doc)))
    # like rows side by side compress well in the shuffle
    near = np.argsort((doc[new] << 2 | key[new] & 3).astype(np.uint32), kind="stable")
    return doc[new][near], key[new][near], aux[new][near], times[near]


def exploded(docs: DataFrame, hot: Broadcast, id_col: str, text_col: str, chunk: int = 200_000) -> DataFrame:
    """``key, aux, doc_id, n``: the pairs of every document, equal ones of a
    document counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            words, counts, rows = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = t.split() if t else []
                if own:
                    words += own
                    counts.append(len(own))
                    rows.append(i)
                if len(words) >= chunk:
                    yield _batch(ids, words, counts, rows)
                    words, counts, rows = [], [], []
            if words:
                yield _batch(ids, words, counts, rows)

    def _batch(ids, words, counts, rows):
        n = np.array(counts)
        doc, key, aux, times = _pairs(words, np.repeat(np.array(rows), n), np.cumsum(n) - n, hot.value)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(aux), ids.take(pa.array(doc)),
                                           pa.array(times, pa.int32())], names=["key", "aux", "doc_id", "n"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "key bigint, aux bigint, doc_id bigint, n int")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = 2, backoff: float = 0.4,
          hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, log_score, score`` of every id: the sum of the logs
    and their mean.

    Words are separated by white space.  An id is a document: rows that share
    one (null is one, too) count as its parts.  Documents without words have
    0 words and null scores.  An empty table gives an empty result; other
    columns are not read.
    """
    counts = stage(word_counts(docs, text_col), "word-counts")
    total, last = counts.agg(F.sum("n"), F.sum(F.col("n") - F.col("n_first"))).first()
    total, starts = total or 0, last or 0  # as many first words as last ones
    spark = docs.sparkSession
    top = counts.orderBy(F.desc("n"), "word").limit(min(hot, HOT))
    top = stage(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("bigint")), "hot")
    number = spark.sparkContext.broadcast({r["word"]: r["rank"] for r in top.select("word", "rank").collect()})
    log = lambda n: float(np.log(max(1, n)))
    known = top.select("rank", F.log("n").alias("log_n"), F.log(F.greatest("n_first", F.lit(1))).alias("log_first")).unionByName(
        spark.range(1).select(F.col("id").alias("rank"), F.lit(0.0).alias("log_n"), F.lit(log(starts)).alias("log_first")))
    one = F.broadcast(known.select(F.col("rank").alias("r1"), F.col("log_first").alias("l1")))
    two = F.broadcast(known.select(F.col("rank").alias("r2"), F.col("log_n").alias("l2")))

    rows = exploded(docs, number, id_col, text_col)
    rows = rows.select("*", F.sum("n").over(Window.partitionBy("key")).alias("of_key"),
                       F.sum("n").over(Window.partitionBy("key", "aux")).alias("of_pair"),
                       F.col("key").bitwiseAND(F.lit(3)).alias("kind"))
    pair = F.shiftright("key", 2)
    rows = rows.withColumns({
        "r1": F.when(F.col("kind") == BOTH, F.shiftright(pair, RANK_BITS)).when((F.col("kind") == SECOND) & (F.col("aux") >= 0), F.col("aux")),
        "r2": F.when(F.col("kind") == BOTH, pair.bitwiseAND(F.lit(HOT))).when((F.col("kind") == FIRST) & (F.col("aux") >= 0), F.col("aux"))})
    rows = rows.join(one, "r1", "left").join(two, "r2", "left")
    rare = F.col("aux") < 0  # the other word is rare as well: this row has one of the two scores
    hit = F.log(F.col("of_pair")) - F.when(F.col("kind") == FIRST, F.log(F.col("of_key"))).otherwise(F.col("l1"))
    miss = F.lit(float(np.log(backoff)) - log(total)) + F.when(
        F.col("kind") == SECOND, F.log(F.col("of_key"))).otherwise(F.col("l2"))
    value = F.when(F.col("of_pair") >= min_count, F.when((F.col("kind") == SECOND) & rare, 0.0).otherwise(hit)).otherwise(
        F.when((F.col("kind") == FIRST) & rare, 0.0).otherwise(miss))
    counted = F.when((F.col("kind") == FIRST) & rare, 0).otherwise(F.col("n"))
    sums = rows.groupBy("doc_id").agg(F.sum(F.col("n") * value).alias("log_score"), F.sum(counted).alias("n_words"))
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).distinct()
    return ids.alias("a").join(sums.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left").select(
        "a.doc_id", F.coalesce("n_words", F.lit(0)).cast("bigint").alias("n_words"), "log_score",
        (F.col("log_score") / F.col("n_words")).alias("score"))


#: The same with plain counts and joins, for DuckDB (ids are unique; bigrams
#: that stand twice or more, back-off 0.4; sums to 6 decimals, as their order
#: is free).  The white space is fixed: what ends a word for ``str.split``.
ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text,
             '[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+') AS words
           FROM documents),
pairs AS (SELECT doc_id, unnest(words) AS word, unnest(list_prepend(NULL, words[1:len(words) - 1])) AS before
          FROM t WHERE len(words) > 0),
one AS (SELECT word, count(*) AS n FROM pairs GROUP BY word),
led AS (SELECT before, count(*) AS n FROM pairs GROUP BY before),
two AS (SELECT before, word, count(*) AS n FROM pairs GROUP BY before, word),
priced AS (
  SELECT two.before, two.word, CASE WHEN two.n >= 2 THEN ln(two.n) - ln(led.n)
         ELSE ln(0.4) + ln(one.n) - ln((SELECT count(*) FROM pairs)) END AS value
  FROM two JOIN led ON two.before IS NOT DISTINCT FROM led.before JOIN one ON two.word = one.word),
sums AS (SELECT doc_id, count(*) AS n, sum(value) AS s FROM pairs p JOIN priced
         ON p.word = priced.word AND p.before IS NOT DISTINCT FROM priced.before GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, round(s, 6) AS log_score, round(s / n, 6) AS score
FROM documents d LEFT JOIN sums ON d.doc_id = sums.doc_id
"""
