"""Ranked lexical search the other way round: the items stand still, the documents stream by.

The items of a query set are taken in blocks of bounded size.  A block becomes
an inverted index over its terms (term -> items and how often they hold it),
which is broadcast; each task streams its documents' term counts through the
index and keeps a heap of the best documents for every item.  The heaps are
merged over salted parts first and over items then, so what meets in one task
grows with the square root of the number of tasks, not with the documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import slices, stage
from tally.session import ship_package

RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"
#: Bytes of a term: ASCII digits and letters (lower-cased) and everything beyond ASCII; all other bytes end one.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
#: Weights of BM25 in whole numbers: length share 25 of 100, saturation 1.2 as 12 (fixed values of the contract).
LENGTH_SHARE, SATURATION, SCALE = 25, 12, 1_000_000_000
SALTS = 256


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(TERM_BYTES).split()


class Index:
    """An inverted index over a block of items: ``number`` of each term, and
    per term the items that hold it with their counts, in rows one after the other."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for k, (_, text) in enumerate(items):
            for term, n in Counter(terms(text)).items():
                if (t := self.number.setdefault(term, len(postings))) == len(postings):
                    postings.append([])
                postings[t].append((k, n))
        self.begins = np.cumsum([0, *map(len, postings)])
        flat = np.array([x for p in postings for x in p], np.int64).reshape(-1, 2)
        self.items, self.counts = flat[:, 0].copy(), flat[:, 1].copy()


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The different (id, text) of the items in blocks of about ``block_chars``
    bytes, which bound what the driver and a broadcast hold at once."""
    rows, size = [], 0
    own = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    for i, text in own.where("text is not null").distinct().toLocalIterator():
        rows.append((i, bytes(text)))
        size += len(text)
        if size >= block_chars:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` rows of ``docs`` with the
    highest scores above 0 for each item, equal scores by ascending doc_id.

    Scores are BM25 in whole numbers over all documents' statistics.  Null
    texts have no term; texts and items without a term match nothing; a
    repeated row of ``docs`` is a document of its own (its equal scores stand
    on ranks of their own), a repeated row of ``items`` is one item, the same
    id with two texts two items; null doc_ids come last among equal scores,
    null item ids stay; empty tables give an empty result; other columns,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    out = None
    for rows in blocks(items, item_col, item_text, block_chars):
        part = stage(_block(docs, Index(rows), top, id_col, text_col), "ranks")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], RESULT)


def _block(docs: DataFrame, index: Index, top: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    numbers = spark.sparkContext.broadcast(index.number)
    counts = stage(term_counts(docs, numbers, id_col, text_col), "term-counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(len(index.number), np.int64)  # at most one entry a term of the block
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r[0]] = r[1]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    found = heaps(counts, spark.sparkContext.broadcast((index, weights)), n_docs, n_terms, top)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    parts = Window.partitionBy("item", "salt").orderBy(*order)
    ranks = Window.partitionBy("item").orderBy(*order)
    return (found.withColumn("salt", F.col("task") % SALTS)
            .withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def term_counts(docs: DataFrame, numbers: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_terms, terms, counts`` of every document with a term:
    how many terms it has, and the numbers and counts of those of ``numbers``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value.get
        for b in slices(batches):
            ids, sizes, begins, known, times = [], [], [0], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = terms(text)
                if own:
                    found = Counter(map(number, own))
                    found.pop(None, None)
                    ids.append(i)
                    sizes.append(len(own))
                    known += found.keys()
                    times += found.values()
                    begins.append(len(known))
            at = pa.array(begins, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(known, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))], names=["doc_id", "n_terms", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_terms bigint, terms array<int>, counts array<bigint>")


class Heaps:
    """The ``top`` best (score, doc_id) of each item seen so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # a lower score cannot enter

    def update(self, scores: np.ndarray, keys: list[int]) -> None:
        """Take in ``scores`` (documents by items); ``keys`` order equal scores, larger ones first."""
        enters = scores >= self.least
        for k in np.flatnonzero(enters.any(axis=0)).tolist():
            rows = np.flatnonzero(enters[:, k])
            own = scores[rows, k]
            if len(rows) > self.top:
                keep = own >= np.partition(own, -self.top)[-self.top]
                rows, own = rows[keep], own[keep]
            heap = self.heaps[k]
            for d, s in zip(rows.tolist(), own.tolist()):
                if len(heap) < self.top:
                    heapq.heappush(heap, (s, keys[d]))
                elif (s, keys[d]) > heap[0]:
                    heapq.heapreplace(heap, (s, keys[d]))
            if len(heap) == self.top:
                self.least[k] = heap[0][0]


def heaps(counts: DataFrame, shared: Broadcast, n_docs: int, n_terms: int, top: int,
          cells: int = 1 << 20) -> DataFrame:
    """``task, item, item_id, doc_id, score``: every task's heaps.  ``cells``
    bounds the scores and the matches between terms and items held at once."""
    no_id = -(1 << 63)  # below the key of any id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        index, weights = shared.value
        n_items, best = len(index.ids), None
        fan = np.diff(index.begins)
        for b in batches:
            best = best or Heaps(n_items, top)
            size = b.column(1).to_numpy()
            at = b.column(2).offsets.to_numpy().astype(np.int64)
            term = b.column(2).values.to_numpy()
            tf = b.column(3).values.to_numpy()
            keys = [no_id if i is None else -i for i in b.column(0).to_pylist()]
            damp = SATURATION * (100 - LENGTH_SHARE + LENGTH_SHARE * size * n_docs // max(n_terms, 1))
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            term, tf = term[at[0]:at[-1]], tf[at[0]:at[-1]]
            value = weights[term] * (SCALE * tf // (1000 * tf + damp[doc]))
            work = np.concatenate([[0], np.cumsum(fan[term])])[at - at[0]]
            rows = max(1, cells // max(n_items, 1))
            i = 0
            while i < b.num_rows:
                j = min(i + rows, max(i + 1, int(np.searchsorted(work, work[i] + cells, "right")) - 1), b.num_rows)
                a, z = at[i] - at[0], at[j] - at[0]
                best.update(_scores(index, fan, doc[a:z] - i, term[a:z], value[a:z], j - i), keys[i:j])
                i = j
        if best is not None:
            task = TaskContext.get().partitionId()
            out = [(task, k, index.ids[k], None if key == no_id else -key, s)
                   for k, heap in enumerate(best.heaps) for s, key in heap]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["task", "item", "item_id", "doc_id", "score"])

    return counts.mapInArrow(run, "task int, item int, item_id bigint, doc_id bigint, score bigint")


def _scores(index: Index, fan: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The scores (documents by items) of ``n`` documents' terms."""
    times = fan[term]
    ends = np.cumsum(times)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) + np.repeat(index.begins[term] - ends + times, times)
    scores = np.zeros(n * len(index.ids), np.int64)
    np.add.at(scores, np.repeat(doc * len(index.ids), times) + index.items[place],
              np.repeat(value, times) * index.counts[place])
    return scores.reshape(n, -1)


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
q2 AS (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t SEMI JOIN q2 USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), s),
v AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS v
      FROM tf JOIN w USING (term) JOIN d USING (doc_id), s),
r AS (SELECT item_id, doc_id, sum(times * v)::BIGINT AS score FROM q2 JOIN v USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
