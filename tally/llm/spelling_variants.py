"""Spelling variants: words one edit apart, found by products of letter counts.

One inserted, deleted or replaced character changes a word's vector of letter
counts by a squared distance of at most two, and its length by at most one.
Words are blocked by length and, within a length, by how many of their letters
fall into each of four classes; one edit leads from a block to itself or to one
of a few neighbours, so no other pair of blocks is compared.  Two blocks are
compared by one NumPy product, which gives the squared distances of all their
pairs, in the task; only pairs within the bound are looked at letter by letter,
and only true neighbours leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import stage
from tally.session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A run of letters once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
LETTERS = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
CLASSES = 4
#: Letter counts are kept modulo this many letters: distances can only shrink, so no pair is lost.
LETTER_BINS = 32


def drop_letter(run: Column, doc_id: Column, one_in: int) -> Column:
    """``run`` without one letter where ``one_in`` divides the crc32 h of
    ``<doc_id>:<run>`` (the letter at h modulo the run's length), else ``run``.
    A null id counts as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, one_in: int | None = 97,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the runs of letters of whole texts, A-Z lower-cased (with
    ``one_in``: after ``drop_letter``), of at least ``min_length`` letters and
    ``min_count`` occurrences.  Null and empty texts have none; every repeated
    row counts."""
    run = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, UPPER.lower()), F.lit(RUN), F.lit(0))
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(run).alias("run")).where(F.length("run") >= min_length)
    word = drop_letter(F.col("run"), F.col("doc_id"), one_in) if one_in else F.col("run")
    return (runs.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _classes(word: Column) -> list[Column]:
    """How many letters of ``word`` fall into each class; other characters count to the last one."""
    own = [F.length(word) - F.length(F.translate(word, "".join(c for c in LETTERS if ord(c) % CLASSES == k), ""))
           for k in range(CLASSES - 1)]
    return [*own, F.length(word) - sum(own[1:], own[0])]


def _moves() -> list[tuple[int, ...]]:
    """What one edit adds to the class counts, each pair of blocks taken once:
    nothing, one letter moved between classes, or one letter more."""
    unit = [tuple(int(i == k) for i in range(CLASSES)) for k in range(CLASSES)]
    moved = [tuple(x - y for x, y in zip(unit[i], unit[j])) for i in range(CLASSES) for j in range(i)]
    return [(0,) * CLASSES, *moved, *unit]


def blocks(words: DataFrame, size: int = 512) -> DataFrame:
    """``key`` (class counts), ``slice``, ``slices``, ``words``, ``n``: the
    words of each composition dealt by hash into slices of about ``size``."""
    keyed = words.select("word", "n", F.array(*_classes(F.col("word"))).alias("key"))
    slices = keyed.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("slices"))
    return (keyed.join(slices, "key").withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
            .groupBy("key", "slice", "slices").agg(F.collect_list(F.struct("word", "n")).alias("rows"))
            .select("key", "slice", "slices", F.col("rows.word").alias("words"), F.col("rows.n").alias("n")))


def near_pairs(words: DataFrame, size: int = 512) -> DataFrame:
    """``word, n, near, near_n``: all pairs of words one edit apart, both ways.

    ``words`` holds different words.  Every pair of neighbouring blocks meets
    in one row, dealt by the right block's key and slice, so a frequent
    composition is spread over as many tasks as it has slices.
    """
    own = stage(blocks(words, size), "word-blocks")
    sizes = own.select("key", "slices").distinct()
    moves = F.array(*[F.array(*map(F.lit, m)) for m in _moves()])
    left = (own.select("key", "slice", F.col("words").alias("a_words"), F.col("n").alias("a_n"),
                       F.explode(moves).alias("move"))
            .select("a_words", "a_n", F.col("slice").alias("a_slice"),
                    F.forall("move", lambda x: x == 0).alias("same"), F.zip_with("key", "move", lambda x, y: x + y).alias("key"))
            .join(sizes, "key")
            .withColumn("slice", F.explode(F.sequence(F.when(F.col("same"), F.col("a_slice")).otherwise(0), F.col("slices") - 1)))
            .drop("slices"))
    right = own.select("key", "slice", F.col("words").alias("b_words"), F.col("n").alias("b_n"))
    pairs = left.join(right, ["key", "slice"]).select(
        "a_words", "a_n", "b_words", "b_n", (F.col("same") & (F.col("a_slice") == F.col("slice"))).alias("self"))
    return pairs.mapInArrow(_near, "word string, n bigint, near string, near_n bigint")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            a_words, a_n, b_words, b_n, same = (b.column(c)[k] for c in range(5))
            a, z = a_words.values, b_words.values
            i, j = near(a.to_pylist(), z.to_pylist(), same.as_py())
            if len(i):
                i, j = pa.array(i), pa.array(j)
                a, z, an, zn = a.take(i), z.take(j), a_n.values.take(i), b_n.values.take(j)
                for x, xn, y, yn in ((a, an, z, zn), (z, zn, a, an)):
                    yield pa.RecordBatch.from_arrays([x, xn, y, yn], names=["word", "n", "near", "near_n"])


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _counts(letters: np.ndarray) -> np.ndarray:
    rows = np.arange(len(letters))[:, None] * LETTER_BINS + letters % LETTER_BINS
    return np.bincount(rows.ravel(), minlength=len(letters) * LETTER_BINS).reshape(-1, LETTER_BINS).astype("f4")


def near(a: list[str], b: list[str], same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the words of ``a`` and ``b`` that are one edit apart;
    within a list the words have one length, ``b``'s are as long or one longer.
    ``same``: the lists are the same block, each pair counts once."""
    x, y = _letters(a), _letters(b)
    p, q = _counts(x), _counts(y)
    one = np.ones((len(a), 1), "f4"), np.ones((len(b), 1), "f4")
    gram = np.hstack([2 * p, -(p * p).sum(1, keepdims=True), -one[0]]) @ np.hstack(
        [q, one[1], (q * q).sum(1, keepdims=True)]).T  # minus the squared distances
    if same:
        gram[np.tri(len(a), dtype=bool)] = -np.inf
    i, j = np.divmod(np.flatnonzero(gram.ravel() >= -2), len(b))
    x, y = x[i], y[j]
    if x.shape[1] == y.shape[1]:
        true = (x != y).sum(1) == 1
    else:
        n = x.shape[1]
        head = np.logical_and.accumulate(x == y[:, :n], axis=1).sum(1)
        tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
        true = head + tail >= n
    return i[true], j[true]


def group(words: DataFrame, size: int = 512, ratio: int = 2) -> DataFrame:
    """``word, n, form, form_n, n_near, root`` for every row of ``words``
    (``word, n``; words differ, none is null or empty).

    ``form``: the commonest word one edit away (ties: the smallest in code
    point order) if it is at least ``ratio`` times as common, else null;
    ``n_near``: how many words are one edit away; ``root``: where the chain of
    forms ends.  An empty table gives an empty table; columns beside the two
    are not read.
    """
    ship_package(words.sparkSession)
    words = stage(words.select("word", "n"), "words")
    best = near_pairs(words, size).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near_n = -F.col("best.less")
    far = F.when(near_n >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), near_n.alias("form_n")))
    best = best.select("word", "n_near", far.alias("far")).select("word", "n_near", "far.form", "far.form_n")
    table = stage(words.join(best, "word", "left").select(
        "word", "n", "form", "form_n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near")), "forms")
    return table.join(_roots(table), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(table: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form.  Each step of a chain
    multiplies the count, so a chain is short, and every round doubles the
    length followed."""
    cur = table.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stage(cur.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                           F.col("next").isNotNull().alias("moved")), "roots")
        cur = jumped.select("word", "root")
        if not jumped.where("moved").limit(1).count():
            return cur
