"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with up to k = floor(m * error_rate)
edits.  Cut into k + 1 pieces, one piece of any such occurrence is unedited, so
exact hits of the pieces (one Aho-Corasick automaton over all pieces) are
candidates for every occurrence; each candidate window is verified with Myers'
bit-parallel edit distance.  Before that, the same argument at a finer cut sorts
out most chance hits: of an item's disjoint 5-character grams, all but k must
stand in the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import slices


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


GRAM = 5


class Item:
    """A test item with its error budget and, for Myers' algorithm, the
    positions of each character as a bit mask."""

    def __init__(self, item_id: int, text: str, error_rate: float):
        self.id, self.text, self.m = item_id, text, len(text)
        self.k = int(self.m * error_rate)
        self.masks: dict[str, int] = {}
        self.grams = [text[i:i + GRAM] for i in range(0, self.m - GRAM + 1, GRAM)]
        self.needed = len(self.grams) - self.k
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def pieces(self) -> list[tuple[int, str]]:
        n = self.k + 1
        cuts = [i * self.m // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]

    def possible(self, window: str) -> bool:
        """False only if no part of ``window`` is within k edits."""
        return self.needed <= 0 or sum(map(window.__contains__, self.grams)) >= self.needed

    def best(self, window: str) -> tuple[int, int]:
        """The fewest edits that turn the item into a part of ``window``, and
        where the first such part ends."""
        full, high = (1 << self.m) - 1, 1 << (self.m - 1)
        vp, vn, score, best, end = full, 0, self.m, self.m, 0
        get = self.masks.get
        for j, c in enumerate(window):
            eq = get(c, 0)
            d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
            hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
            if hp & high:
                score += 1
            elif hn & high:
                score -= 1
                if score < best:
                    best, end = score, j + 1
                    if not best:
                        break
            hp, hn = hp << 1 & full, hn << 1 & full
            vp, vn = hn | (full & ~(d0 | hp)), d0 & hp
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [Item(i, t, error_rate) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for offset, piece in item.pieces():
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, fewest edits, end in the normalised text) of each item
        that the text holds within its budget."""
        if self.empty or not text:
            return []
        t = normalise(text)
        spans: dict[int, list[list[int]]] = {}
        for end, (size, at) in self.automaton.iter(t):
            for n, offset in at:
                item = self.items[n]
                a = max(0, end + 1 - size - offset - item.k)
                z = min(len(t), end + 1 - size - offset + item.m + item.k)
                if z - a < item.m - item.k:
                    continue
                own = spans.setdefault(n, [])
                if own and a <= own[-1][1] and a >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], z)
                else:
                    own.append([a, z])
        out = []
        for n, own in sorted(spans.items()):
            item, least = self.items[n], None
            for a, z in own:
                window = t[a:z]
                if not item.possible(window):
                    continue
                d, end = item.best(window)
                if d <= item.k and (least is None or d < least[0]):
                    least = (d, a + end)
            if least:
                out.append((item.id, *least))
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
           block_chars: int = 8_000_000) -> Iterator[list[tuple[int, str]]]:
    """The items (normalised; those without text dropped) in blocks of about
    ``block_chars`` characters, so that what is sent to the tasks at once has a
    bound whatever the size of the benchmark."""
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("bigint"), F.col(text_col)).toLocalIterator():
        text = normalise(r[1])
        if not text:
            continue
        rows.append((r[0], text))
        size += len(text)
        if size >= block_chars:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1, id_col: str = "doc_id",
            text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, edits, ends_at``: each item that a document holds
    with at most floor(error_rate * length) edits, after lower-casing and
    making every run of white space one space (``ends_at``: end of the best
    occurrence in the text so changed).

    Null and empty texts match nothing and items without text are not looked
    for; repeated rows give repeated results; empty tables give an empty
    result; ids may be null; other columns are not read.
    """
    spec = "doc_id bigint, item_id bigint, edits int, ends_at bigint"
    out = None
    for items in blocks(benchmark, item_col, item_text):
        part = _search(docs, items, error_rate, id_col, text_col, spec)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], spec)


def _search(docs, items, error_rate, id_col, text_col, spec) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, error_rate)
        for b in slices(batches):
            ids, rows = b.column(0).to_pylist(), []
            for i, t in zip(ids, b.column(1).to_pylist()):
                rows += [(i, *m) for m in matcher.find(t)]
            if rows:
                a, c, d, e = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()),
                                                  pa.array(d, pa.int32()), pa.array(e, pa.int64())],
                                                 names=["doc_id", "item_id", "edits", "ends_at"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, spec)


def keep_clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1, text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept."""
    where = [f.name for f in docs.schema.fields].index(text_col)
    schema = docs.schema
    for items in blocks(benchmark, item_col, item_text):
        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, error_rate)
            for b in slices(batches):
                yield b.filter(pa.array([not matcher.find(t) for t in b.column(where).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
