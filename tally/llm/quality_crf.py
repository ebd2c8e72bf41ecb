"""Document quality from a linear-chain conditional random field over lines.

Each line has features of its own and of its neighbours; the chain labels every
line good or bad.  Document labels are the line labels of training documents.
A document's score is the mean of its lines' marginals of "good"
(forward-backward), weighted by their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import fold, stage

STATES = 2  # bad, good
#: Characters whose share of a line is a feature each.
MARKS = "!|#*$%&<>.,:;?/-_=@()[]{}\"'"
OWN = 12 + len(MARKS)


def lines_of(text: str | None) -> list[str]:
    """The lines of a text that have a word; one empty line for none."""
    return [x for x in (text or "").split("\n") if x and not x.isspace()] or [""]


def line_features(lines: list[str]) -> np.ndarray:
    """len(lines) x OWN features of the lines themselves."""
    out = np.zeros((len(lines), OWN))
    seen: set[str] = set()
    for row, x in zip(out, lines):
        words = x.split()
        n, size = len(words), len(x)
        if n:
            kinds = set(words)
            row[0] = np.log1p(n)
            row[1] = len(kinds) / n
            row[2] = (size - n + 1) / n / 10
            row[3] = x in seen
            row[4] = sum(map(str.isupper, words)) / n
            row[5] = sum(map(str.isdigit, words)) / n
            row[6] = sum(map(str.isalpha, words)) / n
            row[7] = sum(a == b for a, b in zip(words, words[1:])) / n
            row[8] = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2) if n > 2 else 1.0
            row[9] = x[0].isupper()
            row[10] = x[-1] in ".!?"
            row[11] = n < 5
            count = x.count
            for i, c in enumerate(MARKS):
                row[12 + i] = min(1.0, count(c) / n)
            seen.add(x)
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths): own features, those of the line before
    and after, whether there is one, and a constant."""
    lines = lines_of(text)
    own = line_features(lines)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((len(lines), 3))
    edge[0, 0] = edge[-1, 1] = edge[:, 2] = 1.0
    return np.hstack([own, before, after, edge]), np.array([len(x) + 1.0 for x in lines])


@dataclass
class Crf:
    """``emit`` (features x states) and ``move`` (state before x state)."""
    emit: np.ndarray
    move: np.ndarray

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """The probability of "good" for each line."""
        return np.exp(self._forward_backward(x @ self.emit)[0])[:, 1]

    def _forward_backward(self, score: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        n = len(score)
        a, b = np.empty((n, STATES)), np.zeros((n, STATES))
        a[0] = score[0]
        (m00, m01), (m10, m11) = self.move.tolist()
        if n > 1:
            f0, f1 = score[0].tolist()
            rows = score.tolist()
            for t in range(1, n):
                f0, f1 = rows[t][0] + _join(f0 + m00, f1 + m10), rows[t][1] + _join(f0 + m01, f1 + m11)
                a[t] = f0, f1
            g0 = g1 = 0.0
            for t in range(n - 2, -1, -1):
                s0, s1 = rows[t + 1][0] + g0, rows[t + 1][1] + g1
                g0, g1 = _join(m00 + s0, m01 + s1), _join(m10 + s0, m11 + s1)
                b[t] = g0, g1
        total = float(np.logaddexp(a[-1, 0], a[-1, 1]))
        return a + b - total, total, a, b

    def score(self, text: str | None) -> float:
        x, size = features(text)
        return float(self.marginals(x) @ size / size.sum())

    def pack(self) -> list[float]:
        return [*self.emit.ravel().tolist(), *self.move.ravel().tolist()]


def _join(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    from math import exp, log1p
    return a + log1p(exp(b - a)) if a >= b else b + log1p(exp(a - b))


def train(texts: list[str | None], labels: list[int], rounds: int = 60, l2: float = 1e-3,
          weights: list[float] | None = None) -> Crf:
    """Maximum conditional likelihood of the line labels, documents weighing
    alike or by ``weights``, by adaptive gradient steps over all of them; no
    randomness."""
    data = [(features(t)[0], int(y)) for t, y in zip(texts, labels)]
    if not data:
        return Crf(np.zeros((3 * OWN + 3, STATES)), np.zeros((STATES, STATES)))
    x = np.vstack([d[0] for d in data])
    n = np.array([len(d[0]) for d in data])
    y = np.repeat([d[1] for d in data], n)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    spread = x.std(axis=0)
    spread[spread == 0] = 1.0
    x = x / spread
    share = np.ones(len(n)) if weights is None else np.array(weights, float)
    weight = (share / n)[doc] / share.sum()
    steps = [np.flatnonzero(place == t) for t in range(n.max())]
    emit, move = np.zeros((x.shape[1], STATES)), np.zeros((STATES, STATES))
    sums = [np.zeros_like(emit), np.zeros_like(move)]
    means = [np.zeros_like(emit), np.zeros_like(move)]
    gold = np.eye(STATES)[y]
    for k in range(1, rounds + 1):
        s = x @ emit
        a, b = s.copy(), np.zeros_like(s)
        for t in range(1, len(steps)):
            i = steps[t]
            a[i] += np.logaddexp(a[i - 1, :1] + move[0], a[i - 1, 1:] + move[1])
        for t in range(len(steps) - 1, 0, -1):
            i = steps[t]
            z = s[i] + b[i]
            b[i - 1] = np.logaddexp(move[:, 0] + z[:, :1], move[:, 1] + z[:, 1:])
        ends = np.cumsum(n) - 1
        total = np.logaddexp(a[ends, 0], a[ends, 1])[doc]
        p = np.exp(a + b - total[:, None])
        g_emit = x.T @ ((p - gold) * weight[:, None]) + l2 * emit
        inner = np.flatnonzero(place > 0)
        pair = np.exp(a[inner - 1][:, :, None] + move + (s[inner] + b[inner])[:, None, :] - total[inner][:, None, None])
        true = gold[inner - 1][:, :, None] * gold[inner][:, None, :]
        g_move = ((pair - true) * weight[inner][:, None, None]).sum(axis=0) + l2 * move
        for w, g, m, v in ((emit, g_emit, means[0], sums[0]), (move, g_move, means[1], sums[1])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w -= 0.15 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return Crf(emit / spread[:, None], move)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", folds: int = 5, held_out: int = 0, sample_per_label: int = 1500,
        max_chars: int = 20_000) -> Crf:
    """A field learned from the labelled documents outside the held-out fold.

    The bounded sample: per label the ``sample_per_label`` documents of at most
    ``max_chars`` characters with the smallest hashes (of rows that share an id,
    the one with the smallest).  It is picked by ids and hashes alone; only the
    texts picked move.  Rows without an id or a label are not learned from.
    Each picked document stands for the documents of its label that could have
    been picked: it weighs their number over the number picked, so the labels
    weigh as they are among the labelled documents, whether the bound cuts or not.
    """
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        (fold("doc_id", folds) != held_out) & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(
        F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    rows = rows.where(F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    least = stage(rows.groupBy("doc_id").agg(F.min("h").alias("h")).join(known, "doc_id"), "crf-labelled")
    counts = {r["y"]: r["count"] for r in least.groupBy("y").count().collect()}  # STATES rows at most
    picked = [least.where(F.col("y") == y).orderBy("h", "doc_id").limit(sample_per_label) for y in range(STATES)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # ids, hashes, labels: 2 * sample_per_label rows at most
    got = rows.join(picked, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("y", "text", "h").collect()
    got = sorted(got, key=lambda r: (r["h"], r["text"] or ""))
    drawn = Counter(r["y"] for r in got)
    return train([r["text"] for r in got], [r["y"] for r in got], weights=[counts[r["y"]] / drawn[r["y"]] for r in got])


def score(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_lines`` of every row: the length-weighted mean of its
    lines' marginals.

    Null and empty texts are one empty line; rows are scored one by one, so
    repeated rows give repeated results; an empty table gives an empty result;
    ids may be null; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([model.score(t) for t in texts], pa.float64()),
                 pa.array([len(lines_of(t)) for t in texts], pa.int64())], names=["doc_id", "score", "n_lines"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, score double, n_lines bigint")
