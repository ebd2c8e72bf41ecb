"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits, each set if it is set in over half of the hashes of a
text's word shingles.  Two fingerprints link if they differ in at most
``max_bits`` bits; components of links are the near-duplicate groups.

Search: of the two 32-bit halves of a linked pair, one differs in at most
``t = max_bits // 2`` bits.  On 23 bits of each half, the codewords of the
perfect binary Golay code are the anchors; every point lies within the covering
radius 3 of exactly one.  A fingerprint has its home at that anchor and is
replicated to every anchor within 3 + t, so the home of one fingerprint of a
linked pair is always among the replicas of the other.  Each anchor compares
homes with replicas on all 64 bits, so nothing is missed and nothing else links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import WORD, components, fresh, slices, stage

#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b110001110101
LENGTH, RADIUS, CHECKS = 23, 3, 11
ANCHORS = 1 << (LENGTH - CHECKS)
#: Homes that one task compares at a time; an anchor with more is split, and its replicas go to each split.
CHUNK = 4096
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WORDS = re.compile(WORD)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text (0 for no words)."""
    words = _WORDS.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    if len(data) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(data), seed=42)
    joined = b" ".join(data)
    lens = np.fromiter(map(len, data), np.int64, len(data))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[:len(data) - shingle + 1].tolist()
    stops = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i:i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id, text_hash, fp`` (signed bigint) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(2).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


@lru_cache(maxsize=4)
def _code(reach: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Syndrome of each byte position, home error pattern per syndrome, and
    per syndrome all patterns of weight at most ``reach``."""
    def remainder(x: int) -> int:
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - CHECKS)
        return x

    unit = [remainder(1 << i) for i in range(LENGTH)]
    table = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * byte + i < LENGTH:
                    table[byte, v] ^= unit[8 * byte + i]
    home = np.zeros(1 << CHECKS, np.int64)
    near: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(reach + 1):
        for where in combinations(range(LENGTH), weight):
            s = p = 0
            for i in where:
                s ^= unit[i]
                p |= 1 << i
            near[s].append(p)
            if weight <= RADIUS:
                home[s] = p
    return table, home, [np.array(x, np.int64) for x in near]


def _points(fps: np.ndarray) -> list[np.ndarray]:
    """The 23 anchored bits of the two halves."""
    u = fps.view(np.uint64)
    return [((u >> np.uint64(s)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64) for s in (0, 32)]


def _syndromes(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16]


def home_anchors(fps: np.ndarray) -> np.ndarray:
    """2 x n: the home anchor of each half (the second half's are numbered on)."""
    table, home, _ = _code(RADIUS)
    return np.stack([(x ^ home[_syndromes(x, table)]) >> CHECKS for x in _points(fps)]) + [[0], [ANCHORS]]


def near_anchors(fps: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row): every anchor within the covering radius plus ``t`` of
    each half of each fingerprint."""
    table, _, near = _code(RADIUS + t)
    out_a, out_r = [], []
    for half, x in enumerate(_points(fps)):
        s = _syndromes(x, table)
        counts = np.array([len(n) for n in near])[s]
        patterns = np.concatenate([near[i] for i in s]) if len(s) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(x)), counts)
        out_a.append(((x[rows] ^ patterns) >> CHECKS) + half * ANCHORS)
        out_r.append(rows)
    return np.concatenate(out_a), np.concatenate(out_r)


class _Anchor:
    """Compares the homes of one anchor (or of one split of it) with replicas
    that stream by, and keeps a spanning forest of the homes that they join."""

    def __init__(self, key: int, homes: np.ndarray, max_bits: int):
        self.key, self.homes, self.max_bits = key, homes, max_bits
        self.label = np.arange(len(homes))

    def links(self, replicas: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, homes = [], self.homes
        width = max(1, (1 << 20) // max(1, len(homes)))
        for i in range(0, len(replicas), width):
            part = replicas[i:i + width]
            hit = np.bitwise_count(part[:, None] ^ homes[None, :]) <= self.max_bits
            hit &= part[:, None] > homes[None, :]  # each pair at one end only
            rows = np.flatnonzero(hit.any(axis=1))
            if not len(rows):
                continue
            hit = hit[rows]
            first = hit.argmax(axis=1)
            out.append((part[rows], homes[first]))
            r, c = np.nonzero(hit)
            a = first[r]
            while True:
                apart = np.flatnonzero(self.label[a] != self.label[c])
                if not len(apart):
                    break
                x, y = a[apart[0]], c[apart[0]]
                out.append((homes[[x]], homes[[y]]))
                self.label[self.label == self.label[y]] = self.label[x]
                a, c = a[apart], c[apart]
        return out


def links(fps: DataFrame, max_bits: int = 4, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links that join all fingerprints of column ``fp`` (distinct
    values) that differ in at most ``max_bits`` bits, directly or by a chain of
    links.  Per anchor a replica gives one link at most and the homes a
    spanning forest, so a group of n near copies gives O(n) links, not O(n^2).
    """
    t = max_bits // 2

    def homes(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for half in home_anchors(fp):
                yield pa.RecordBatch.from_arrays([pa.array(half), b.column(0)], names=["anchor", "fp"])

    at_home = fps.select("fp").mapInArrow(homes, "anchor bigint, fp bigint")
    # at most 2 * ANCHORS = 8192 rows by construction
    splits = np.ones(2 * ANCHORS, np.int64)
    for r in at_home.groupBy("anchor").count().where(F.col("count") > chunk).collect():
        splits[r["anchor"]] = -(-r["count"] // chunk)

    def spread(batches):
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(every), 2000):
                fp = every[i:i + 2000]
                for anchor in home_anchors(fp):
                    part = (fp.view(np.uint64) % splits[anchor].astype(np.uint64)).astype(np.int64)
                    yield _rows(anchor, part, 0, fp)
                anchor, row = near_anchors(fp, t)
                n = splits[anchor]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield _rows(np.repeat(anchor, n), part, 1, fp[np.repeat(row, n)])

    def _rows(anchor, part, role, fp):
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor * (1 << 40) + part), pa.array(np.full(len(fp), role, np.int8)), pa.array(fp)],
            names=["key", "role", "fp"])

    def compare(batches):
        now: _Anchor | None = None
        for b in batches:
            key, role, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            found = []
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                h = int(a + np.searchsorted(role[a:z], 1))
                if now is None or now.key != key[a]:
                    now = _Anchor(key[a], fp[a:h], max_bits)
                elif h > a:
                    now = _Anchor(key[a], np.concatenate([now.homes, fp[a:h]]), max_bits)
                if z > h and len(now.homes):
                    found += now.links(fp[h:z])
            x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
            y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
            if len(x):
                both = np.unique(np.stack([x, y], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy().view(np.int64)),
                                                  pa.array(both[:, 1].copy().view(np.int64))], names=["a", "b"])

    return (fps.select("fp").mapInArrow(spread, "key bigint, role tinyint, fp bigint")
            .repartition("key").sortWithinPartitions("key", "role")
            .mapInArrow(compare, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, root`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that a chain of links reaches,
    the row's own included (null only if no row of the component has an id).
    Components without an id share the null, and components that share a
    smallest id share it, too; ``root``, the component's smallest fingerprint,
    is its own alone.
    Null and empty texts and texts without words have fingerprint zero and link
    like any other; repeated rows give repeated results; an empty table gives
    an empty result; other columns are not read.  Exact copies meet as one
    fingerprint before the search.
    """
    rows = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = components(links(classes, max_bits))
    member = (classes.join(roots, classes.fp == roots.node, "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    low = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(low, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
             max_bits: int = 4) -> DataFrame:
    """One row of each component: of the rows with its smallest id (a null id
    comes last), one with the smallest text hash; all columns kept."""
    groups = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    kept = (groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root", "component_id").agg(F.min("text_hash").alias("text_hash"))
            .select(F.col("component_id").alias("__kept_id"), F.col("text_hash").alias("__kept_hash")))
    key = fresh(docs, "__row_hash")
    out = docs.withColumn(key, F.xxhash64(F.col(text_col))).alias("d").join(
        kept.alias("k"), F.col(f"d.`{id_col}`").cast("bigint").eqNullSafe(F.col("k.__kept_id"))
        & (F.col(f"d.`{key}`") == F.col("k.__kept_hash")), "left_semi")
    return out.dropDuplicates([id_col, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
