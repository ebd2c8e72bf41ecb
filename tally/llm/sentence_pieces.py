"""SentencePiece ids by a table of distinct chunks.

A BPE model of the sentencepiece library merges only pieces of its table.  When
no piece holds a white-space marker behind another character, no merge crosses
the place before a marker, so a text falls into marked words that are segmented
apart; when the model falls back to bytes and no piece holds a line break, the
same holds on both sides of a line break.  A block of texts becomes a table of its distinct chunks, each of them is segmented
once, and the ids are joined back to the texts by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from tally.llm.common import slices

MARK = "▁"  # fixed value: how such models write a space
NORMAL, BPE = 1, 2  # fixed values of the model format: kind of a piece, kind of a model
BYTE = 6


class Chunks:
    """Texts to ids with one model file.

    ``cache`` bounds the entries of each of two generations of the chunk table
    that a Python worker carries from block to block; chunks of over
    ``longest`` characters are segmented where they stand and never kept, so
    the table has a bound in bytes, too.
    """

    def __init__(self, path: str, cache: int = 200_000, longest: int = 64):
        model = ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.apart = self._apart(model)
        self.lines = model.trainer_spec.byte_fallback and not any(
            "\n" in p.piece for p in model.pieces if p.type == NORMAL)
        if self.apart:
            model.normalizer_spec.add_dummy_prefix = False  # set once a text, below
        self.model = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.end = self.model.eos_id()
        self.cache, self.longest = cache, longest
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _apart(model: ModelProto) -> bool:
        """Whether chunks may be segmented apart: a BPE model that leaves texts
        as they are but for the marker, with only plain and byte pieces, no
        marker inside a piece, and a piece for the marker alone."""
        spec = model.normalizer_spec
        plain = [p.piece for p in model.pieces if p.type == NORMAL]
        return (model.trainer_spec.model_type == BPE and not spec.precompiled_charsmap
                and not spec.remove_extra_whitespaces and spec.escape_whitespaces
                and not model.trainer_spec.treat_whitespace_as_suffix
                and all(p.type in (NORMAL, BYTE) for p in model.pieces[3:])
                and MARK in plain and not any(MARK in p.lstrip(MARK) for p in plain))

    #: Chunks of a line: markers, then other characters; or markers at the end.
    CHUNKS = re.compile(r" *[^ ]+| +")

    def cut(self, text: str) -> list[str]:
        """The keys of a text's chunks in order.  A chunk that starts with a
        marker has the rest of it as key, any other has the marker sign, which
        no rest holds, and then itself."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if self.prefix and text:
            text = " " + text
        out: list[str] = []
        for i, line in enumerate(text.split("\n") if self.lines else [text]):
            if i:
                out.append(MARK + "\n")
            if "  " in line:
                out += [c[1:] if c[0] == " " else MARK + c for c in self.CHUNKS.findall(line)]
            elif line:
                words = line.split(" ")
                if words[0]:
                    words[0] = MARK + words[0]
                    out += words
                else:
                    out += words[1:]
        return out

    def segment(self, texts: list[str]) -> list[bytes]:
        ids = self.model.encode(texts, num_threads=1)
        ends = np.cumsum([0, *map(len, ids)]).tolist()
        data = np.fromiter(chain.from_iterable(ids), "<i4", ends[-1]).tobytes()
        return [data[4 * a:4 * b] for a, b in zip(ends, ends[1:])]

    def chunks(self, keys: list[str]) -> dict[str, bytes]:
        return dict(zip(keys, self.segment([k[1:] if k[:1] == MARK else " " + k for k in keys])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian int32 bytes, without an end id."""
        if not self.apart:
            return self.segment(texts)
        if len(self.table) > self.cache:
            self.older, self.table = self.table, {}
        placed = [self.cut(t) for t in texts]
        known, older = self.table, self.older
        new, long = [], []
        for c in set().union(*placed).difference(known):
            if c in older:
                known[c] = older[c]
            else:
                (new if len(c) <= self.longest else long).append(c)
        known.update(self.chunks(new))
        once = self.chunks(long)
        if once:
            return [b"".join([once[c] if c in once else known[c] for c in p]) for p in placed]
        return [b"".join(map(known.__getitem__, p)) for p in placed]


@lru_cache(maxsize=1)
def chunks_of(path: str) -> Chunks:
    """One table a Python worker: its tasks share the model and the chunks known."""
    return Chunks(path)


def encode(docs: DataFrame, model: str, add_end: bool = True, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = 1 << 20) -> DataFrame:
    """``doc_id, ids array<int>``: the ids that the sentencepiece library gives
    the whole text with the model file ``model``, one row a row of ``docs``.

    A block of about ``chunk_chars`` characters shares one table of distinct
    chunks.  Null texts are empty (``[end]``, or no id); repeated rows give
    repeated rows; ids may be null; an empty table gives an empty table; other
    columns, whatever their names, are not read.  A model whose pieces may
    cross markers, or that changes texts, segments whole texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in slices(batches):
            table = table or chunks_of(model)
            end = np.array([table.end] if add_end else [], "<i4").tobytes()
            texts = b.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= chunk_chars):
                    size += len(texts[j])
                    j += 1
                rows = [r + end for r in table.encode(texts[i:j])]
                begins = np.cumsum([0, *(len(r) // 4 for r in rows)])
                ids = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], ids], names=["doc_id", "ids"])
                i = j

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, text``: what the library decodes the ids of each row to.

    Null ids give a null text, no ids an empty one; repeated rows and null
    doc_ids stay; an empty table gives an empty table; other columns go.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            library = _library(model)
            texts = [None if ids is None else library.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")


@lru_cache(maxsize=1)
def _library(path: str) -> SentencePieceProcessor:
    return SentencePieceProcessor(model_file=path)
