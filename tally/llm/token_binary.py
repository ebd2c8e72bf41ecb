"""Token ids as length-delimited binary records.

A shard file is a run of records, each framed as

    length of the payload   uint64
    masked crc32 of the length bytes   uint32
    payload
    masked crc32 of the payload   uint32

(all little-endian; mask: the crc rotated right by 15 bits plus a constant, so
that a checksum of data that holds checksums stays sound).  The payload is
``id flag uint8, doc_id int64, width uint8, ids`` with 2 or 4 bytes an id,
whichever the vocabulary needs.  A separate index (Parquet: shard, offset,
length, doc_id, n_tokens) lets readers fetch records in any order.

Files go through pyarrow's file systems, so the folder may be any store that
all executors share.  A task writes a file of its own attempt and moves it to
its place when complete; a repeated task writes the same bytes.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from tally.llm.common import slices

MASK_DELTA = 0xA282EAD8  # fixed value of the masked-checksum convention
HEAD = struct.Struct("<QI")
META = struct.Struct("<BqB")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked_crc(size)) + payload + struct.pack("<I", masked_crc(payload))


class Encoder:
    """Texts to ids with a file of the tokenizers library, as bytes of uint16
    or uint32 ids with ``end_id`` at the end.

    A byte-level BPE never merges across its pre-tokens, so their ids are kept
    and looked up; only new ones are encoded.  Two dictionaries of about ``cache``
    entries of up to ``longest`` characters hold them (the older one is dropped
    when the newer one is full).  Any other kind of tokenizer encodes whole
    texts, as does this one where a text holds the string of an added token.
    """

    #: How byte-level tokenizers cut a text (fixed value, part of the file format of such tokenizers).
    PRETOKEN = regex.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str, end_id: int, cache: int = 250_000, longest: int = 64):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")  # texts with one are encoded whole
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.cache, self.longest = cache, longest
        self.pieces: dict[str, bytes | None] = {}
        self.old_pieces: dict[str, bytes | None] = {}
        self.marks: dict[str, bytes] = {}
        self.by_piece = self._by_piece()
        if self.by_piece:
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in plain]
            self.visible = {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}
            self.space = self.visible[32]
            self.tokenize = self.tokenizer.model.tokenize
            self.packers = [struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(40)]

    def _by_piece(self) -> bool:
        """Whether the tokenizer cuts texts by the pattern above and nothing
        else is done to them."""
        pre, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        return (self.tokenizer.normalizer is None and isinstance(model, BPE) and isinstance(pre, ByteLevel)
                and not pre.add_prefix_space and pre.use_regex and not model.dropout)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def token(self, t: str) -> bytes:
        """The ids of one pre-token."""
        if t.isascii() and t[1:].isalpha() and t[0] == " ":
            shown = self.space + t[1:]
        else:
            shown = t.encode("utf-8", "replace").decode("latin-1").translate(self.visible)
        ids = [x.id for x in self.tokenize(shown)]
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else np.array(ids, self.kind).tobytes()

    def word(self, w: str) -> bytes:
        """The ids of a space and the letters ``w``."""
        got = self.pieces.get(w) or self.old_pieces.get(w) or self.token(" " + w)
        if len(w) <= self.longest:
            self.pieces[w] = got
        return got

    def mark(self, m: str) -> bytes:
        got = self.marks.get(m)
        if got is None:
            got = self.marks[m] = self.token(m)
        return got

    def piece(self, p: str) -> bytes | None:
        """The ids of a space and ``p``; None if white space bounds ``p``, as
        pre-tokens may then reach beyond it."""
        if p.isalpha():
            return self.token(" " + p)
        if p[:-1].isalpha() and p[-1] in ".,":
            return self.word(p[:-1]) + self.mark(p[-1])
        if not p or p.strip() != p:
            return None
        return b"".join([self.word(t[1:]) if t[0] == " " and t[1:].isalpha() else self.token(t)
                         for t in self.PRETOKEN.findall(" " + p)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(e.ids, self.kind).tobytes() + self.end for e in got]
        if len(self.pieces) >= self.cache:
            self.old_pieces, self.pieces = self.pieces, {}
        cut = [None if self.added.search(t) else t.split(" ") for t in texts]
        known, old, once = self.pieces, self.old_pieces, {}
        for p in set().union(*[c[1:] for c in cut if c]).difference(known):
            (known if len(p) <= self.longest else once)[p] = old[p] if p in old else self.piece(p)
        found = known.__getitem__ if not once else lambda p: once[p] if p in once else known[p]
        out = []
        for t, c in zip(texts, cut):
            try:
                if not c:
                    raise TypeError
                first = c[0]
                if first and first.strip() != first:
                    raise TypeError
                head = b"".join(map(self.token, self.PRETOKEN.findall(first))) if first else b""
                if not first and len(c) > 1 and not c[1]:
                    raise TypeError
                out.append(head + b"".join(map(found, c[1:])) + self.end)
            except TypeError:  # a None: white space beside the cut; or an added token
                out.append(self.whole(t) + self.end)
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> Encoder:
    """One encoder a Python worker: its tasks share the file once read and the pieces known."""
    return Encoder(path, end_id)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text", chunk_chars: int = 1 << 18) -> DataFrame:
    """Write every row's ids to ``path`` in ascending id order (null ids first,
    equal ids by the hash of their texts) and return the index, read back.

    Rows are range-partitioned by (id, text hash); a task is a shard and
    encodes about ``chunk_chars`` characters at a time, streaming to its file.
    Null texts are empty; repeated rows are written repeatedly; an empty table
    gives an empty index and no shard; other columns are not read.
    """
    order = ["doc_id", "text_hash"]
    rows = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
            .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    spec = "shard int, offset bigint, length bigint, doc_id bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(path)
        shard, encoder, out, at = TaskContext.get().partitionId(), None, None, 0
        attempt = f"{root}/attempt-{shard:06d}-{uuid.uuid4().hex}"
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if out is None:
                encoder = encoder_of(tokenizer, end_id)
                out = fs.open_output_stream(attempt)
            index, i = [], 0
            while i < len(ids):
                j, size = i, 0
                while j < len(ids) and (j == i or size + len(texts[j]) <= chunk_chars):
                    size += len(texts[j])
                    j += 1
                for doc_id, data in zip(ids[i:j], encoder.encode(texts[i:j])):
                    record = frame(_payload(doc_id, encoder.width, data))
                    out.write(record)
                    index.append((shard, at, len(record), doc_id, len(data) // encoder.width))
                    at += len(record)
                i = j
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("shard", "offset", "length", "doc_id", "n_tokens"), x)) for x in index],
                schema=pa.schema([("shard", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()),
                                  ("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
        if out is not None:
            out.close()
            fs.move(attempt, f"{root}/{shard:06d}.records")

    fs, root = _filesystem(path)
    fs.create_dir(root, recursive=True)
    rows.mapInArrow(run, spec).write.parquet(f"{path}/index")
    for left in fs.get_file_info(pafs.FileSelector(root)):  # by attempts that failed
        if left.base_name.startswith("attempt-"):
            fs.delete_file(left.path)
    return docs.sparkSession.read.schema(spec).parquet(f"{path}/index")


def _payload(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return META.pack(doc_id is not None, doc_id or 0, width) + ids


def _records(f) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of an open shard file, one after the other."""
    while head := f.read(HEAD.size):
        body = f.read(HEAD.unpack(head)[0] + 4) if len(head) == HEAD.size else b""
        yield _parse(_record(head + body, 0)[0])


def _record(data: bytes, at: int) -> tuple[bytes, int]:
    if len(data) < at + HEAD.size:
        raise ValueError(f"record cut short at {at}")
    size, crc = HEAD.unpack_from(data, at)
    if len(data) < at + HEAD.size + size + 4:
        raise ValueError(f"record cut short at {at}")
    payload = data[at + HEAD.size:at + HEAD.size + size]
    if masked_crc(data[at:at + 8]) != crc or masked_crc(payload) != struct.unpack_from(
            "<I", data, at + HEAD.size + size)[0]:
        raise ValueError(f"damaged record at {at}")
    return payload, at + HEAD.size + size + 4


def _parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = META.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=META.size)


def read_records(shards: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every record, from the shard files
    alone (``ids``: little-endian uint32 bytes).  ``shards`` has a row a shard:
    ``shard`` and ``base``, the ids in the shards before it; ``start`` counts
    from there.  A task reads a shard, record by record, and checks every
    checksum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(path)
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(f"{root}/{shard:06d}.records", buffer_size=1 << 20) as f:
                    rows, size = [], 0
                    for doc_id, ids in _records(f):
                        rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                        size += len(rows[-1][3])
                        if size > 1 << 22:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.select(F.col("shard").cast("int"), F.col("base").cast("bigint")).mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def fetch(path: str, shard: int, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index."""
    fs, root = _filesystem(path)
    with fs.open_input_file(f"{root}/{shard:06d}.records") as f:
        return _parse(_record(f.read_at(length, offset), 0)[0])


def encode_documents(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Write, read back, and return ``doc_id, start, n_tokens, ids_crc32`` per
    record: ``start`` counts the ids of all records before it."""
    index = write_records(docs, path, tokenizer, end_id, id_col, text_col)
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per shard
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    n = index.agg(F.max("shard")).first()[0]
    shards = shards.repartitionByRange(1 if n is None else n + 1, "shard")  # a task a shard
    return read_records(shards, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
