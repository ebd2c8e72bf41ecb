"""Language identification by compression.

Per language, a bounded sample of labelled texts becomes the raw content of a
zstandard dictionary.  A text is encoded with every language's dictionary; the
language whose dictionary gives the fewest bytes is the prediction, and a text
whose two smallest totals lie too close together is rejected.

Texts are lower-cased, ASCII characters other than letters become blanks, and
the rest is compressed in blocks, so that punctuation habits don't count, a
long text cannot become its own dictionary and every part of it votes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import fold, slices

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Parts of a language among which its sample is picked first.
SALTS = 256
_BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normalise(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_BLANKED)


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           docs_per_language: int = 200, max_chars: int = 20_000) -> dict[str, list[str]]:
    """The texts that the dictionaries are made of: per language the
    ``docs_per_language`` rows of at most ``max_chars`` characters with the
    smallest hashes of id and text, so that a large group of copies gets its
    share of the sample and no more.  This is the bounded sample of labelled
    rows; what reaches the driver is bounded by these parameters times the
    number of languages.  A language whose texts are all longer is not learned.

    The rows are picked by their hashes alone, within ``SALTS`` parts of each
    language and then among those left, so no task holds more than
    ``SALTS * docs_per_language`` numbers of a language, however many rows or
    partitions it has; only then are the picked texts read.
    """
    rows = labelled.select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).alias("lang"),
                           F.col(text_col).alias("text")).where(
        "lang is not null and text is not null and length(text) between 1 and " + str(int(max_chars)))
    rows = rows.select("lang", "text", F.xxhash64("id", "text").alias("h"))
    picked = rows.select("lang", "h", F.pmod("h", F.lit(SALTS)).alias("salt"))
    for keys in (["lang", "salt"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        picked = picked.withColumn("n", nth).where(F.col("n") <= docs_per_language).drop("n")
    # the picks are at most docs_per_language a language; copies of a row share a hash
    texts = rows.join(F.broadcast(picked.select("lang", "h").distinct()), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(
        F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def build_dictionaries(texts: dict[str, list[str]], dict_bytes: int = 65_536) -> dict[str, bytes]:
    """Raw dictionary content of each language: its sample texts in lower
    case, in the sample's order, each that still fits into ``dict_bytes``."""
    out = {}
    for lang, rows in texts.items():
        parts, size = [], 0
        for t in dict.fromkeys(rows):
            b = normalise(t) + b" "
            if size + len(b) <= dict_bytes:
                parts.append(b)
                size += len(b)
        if parts and LETTER.search(b"".join(parts).decode("utf-8", "ignore")):
            out[lang] = b"".join(parts)
    return out


class Classifier:
    """Compresses texts with each language's dictionary.

    ``sizes`` gives a text's total bytes by language.  ``predict`` returns
    (language, score, rejected): the score is the share of the best language
    when each total counts as a code length (a byte is ``nats_per_byte``), and
    a text is rejected if the second-smallest total is less than
    ``min_margin`` (a fraction of the smallest) and ``min_bytes`` away.
    """

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, block: int = 4096,
                 min_margin: float = 0.005, min_bytes: int = 1, nats_per_byte: float = 0.7):
        self.names = sorted(dictionaries)
        self.block, self.min_margin, self.min_bytes, self.nats = block, min_margin, min_bytes, nats_per_byte
        self.encoders = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_checksum=False,
                                                          write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = normalise(text)
        parts = [data[i:i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(e.compress(p)) for p in parts) for e in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        score = 1.0 / sum(math.exp(-self.nats * min(700.0, s - best)) for s in sizes)
        if len(sizes) == 1:
            return self.names[0], score, False
        gap = sizes[order[1]] - best
        return self.names[order[0]], score, gap < self.min_bytes or gap < self.min_margin * best


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             **options) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row of ``docs``.

    Null texts and texts without a letter get ``und``, score 0, rejected.  Rows
    are handled one by one, so repeated rows give repeated results; an empty
    table gives an empty result; other columns of ``docs`` are not read.
    ``options`` go to :class:`Classifier`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, **options)
        for b in slices(batches):
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            lang, score, out = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        folds: int = 4, held_out: int = 2, **bounds) -> dict[str, bytes]:
    """Dictionaries learned from the rows whose fold is not the held-out one
    (rows without an id belong to no fold and are not learned from)."""
    return build_dictionaries(sample(docs.where(fold(id_col, folds) != held_out), id_col, text_col, lang_col, **bounds))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose language is identified, all columns kept."""
    where = [f.name for f in docs.schema.fields].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, **options)
        for b in slices(batches):
            yield b.filter(pa.array([not model.predict(t)[2] for t in b.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
