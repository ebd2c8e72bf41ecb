"""Operators 11 to 13 against the library and brute force, on fixtures with
nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tally.llm import queries, ranked_search, sentence_pieces, spelling_variants
from tests.conftest import SF001

SCHEMA = "doc_id bigint, text string, word string, n bigint, ids string, score string, rank string, item string"


def _table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "clash", 5, "clash", "clash", "clash", "clash") for i, t in rows], SCHEMA).repartition(parts)


# ------------------------------------------------------------ 11

TEXTS = [(1, "the cat  sat\n\n on▁the ▁ mat "), (2, None), (3, ""), (4, " "), (5, "\n"), (6, "漢字かな 😀\0 \t<s> </s>"),
         (7, "x" * 5000 + " y  " * 3000), (None, "no id"), (8, "the cat"), (8, "the cat"), (9, "é" * 100)]


def test_pieces_equal_the_library(spark):
    lib = SentencePieceProcessor(model_file=queries.PIECES)
    docs = _table(spark, TEXTS)
    got = sentence_pieces.decode(sentence_pieces.encode(docs, queries.PIECES, chunk_chars=50), queries.PIECES).collect()
    want = []
    for i, t in TEXTS:
        ids = [*lib.encode(t or ""), lib.eos_id()]
        want.append((i, tuple(ids), lib.decode(ids)))
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got) == Counter(want)
    plain = sentence_pieces.encode(docs, queries.PIECES, add_end=False).where("doc_id = 3").first()
    assert plain.ids == []
    assert sentence_pieces.encode(_table(spark, []), queries.PIECES).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in sentence_pieces.decode(nothing, queries.PIECES).collect()} == {1: None, 2: ""}


_SMALL = sentence_pieces.Chunks(queries.PIECES, cache=20, longest=4)  # every bound is met
_LIBRARY = SentencePieceProcessor(model_file=queries.PIECES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab the\n▁é\t漢😀<0x>\0s　"), max_size=40), max_size=4))
def test_chunks_apart_give_the_same_ids(texts):
    assert _SMALL.apart and _SMALL.lines
    assert [np.frombuffer(b, "<i4").tolist() for b in _SMALL.encode(texts)] == _LIBRARY.encode(texts)
    assert len(_SMALL.table) <= 20 + sum(map(len, texts)) and not any(len(k) > 4 for k in _SMALL.table)


def test_pieces_of_models_that_cross_markers(tmp_path):
    """A model with a marker inside a piece, or one that changes texts, segments whole texts."""
    from sentencepiece.sentencepiece_model_pb2 import ModelProto
    model = ModelProto()
    with open(queries.PIECES, "rb") as f:
        model.ParseFromString(f.read())
    for change in ("piece", "blanks"):
        own = ModelProto()
        own.CopyFrom(model)
        if change == "piece":
            own.pieces[-1].piece = "e▁c"
        else:
            own.normalizer_spec.remove_extra_whitespaces = True
        path = tmp_path / change
        path.write_bytes(own.SerializeToString())
        chunks, lib = sentence_pieces.Chunks(str(path)), SentencePieceProcessor(model_file=str(path))
        texts = ["the cat  the c", " a  b "]
        assert not chunks.apart
        assert [np.frombuffer(b, "<i4").tolist() for b in chunks.encode(texts)] == lib.encode(texts)


def test_pieces_query(spark):
    lib = SentencePieceProcessor(model_file=queries.PIECES)
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        ids = [*lib.encode(r.text or ""), 2]
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    got = queries.op11_sentence_pieces(spark, SF001).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


# ------------------------------------------------------------ 12

def _edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _words(rows, min_length=5, min_count=3, one_in=97):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c in spelling_variants.UPPER else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def _groups(n):
    out, form = set(), {}
    for w in n:
        near = [x for x in n if _edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.add((w, f, root, n[w], form[w][1], n[f] if f else None))
    return out


def test_words_near_by_product_equal_brute_force():
    rng = random.Random(3)
    for la, lb, same in ((6, 6, True), (6, 6, False), (5, 6, False), (1, 2, False)):
        a = sorted({"".join(rng.choice("abcdéÿ×") for _ in range(la)) for _ in range(150)})
        b = a if same else sorted({"".join(rng.choice("abcdéÿ×") for _ in range(lb)) for _ in range(150)})
        i, j = spelling_variants.near(a, b, same)
        got = sorted(zip(i.tolist(), j.tolist()))
        assert got == [(x, y) for x in range(len(a)) for y in range(len(b)) if _edit(a[x], b[y]) and (not same or x < y)]
        assert la < 5 or got


@pytest.mark.parametrize("size", [3, 512])
def test_spelling_variants(spark, size):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(4, 8))) for _ in range(40)] + ["straße", "Überall", "aaaaa", "aaaaaa"]
    rows = []
    for d in range(120):
        own = [rng.choice(base) for _ in range(30)]
        own = [w if rng.random() < 0.7 else w[:2] + rng.choice("abc") + w[rng.choice((2, 3)):] for w in own]
        rows.append((d if d % 10 else None, " ".join(own) + rng.choice([".", "!\n", "1", "_x"])))
    rows += [(200, None), (201, ""), (202, "1 2 3"), (203, rows[1][1]), (203, rows[1][1]), (204, ("langeswort" * 3000 + " ") * 3)]
    for w, k in (("kettenglied", 20), ("kettenglie", 9), ("kettengli", 3)):  # a chain of forms
        i = next(i for i in range(400, 500) if zlib.crc32(f"{i}:{w}".encode()) % 5)
        rows.append((i, f"{w} " * k))
    n = _words(rows, one_in=5)
    want = _groups(n)
    words = spelling_variants.count_words(_table(spark, rows), 5, 3, 5)
    assert {r.word: r.n for r in words.collect()} == n
    got = spelling_variants.group(words, size).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ("kettengli", "kettenglie", "kettenglied") in {x[:3] for x in want}
    assert spelling_variants.group(spelling_variants.count_words(_table(spark, []))).count() == 0
    plain = spelling_variants.count_words(_table(spark, [(1, "Abcde abcde ABCDE Äbcde")]), one_in=None).collect()
    assert [tuple(r) for r in plain] == [("abcde", 3)]


def test_spelling_variants_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    n = _words(rows)
    by_gap = {}  # a word with one letter taken out: words that share one, or are one, are candidates
    for w in n:
        for k in range(len(w)):
            by_gap.setdefault((k, w[:k] + w[k + 1:]), []).append(w)
    near = {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            cut = w[:k] + w[k + 1:]
            near[w].update(x for x in by_gap[(k, cut)] if x != w)
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
    got = queries.op12_spelling_variants(spark, SF001).collect()
    assert {r.word: (r.n, r.n_near) for r in got} == {w: (n[w], len(near[w])) for w in n} and len(got) == len(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for r in got:
        root = r.word
        while form[root]:
            root = form[root]
        assert (r.form, r.root, r.form_n) == (form[r.word], root, n.get(form[r.word]))


# ------------------------------------------------------------ 13

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def _ranks(docs, items, top):
    own = [(i, Counter(_terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = Counter()
    for item, text in set(items):
        q, scored = Counter(_terms(text)), []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        for rank, (s, i) in enumerate(sorted(scored)[:top], 1):
            out[(item, rank, None if i == math.inf else i, -s)] += 1
    return out


@pytest.mark.parametrize("block_chars", [40, 1 << 20])
def test_ranked_search(spark, block_chars):
    rng = random.Random(4)
    pool = ["Ab", "ab", "x9", "ß", "été", "the", "the", "the", "z\u0085z"] + [f"w{k}" for k in range(30)]
    docs = [(i, rng.choice([" ", "-", "\n", "\0"]).join(rng.choice(pool) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    docs += [(None, docs[0][1]), (None, docs[1][1]), (300, docs[2][1]), (301, docs[2][1]), (302, docs[2][1]), (302, docs[2][1]),
             (303, None), (304, ""), (305, "!?"), (306, "the w1 " * 20_000)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for k in range(12)]
    items += [(20, None), (21, ""), (22, "unheard"), (23, "w1 w1 w2"), (23, "w1 w1 w2"), (24, "w1"), (24, "w2 été"), (None, "w3 AB")]
    got = ranked_search.search(_table(spark, docs, 5), _table(spark, items).select(F.col("doc_id").alias("item_id"), "text", "rank", "score"),
                               7, block_chars=block_chars).collect()
    assert Counter(tuple(r) for r in got) == _ranks(docs, items[:-8] + [i for i in items[-8:] if i[1]], 7)


def test_ranked_search_in_small_steps(spark, monkeypatch):
    """Cells so few that every document is a step of its own give the same ranks."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = queries.benchmark(spark, SF001).limit(20)
    want = {tuple(r) for r in ranked_search.search(docs, items, 5).collect()}
    monkeypatch.setattr(ranked_search.heaps, "__defaults__", (3,))
    assert {tuple(r) for r in ranked_search.search(docs, items, 5).collect()} == want


def test_ranked_search_of_nothing(spark):
    docs, items = _table(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranked_search.search(_table(spark, []), items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0
    assert [tuple(r) for r in ranked_search.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
