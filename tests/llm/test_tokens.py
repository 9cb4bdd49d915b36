import base64
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tillspark.llm import bpe, packing, token_counts, tokenizing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = "ab'strevlmd  \n\t1２²!.,é中'’　\x1c\x85\x0bſ"


def odd_texts(n, seed=1, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    known = Tokenizer.from_file(JSON)
    return lambda text: known.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library_ids():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_pieces_give_the_library_ids(library):
    known = tokenizing.PieceEncoder(JSON, most=300, slice_chars=25)
    for text in [*odd_texts(3000), "<|endoftext|> a<|endoftext|>.b  <|endoftext|>", "x" * 500, " " * 90 + "y", "word, word. don't, (x), a.b,c: é!"]:
        assert np.frombuffer(known.packed(text), "<u4").tolist() == library(text), repr(text)


def test_plain_words_merge_as_in_the_library(library):
    rng = random.Random(5)
    known = tokenizing.PieceEncoder(JSON)
    letters = "etaoinshrdlucmETAIéüßñÿÀ"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(6000)}
    words |= {c * n for c in "aezé" for n in range(1, 31)}
    words |= {t[1:] for t in known.tokenizer.get_vocab() if t[:1] == "Ġ" and t[1:].isascii() and t[1:].isalpha() and len(t) < 31}
    words = sorted(words)
    assert [np.frombuffer(b, "<u4").tolist() for b in known.merges.ids(words)] == [library(" " + w) for w in words]


def test_texts_encoded_together(library):
    texts = [*odd_texts(400, 7), *(" ".join(odd_texts(9, i)) for i in range(40)), "", "erste Wörter, zweite Wörter. erste", "Wörter erste"]
    for sizes in ({}, {"group_chars": 50}, {"group_chars": 90, "slice_chars": 20, "most": 5, "fresh": 5}):
        for text, raw in zip(texts, tokenizing.PieceEncoder(JSON, **sizes).packed_all(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == library(text), repr(text)


@pytest.mark.parametrize("chunk,overlap", [(500, 20), (64, 8)])
def test_counts_of_windows(docs_of, library, chunk, overlap):
    rows = [(1, "ab " * 900), (2, "x" * 3000), (3, None), (4, ""), (5, "<|endoftext|> hello  \n\n  world" * 100), (None, "é ü " * 700),
            (1, "ab " * 900), (6, "a" * 300 + " " + "b" * 900 + " c"), (7, "".join(odd_texts(40, 2)))]
    got = token_counts.count_tokens(docs_of(rows), JSON, chunk=chunk, overlap=overlap).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={a}, n_bytes={len((b or '').encode())}, n_tokens={len(library(b))})" for a, b in rows)


def test_work_on_a_text_without_stable_places(docs_of, library, monkeypatch):
    text, sizes = "ab,c" * 6000, []
    spliced = token_counts._spliced
    monkeypatch.setattr(token_counts, "_spliced", lambda left, path, chunk, overlap: sizes.append((chunk, overlap)) or spliced(left, path, chunk, overlap))
    got = token_counts.count_tokens(docs_of([(1, text)]), JSON, chunk=500, overlap=20).first()
    assert got.n_tokens == len(library(text))
    assert sizes == [(500, 20), (5120, 1280), (327680, 81920)]
    encoded = sum(sum(min(len(text), start + c + o) - start for start in range(0, len(text), c)) for c, o in sizes)
    assert encoded < 5 * len(text)


def test_counts_of_nothing(docs_of):
    assert token_counts.count_tokens(docs_of([]), JSON).count() == 0


def test_bpe_is_the_library(library_ids):
    known = bpe.Bpe(RANKS)
    texts = [*odd_texts(4000), "a" * 700, "ab" * 500 + " x", "  ", "\n\n a", "'s't're", ""]
    for one in (known, bpe.Bpe(RANKS, window=7, most=50)):
        for text, raw in zip(texts, one.encode_all(texts)):
            ids = np.frombuffer(raw, "<u4").tolist()
            assert ids == library_ids(text), repr(text)
            assert one.decode(ids) == text.encode()


def test_scan_composes_like_one_state_after_another():
    classes, starts, reach, product, as_function = bpe.tables()
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, 9, 500)
    state, want = bpe.FRESH, []
    for k in kinds:
        state = bpe._step(state, int(k))[0]
        want.append(state)
    assert reach[bpe._scan(as_function[kinds], product), bpe.FRESH].tolist() == want


def test_encode_rows(docs_of, library_ids):
    rows = [(1, "It's  a\ntest 123 é"), (1, "It's  a\ntest 123 é"), (None, "x"), (2, None), (3, ""), (4, "long 'word " * 40_000)]
    got = bpe.encode(docs_of(rows), RANKS).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert r.tokens.ids == library_ids(text)
        pieces = [bpe.bpe(RANKS).tokens[i] for i in r.tokens.ids]
        assert r.tokens.offsets == np.cumsum([0, *map(len, pieces)])[:-1].tolist()
    assert bpe.encode(docs_of([]), RANKS).count() == 0


def cheapest(at, penalty, window):
    """The same minimum by trying all pairs."""
    cost = [0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= window:
                power = n & (n - 1) == 0 and n >= packing.LEAST_POWER
                options.append(cost[i] + (0 if power else window - n))
        cost.append(min(options) + penalty[j] + packing.OPENING)
    return cost[-1]


def test_cuts_are_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        doc_ends = np.cumsum(rng.integers(1, 150, rng.integers(1, 12)))
        sentence_ends = np.unique(rng.integers(1, doc_ends[-1] + 1, 10))
        at, penalty = packing.places(doc_ends, sentence_ends, 64)
        cuts = packing.best_cuts(at, penalty, 64)
        cost, start = 0, 0
        for c in cuts:
            n = c - start
            assert 0 < n <= 64
            cost += (0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else 64 - n) + penalty[at.index(c)] + packing.OPENING
            start = c
        assert start == doc_ends[-1] and cost == cheapest(at, penalty, 64)


def check_packing(rows, pieces, library, window):
    texts = sorted((str(i), tuple(library(t) + [1])) for i, t in rows)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((str(p.doc_id), p.doc_tokens), []).append((p.start, p.ids))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return texts, by_doc


def test_pack(docs_of, library, prose):
    rows = [(i, prose(20 + 37 * i, i)) for i in range(25)] + [(100, None), (101, ""), (102, "x" * 5000), (103, prose(3000, 5) + ". ")]
    pieces = packing.pack(docs_of(rows), JSON, window=128).collect()
    texts, by_doc = check_packing(rows, pieces, library, 128)
    for doc, ids in texts:
        parts = sorted(by_doc.pop((doc, len(ids))))
        assert b"".join(bytes(x) for _, x in parts) == np.array(ids, "<u4").tobytes()
    assert not by_doc
    lengths = {}
    for p in pieces:
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    padding = sum(0 if n & (n - 1) == 0 else 128 - n for n in lengths.values())
    assert padding < 0.05 * sum(lengths.values())


def test_pack_repeated_null_and_none(docs_of, library):
    rows = [(1, "one two"), (1, "one two"), (None, "three"), (2, None)]
    pieces = packing.pack(docs_of(rows), JSON, window=4).collect()
    assert sum(p.length for p in pieces) == sum(len(library(t)) + 1 for _, t in rows)
    assert packing.pack(docs_of([]), JSON).count() == 0


def test_packing_query(spark, sf, library):
    from tillspark.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for p in QUERIES["op6_packing"](spark, sf).collect():
        ids = (library(texts[p.doc_id]) + [1])[p.start:p.start + p.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p.ids_crc32


def test_every_code_point_is_encoded_as_by_the_library(library_ids):
    """Each between two letters: letters join them, numbers and others part them."""
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    known = bpe.Bpe(RANKS)
    for first in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}a" for c in points[first:first + 50_000]]
        for text, raw in zip(texts, known.encode_all(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == library_ids(text), hex(ord(text[1]))
