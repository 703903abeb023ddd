"""Packing and token files against the tokenizers library itself."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loanweave.llm import huffman, packing, token_files
from loanweave.llm.tokens import DROPPED, SPACED, Encoder

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
HARD = [
    "", " ", "  a", "a  b", "a \n b", "a\n\nb  ", "   x", "it's  I'll 3434 — x\t\ty", "ΑΣ ΣΑΣ Σ", "a ", " a",
    "a\n b", "a \nb", "é  x", "\x1c a\x85 b", " \n", "\n ", "x   y", "a  b", "<|endoftext|> z", "tab\t x",
]


def plain(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path,style", [(BYTES, SPACED), (WORDS, DROPPED)])
def test_pieces_give_the_ids_of_whole_texts(path, style):
    ids, first = Encoder(path, style).encode(HARD, 7)
    got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == [x + [7] for x in plain(path, HARD)]


@pytest.mark.parametrize("n", [0, 1, 5, 4095, 4096, 4097, 70000])
def test_pieces_are_powers_of_two_that_add_up(n):
    length, times = packing.pieces_of(np.array([n]), 4096)
    assert length.sum() == n and times[0] == len(length)
    assert all(k & (k - 1) == 0 for k in length.tolist())
    assert sorted(length.tolist(), reverse=True) == length.tolist()


def test_packing(docs, no_docs):
    rows = packing.pack(docs, WORDS, longest=1024).collect()
    want = {}
    for r, ids in zip(docs.collect(), plain(WORDS, [r.text or "" for r in docs.collect()])):
        want.setdefault(r.doc_id, []).append(ids + [2])
    seen = {}
    for r in rows:
        piece = want[r.doc_id][0][r.start : r.start + r.length]
        assert r.ids == piece and r.doc_tokens == len(want[r.doc_id][0]) and r.length == 1 << r.bucket <= 1024
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.offset == 0
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {k: sum(map(len, v)) for k, v in want.items()}
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack(no_docs, WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORDS, longest=1000)


@pytest.mark.parametrize("counts", [[5], [1, 1], [0, 3, 0, 900, 1, 1, 2], list(range(300)), [2**k for k in range(40)]])
def test_huffman_round_trip(counts):
    counts = np.array(counts, np.int64)
    lengths = huffman.code_lengths(counts, 8)
    used = np.flatnonzero(counts)
    assert (lengths[used] > 0).all() and lengths.max() <= max(8, int(len(used) - 1).bit_length())
    assert sum(2.0 ** -float(x) for x in lengths[used]) <= 1
    ids = np.random.default_rng(0).choice(used, 5000)
    bits, marks = huffman.encode(ids, huffman.canonical(lengths), lengths)
    assert (huffman.decode(bits, marks, len(ids), huffman.decode_table(lengths)) == ids).all()


def test_code_lengths_are_optimal_when_unbounded():
    counts = np.array([45, 13, 12, 16, 9, 5])
    assert huffman.code_lengths(counts, 16).tolist() == [1, 3, 3, 3, 4, 4]


def test_token_files_round_trip(docs, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 50)
    rows = token_files.round_trip(docs, BYTES, files=3).collect()
    source = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    ids = [x + [0] for x in plain(BYTES, [r.text or "" for r in source])]
    before = np.cumsum([0, *map(len, ids)])
    want = [(r.doc_id, int(b), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, b, x in zip(source, before, ids)]
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == want
    assert token_files.round_trip(no_docs, BYTES).count() == 0
