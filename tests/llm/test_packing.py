"""Tokens and sequences against the tokenizer itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerleaf.llm import packing, tokens

ODD = [
    None, "", " \t\n", "it's I'll we've don't. x's, 12 345. 6", "ÀÉ èé!! é. ×. ÷, ß? ÿ$ Ø#",
    "<|endoftext|> a<|startoftext|>b. <|ENDOFTEXT|>.", "é ́x. é. \x1ca\x85b c İstanbul. ΣΑΣ. ﬁ.",
    "日本 語!!??\n\n.. …. a….", "\x00 \x07 a\x00. \x0b\x0c", "word " * 30_000, "x" * 9_000, "a.b. ...a' 'a '. %%% a%%%",
    "ＡＢＣ. ｡ Ǆ ŉ. 𝒳𝓎. 👩‍👩‍👧. a👍.",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.tokenizer_path())


@pytest.mark.parametrize("remembered", [1 << 20, 3])
def test_ids_are_the_tokenizers(tokenizer, monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    own = tokens.WordTokenizer(tokens.tokenizer_path())
    for _ in range(2):
        for part in (ODD, ODD[3:6], [None], []):
            ids, bounds = own.encode(pa.array(part, pa.string()), 2)
            for i, text in enumerate(part):
                expected = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
                assert ids[bounds[i] : bounds[i + 1]].tolist() == expected, text


def test_special_strings_as_text(tokenizer):
    own = tokens.WordTokenizer(tokens.tokenizer_path(), special=False)
    ids, _ = own.encode(pa.array(["a <|endoftext|> b<|startoftext|>."]))
    assert max(ids) < 49_406


def check(rows, texts, tokenizer, capacity=4096):
    """Every id in exactly one piece, sequences gapless, no room left."""
    streams = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(streams)
    for doc, ids in streams.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = packing.op9_packing(docs.repartition(3)).collect()
    check(rows, texts, tokenizer)


def test_odd_rows(spark, tokenizer):
    texts = list(enumerate(ODD))
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' as length", "1 as ids")
    rows = packing.op9_packing(docs).collect()
    check(rows, texts, tokenizer)
    small = packing.pack(docs, capacity=8).collect()
    check(small, texts, tokenizer, 8)
    for r in small:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert packing.op9_packing(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert len(packing.op9_packing(twice).collect()) == 4


def test_capacity_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, text string"), capacity=100)


def lengths(rows):
    return [r.length for r in rows]


def test_classes_hold_whole_documents():
    """Bins of class k take k documents whole; one more is cut to fill each bin's room."""
    packer = packing.Packer(4096, 0)
    sizes = [900] * 400 + [1500] * 400 + [2500] * 400 + [60] * 400
    for i, size in enumerate(sizes):
        packer.add(packing.Piece(i, size, 0, np.arange(size)))
    packer.finish()
    by_doc, by_bin = {}, {}
    for piece, sequence, offset in packer.done:
        by_doc.setdefault(piece.doc_id, []).append(piece)
        by_bin.setdefault(sequence, []).append((offset, piece))
    assert sum(len(p) > 1 for p in by_doc.values()) <= len(by_bin)
    assert len(packer.done) < 2 * len(sizes)
    for pieces in by_doc.values():
        assert np.concatenate([p.ids for p in sorted(pieces, key=lambda p: p.start)]).tolist() == list(range(pieces[0].tokens))
    full = [b for b in by_bin.values() if sum(len(p.ids) for _, p in b) == 4096]
    assert len(full) >= len(by_bin) - 12


def test_few_pieces_and_hardly_a_short_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.op9_packing(docs).collect()
    n_docs = docs.count()
    assert len(rows) < 2 * n_docs
    short = [r for r in rows if r.length < 64 and r.start + r.length < r.doc_tokens]
    # Six binary digits below 64, cut at most twice each, and the odd bin of nothing longer.
    assert len(short) <= 16
    fits = [r for r in rows if r.doc_tokens <= 4096]
    whole = sum(r.length == r.doc_tokens for r in fits)
    assert whole > 0.6 * len({r.doc_id for r in fits})


@pytest.mark.parametrize("capacity", [1, 2, 64, 256])
@pytest.mark.parametrize("seed", range(6))
def test_any_lengths_fill_sequences(capacity, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice([1, 2, 3, 17, 63, 64, 65, 100, 300], rng.integers(0, 200))
    packer = packing.Packer(capacity, 5)
    for i, size in enumerate(sizes):
        packer.add(packing.Piece(i, int(size), 0, np.arange(size)))
    packer.finish()
    total, held = {}, {}
    for piece, sequence, offset in sorted(packer.done, key=lambda d: d[1:]):
        assert offset == total.get(sequence, 0) and len(piece.ids)
        total[sequence] = offset + len(piece.ids)
        held.setdefault(piece.doc_id, []).append(piece)
    assert all(0 < t <= capacity and t & (t - 1) == 0 for t in total.values())
    assert sum(total.values()) == sizes.sum()
    for i, pieces in held.items():
        ids = np.concatenate([p.ids for p in sorted(pieces, key=lambda p: p.start)])
        assert ids.tolist() == list(range(sizes[i]))
