"""Packing: exact round trip, the placement rule, and edges."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from partloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def encoder():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def check(frame, documents):
    """Every id of every document lies in one piece; sequences are gapless and not too long."""
    encode = encoder()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in frame.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, texts in documents.items():
        wanted = sorted(
            (start, zlib.crc32(np.array(ids, "<u4")))
            for ids in ([*encode(t or ""), 1] for t in texts)
            for start in [len(ids)]
        )
        got = defaultdict(int)
        for r in pieces[doc_id]:
            got[r.doc_tokens] += r.length
        assert sum(got.values()) == sum(n for n, _ in wanted)
        if len(texts) == 1:
            ids, at = [*encode(texts[0] or ""), 1], 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                part = np.array(ids[r.start : r.start + r.length], "<u4")
                assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(part), len(ids))
                at += r.length
            assert at == len(ids)
    waste = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        waste += packing.WINDOW - at if at & (at - 1) else 0
    return waste


def test_documents(documents, texts):
    frame = packing.packed(documents, VOCABULARY)
    waste = check(frame, {i: [t] for i, t in texts.items()})
    assert waste <= packing.WINDOW * frame.rdd.getNumPartitions()


def test_edges(edges, empty):
    grouped = defaultdict(list)
    for r in edges.collect():
        grouped[r.doc_id].append(r.text)
    check(packing.packed(edges, VOCABULARY), grouped)
    assert packing.packed(empty, VOCABULARY).count() == 0


def test_same_ids_as_the_tokenizer():
    fast, plain = packing.byte_level_encoder(VOCABULARY), encoder()
    for text in (
        "",
        "it's 12 o'clock,  isn't it?\n\n\n  yes \t\n",
        "naïve — “quoted” 漢字 ١٢٣ 🙂🙂 <|endoftext|>   x",
        "a'S b'LL c'd  \r\n  d",
    ):
        assert fast(text) == plain(text)


def test_added_tokens_and_long_runs(spark):
    """The ids of the tokenizer with its default settings."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", " " * 2_000_000 + "x", "plain"]
    wanted = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert wanted[0] == [64, 220, 50256, 275, 1]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.packed(frame, VOCABULARY).collect()
    for i, ids in enumerate(wanted):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids)
        for r in mine:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(part), len(ids))


def least_change(counts, size, window):
    """The level that leaves the smallest sum of squared counts, by trying all."""
    best = None
    for level in range(window - size + 1):
        if level and not counts[level]:
            continue
        after = counts.copy()
        if level:
            after[level] -= 1
        if level + size < window:
            after[level + size] += 1
        score = int((after[1:window] ** 2).sum())
        if best is None or score < best[0]:
            best = (score, level)
    return best


def test_placement_is_the_sum_of_squares_rule():
    rng = np.random.default_rng(2)
    packer = packing.Packer(0, window=16, most=10**6)
    for doc in range(400):
        size = int(rng.integers(1, 16))
        before = packer.counts.copy()
        score, _ = least_change(before, size, 16)
        packer.add(doc, np.arange(size, dtype="<u4"))
        assert int((packer.counts[1:16] ** 2).sum()) == score
        assert packer.open == packer.counts[1:16].sum()


def test_open_windows_are_bounded_and_nothing_is_lost():
    packer = packing.Packer(0, window=16, most=8)
    for doc in range(500):
        packer.add(doc, np.full(11, doc, dtype="<u4"))
        assert packer.open <= 8
    packer.end()
    assert sum(r[2] for r in packer.rows) == 500 * 11
