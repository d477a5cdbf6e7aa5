"""Packing: ids equal the tokenizer's, each lies in one piece, windows have no gap and little padding."""

from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest

from tests.llm.cases import LONG, ROWS, documents, empty
from turnlens.llm import packing
from turnlens.llm.entry import op12_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a  b   c\n\n d", " x ", "é à ü  b×, ÷. ö", "don't we'll  go 'tis it's,'s", "\x1c a\x1fb \x85 c\x00", "漢字 仮名 𝔘 🎉 a", "<|endoftext|> x <|endoftext|>", "a" * 5000, " " * 3000,
    "x " * 3000, "a\nb\r\nc\t d \n", "1,000.50% (x) [y] {z} `q` #1 a-b_c", " non  breaking 　 wide", "", "ſ ẞ ﬁ ", "end ",
]


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def checked(pieces: list, want: dict, parts: int, window: int = 2048) -> int:
    """Every id in one piece, no gap in a sequence; gives the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, bytes(p.ids), p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length))
        assert p.length == len(p.ids) // 4 > 0
    assert by_doc.keys() == want.keys()
    for doc, ids in want.items():
        at = 0
        for start, part, total in sorted(by_doc[doc]):
            assert (start, total) == (at // 4, len(ids) // 4)
            assert ids[at : at + len(part)] == part
            at += len(part)
        assert at == len(ids)
    padding = []
    for got in by_sequence.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= window
        padding.append(window - at)
    assert sum(x > 0 for x in padding) <= parts
    return sum(padding)


def test_ids_of_texts():
    t, rng = tokenizer(), random.Random(2)
    letters = ["a", "é", "×", ",", "'", "s", "'s", " ", "  ", "\n", "1", "漢", " ", "\x85", "-", "\t", "Zo", "re"]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(4000)] + [LONG]
    encoder = packing.Encoder(PATH)
    want = [packed(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new, then remembered
        assert [x for k in range(0, len(texts), 100) for x in encoder.encode(texts[k : k + 100])] == want


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_CHARS", 50)
    encoder, t = packing.Encoder(PATH), tokenizer()
    for text in [LONG[:5000], *ODD]:
        assert b"".join(encoder.encode([x])[0] for x in packing.blocks(text, encoder.before_space)) == packed(t.encode(text, add_special_tokens=False).ids)


def test_memory_of_segments_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_CHARS", 2000)
    encoder, t = packing.Encoder(PATH), tokenizer()
    for k in range(30):
        text = " ".join(f"w{k}x{i}" for i in range(20))
        assert encoder.encode([text])[0] == packed(t.encode(text, add_special_tokens=False).ids)
        assert encoder.chars < 6000


def sum_of_squares(counts: dict, n: int, size: int) -> int:
    """The level that the rule takes, by trying each."""
    best = None
    for h in [0, *counts]:
        if h + n > size:
            continue
        after = dict(counts)
        if h:
            after[h] -= 1
        if h + n < size:
            after[h + n] = after.get(h + n, 0) + 1
        key = (sum(x * x for x in after.values()), -h)
        best = min(best or (key, h), (key, h))
    return best[1]


@pytest.mark.parametrize("most", [10_000, 12])
def test_sum_of_squares_rule(most):
    rng = random.Random(4)
    windows, counts = packing.Windows(0, 32, most), defaultdict(int)
    for _ in range(3000):
        n = rng.randint(1, 31)
        if most > 100:
            h = windows.level(n)
            assert h == sum_of_squares({k: v for k, v in counts.items() if v}, n, 32)
            if h:
                counts[h] -= 1
            if h + n < 32:
                counts[h + n] += 1
        windows.put((0, 0, bytes(4 * n), n))
        assert len(windows.pieces) <= most
        assert sum(windows.counts) == len(windows.pieces) == sum(map(len, windows.at.values()))


def test_items_that_fit_no_other(spark):
    """Of items over half a window no two fit: they are cut when too many windows are open."""
    windows, out = packing.Windows(7, 32, 50), []
    for k in range(1000):
        out += windows.put((k, 0, bytes(4 * 17), 17))
    out += windows.close()
    fill = defaultdict(int)
    for w, _, p in out:
        fill[w] += len(p[2]) // 4
    assert sum(fill.values()) == 17_000 and sum(x < 32 for x in fill.values()) <= 1


def test_pack_odd_rows(spark):
    t = tokenizer()
    docs = documents(spark, [(k, x, "en", "a") for k, x in enumerate([*ODD, None])])
    want = {k: packed([*t.encode(x or "", add_special_tokens=False).ids, 1]) for k, x in enumerate([*ODD, None])}
    checked(packing.pack(docs, PATH).collect(), want, docs.rdd.getNumPartitions())
    assert packing.pack(empty(spark), PATH).collect() == []
    rows = packing.pack(documents(spark, ROWS), PATH).collect()
    assert sum(p.length for p in rows if p.doc_id == 12) == 2 * len(t.encode("repeat row", add_special_tokens=False).ids) + 2
    assert sum(p.length for p in rows if p.doc_id is None) == len(t.encode("no id at all", add_special_tokens=False).ids) + 1


def test_query_over_the_whole_table(spark):
    sf_dir, t = "/root/testdata/sf0.001", tokenizer()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: packed([*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()}
    pieces = packing.pack(docs, PATH).collect()
    padding = checked(pieces, want, docs.rdd.getNumPartitions())
    assert padding <= 2048 * docs.rdd.getNumPartitions()
    got = {(r.doc_id, r.start): r for r in op12_packing(spark, sf_dir).collect()}
    assert len(got) == len(pieces)
    for p in pieces:
        r = got[p.doc_id, p.start]
        assert (r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) == (p.length, zlib.crc32(bytes(p.ids)), p.doc_tokens, p.sequence_id, p.offset)
