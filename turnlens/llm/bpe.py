"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves a pre-token that
is itself a token. Tier 2, for the rest: a heap over linked bytes merges the
lowest-ranked neighbours until none is left. Each worker remembers a bounded
number of short pre-tokens, so that common words cost a dictionary lookup.

The vocabulary is of a fixed size (a few hundred thousand tokens at most), so
it is broadcast. Ids come packed as little-endian unsigned 32-bit integers.

Defined results: a null text counts as empty and has no ids; any other text
decodes to exactly its UTF-8 bytes, whatever its length. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import small_batches

#: Pre-tokens a worker remembers, and the longest that it does.
MEMO_ENTRIES, MEMO_CHARS = 1 << 19, 64
#: Byte strings whose rank (or lack of one) a worker remembers while merging.
RANK_ENTRIES = 1 << 17


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token and rank a line), by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys to the slots 0..n-1.

    Keys fall into buckets; from the fullest bucket on, each bucket gets the
    first displacement that sends its keys to free slots. A bucket of one key
    names its slot outright. ``ids[slot]`` is the key's id; a caller compares
    the key found there, as a foreign key also gets a slot.
    """

    LOAD = 4

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // self.LOAD)
        self.shift = [0] * self.buckets
        self.ids = [0] * self.n
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        free = bytearray(b"\1") * self.n
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            if len(groups[b]) == 1:
                singles.append(b)
            elif groups[b]:
                d = 0
                while True:
                    slots = [self._slot(hashes[i], d) for i in groups[b]]
                    if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
                for i, s in zip(groups[b], slots, strict=True):
                    free[s], self.ids[s] = 0, i
        slot = -1
        for b in singles:
            slot = free.index(1, slot + 1)
            free[slot], self.ids[slot], self.shift[b] = 0, groups[b][0], -1 - slot

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 32) % self.n

    def candidate(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.ids[-1 - d] if d < 0 else self.ids[self._slot(h, d)]


class Bpe:
    """Encodes and decodes with a rank vocabulary; cheap to pickle, built once on the driver."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)

    def token_id(self, piece: bytes) -> int:
        """The id of a whole token, -1 if it is none."""
        i = self.hash.candidate(piece)
        return i if self.tokens[i] == piece else -1

    def merge(self, piece: bytes, known: Ranks) -> list[int]:
        """Ids of a pre-token that is no token: lowest rank first, the leftmost of equals."""
        n = len(piece)
        nxt = list(range(1, n + 2))
        prev = list(range(-1, n + 1))
        rank = known.__getitem__
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) >= 0]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (mid := nxt[i]) >= n or nxt[mid] != end:
                continue
            alive[mid] = 0
            nxt[i] = end
            if end < n:
                prev[end] = i
                after = nxt[end]
                if (r := rank(piece[i:after])) >= 0:
                    heapq.heappush(heap, (r, i, after))
            if (p := prev[i]) >= 0 and (r := rank(piece[p:end])) >= 0:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : nxt[i]]))
            i = nxt[i]
        return out

    def encode_piece(self, piece: str, known: Ranks) -> bytes:
        raw = piece.encode()
        i = self.token_id(raw)
        ids = [i] if i >= 0 else self.merge(raw, known)
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Ranks(dict):
    """Byte string to rank or -1, of bounded size, filled from the perfect hash."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: bytes) -> int:
        if len(self) >= RANK_ENTRIES:
            self.clear()
        out = self.bpe.token_id(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = out
        return out


class Memo(dict):
    """Pre-token to packed ids, of bounded size."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.known = bpe, Ranks(bpe)

    def __missing__(self, piece: str) -> bytes:
        out = self.bpe.encode_piece(piece, self.known)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = out
        return out


def encode(docs: DataFrame, bpe: Bpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed) and decoded (the bytes that the ids stand for) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(bpe)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo, find = Memo(model), regex.compile(model.pattern).findall
        get = memo.__getitem__
        for batch in batches:
            ids = [b"".join(map(get, find(text or ""))) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"]
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def digests(encoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_tokens, ``keep`` and the hashes of the packed ids and of the decoded bytes."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        *keep,
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
