"""Removal of repeated byte strings by difference-cover suffix sorting.

A byte goes if a string of LENGTH bytes covers it that also starts anywhere
else. Which strings repeat is told by a suffix array; suffixes are sorted
where a repeat is possible at all:

1. Cover. Of each window of LENGTH bytes one position is sampled, the least
   hash of its K-byte strings. Like a difference cover of the positions, the
   sample has a position at the same offset in any two equal windows, but it
   is set by content and fifteen times thinner than two of three positions.
   Each sampled position (anchor) owns the windows that chose it; together
   these are its tile, some 280 bytes.
2. Names. Anchors are named by their K bytes, tiles by all of theirs. An
   anchor that occurs once owns no repeated window and is done; every window
   of a tile that occurs twice is repeated. Left are anchors with different
   tiles, a fraction of the text, which are read once for each distinct tile.
3. Suffix array. Distinct tiles, dealt by anchor so that equal windows share
   a task, are sorted by the difference cover modulo 3: sort the triples at
   sampled suffixes, recurse on their names, merge the remaining suffixes in,
   then compare the LENGTH-byte prefixes of adjacent suffixes.
4. The repeated windows of each document are merged into spans and cut out.

An anchor with more than MAX_TILES distinct tiles would be too much for one
task: its windows are dealt by their own hash (128 bits) and counted instead.

Defined results: a null text counts as empty; texts below LENGTH bytes stay
whole. Rows are told apart by id and text, so that repeated rows are each
other's copies. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import broadcast_if_small, cut, small_batches
from turnlens.llm.exact_dedup import maybe_in
from turnlens.llm.shingles import _pow, mix

LENGTH, K = 200, 100
#: Distinct tiles of an anchor that one task sorts; bytes of tiles sorted at once.
MAX_TILES, SORT_BYTES = 4000, 1_200_000
#: Bytes of text whose anchors are found at once.
SCAN_BYTES = 4_000_000
_BITS = 28
_LOW = np.uint64((1 << _BITS) - 1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` (integers from 1 up) in order, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = text
    base = int(t.max()) + 1
    if base >= 1 << 21:
        t[:n] = np.unique(t[:n], return_inverse=True)[1] + 1
        base = int(t.max()) + 1
    n0, n1 = (n + 2) // 3, (n + 1) // 3
    one = np.arange(1, n + (n0 - n1), 3)  # with a dummy at n if needed, so that runs of names end apart
    two = np.arange(2, n, 3)
    sampled = np.r_[one, two]
    triples = (t[sampled] * base + t[sampled + 1]) * base + t[np.minimum(sampled + 2, n + 2)]
    order = np.argsort(triples, kind="stable")
    step = np.ones(len(order), np.int64)
    step[1:] = triples[order[1:]] != triples[order[:-1]]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(step)
    if names[order[-1]] < len(order):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    middle = sampled[order]
    middle = middle[middle < n]
    wide = len(order) + 2
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(t[zero] * wide + rank[zero + 1], kind="stable")]
    # merge: each remaining suffix goes after the sampled ones that are less, told by residue
    first, second = middle[middle % 3 == 1], middle[middle % 3 == 2]
    less = np.searchsorted(t[first] * wide + rank[first + 1], t[zero] * wide + rank[zero + 1])
    pair = lambda i: (t[i] * base + t[i + 1]) * wide + rank[i + 2]
    less += np.searchsorted(pair(second), pair(zero))
    out = np.empty(n, np.int64)
    at = less + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at] = zero
    out[rest] = middle
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of texts: text number, K-byte hash, tile hash, tile start, anchor offset, windows owned."""
    long_ = [i for i, b in enumerate(texts) if len(b) >= LENGTH]
    if not long_:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sizes = np.array([len(texts[i]) for i in long_])
    data = np.frombuffer(b"".join(texts[i] for i in long_), np.uint8)
    n = len(data)
    up, down = _pow(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mix((total[K:] - total[:-K]) * down[: n - K + 1])
    width = LENGTH - K + 1
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    pad = np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate([keys, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    at = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _LOW).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    count = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
    at = at[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    owned = np.diff(np.r_[head, len(at)])
    a, p, who = start[head], at[head], owner[head]
    tile = mix((total[a + owned + LENGTH - 1] - total[a]) * down[a] + (p - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + owned.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.array(long_)[who], grams[p].astype(np.int64), tile.astype(np.int64), a - starts[who], p - a, owned


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_numpy(), [(t or "").encode() for t in b.column(1).to_pylist()]
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= SCAN_BYTES):
                size += len(texts[high])
                high += 1
            who, gram, tile, start, offset, owned = anchors(texts[low:high])
            low, rid = high, ids[low:high][who]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(gram), pa.array(tile), pa.array(start, pa.int32()), pa.array(owned.astype(np.int16))], ["rid", "gram", "tile", "start", "owned"]
            )


def repeated_windows(tiles: list[bytes]) -> list[np.ndarray]:
    """For each of several distinct tiles: which of its windows also stand in another of them."""
    sizes = np.array([len(x) for x in tiles])
    text = np.frombuffer(b"\0".join(tiles) + b"\0", np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    is_start = np.zeros(len(text), bool)
    for s, n in zip(starts, sizes, strict=True):
        is_start[s : s + n - LENGTH + 1] = True
    # separators sort first; a window never reaches one
    order = suffix_array(text.astype(np.int64) + 1)
    order = order[is_start[order]]
    hit = np.zeros(len(text), bool)
    for low in range(0, len(order) - 1, 1 << 14):
        i, j = order[low : low + (1 << 14)], order[low + 1 : low + 1 + (1 << 14)]
        i = i[: len(j)]
        reach = np.arange(LENGTH)
        same = np.flatnonzero((text[i + LENGTH - 1] == text[j + LENGTH - 1]) & (text[i + LENGTH // 2] == text[j + LENGTH // 2]) & (text[i] == text[j]))
        same = same[(text[i[same, None] + reach] == text[j[same, None] + reach]).all(1)]
        hit[i[same]] = hit[j[same]] = True
    return [hit[s : s + n - LENGTH + 1] for s, n in zip(starts, sizes, strict=True)]


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that runs of repeated windows cover."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return edge[::2], edge[1::2] + LENGTH - 1


def _sorted_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of tiles that come sorted by anchor; whole anchors are sorted together, in bounded lots."""

    def settle(lot: list[tuple]) -> pa.RecordBatch:
        rid, low, high = [], [], []
        for (_, r, start, _, alone), hit in zip(lot, repeated_windows([x[3] for x in lot]), strict=True):
            if alone and hit.any():
                a, b = _spans(hit)
                rid += [r] * len(a)
                low += (a + start).tolist()
                high += (b + start).tolist()
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["rid", "low", "high"])

    lot: list[tuple] = []
    group: list[tuple] = []
    size = group_size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group and row[0] != group[0][0]:
                if lot and size + group_size > SORT_BYTES:
                    yield settle(lot)
                    lot, size = [], 0
                lot, size = lot + group if not lot else lot.__iadd__(group), size + group_size
                group, group_size = [], 0
            group.append(row)
            group_size += len(row[3])
    if lot and size + group_size > SORT_BYTES:
        yield settle(lot)
        lot = []
    if lot or group:
        yield settle(lot + group)


def _tile_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's wanted tiles, cut from its text."""
    for b in batches:
        out: list[tuple] = []
        for rid, text, tiles in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = (text or "").encode()
            out += [(t["gram"], rid, t["start"], raw[t["start"] : t["start"] + t["owned"] + LENGTH - 1], t["alone"], t["hot"]) for t in tiles]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["gram", "rid", "start", "bytes", "alone", "hot"])


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rids, starts, w1, w2 = [], [], [], []
        for rid, start, raw in zip(b.column("rid").to_pylist(), b.column("start").to_pylist(), b.column("bytes").to_pylist(), strict=True):
            for d in range(len(raw) - LENGTH + 1):
                h = hashlib.blake2b(raw[d : d + LENGTH], digest_size=16).digest()
                rids.append(rid)
                starts.append(start + d)
                w1.append(int.from_bytes(h[:8], "little", signed=True))
                w2.append(int.from_bytes(h[8:], "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(starts, pa.int32()), pa.array(w1, pa.int64()), pa.array(w2, pa.int64())], ["rid", "low", "w1", "w2"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, the remaining bytes and what was removed, from (doc_id, text, lows, highs)."""
    for b in batches:
        kept, n, removed, spans = [], [], [], []
        for text, lows, highs in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            raw = (text or "").encode()
            parts, at, runs, gone = [], 0, 0, 0
            end = -1
            for low, high in sorted(zip(lows or (), highs or (), strict=True)):
                if low > end:
                    parts.append(raw[at:low])
                    runs += 1
                    gone += high - low
                elif high > end:
                    gone += high - end
                end = max(end, high)
                at = end
            parts.append(raw[at:])
            kept.append(b"".join(parts))
            n.append(len(raw))
            removed.append(gone)
            spans.append(runs)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, removed, spans))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
        )


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(rid, low, high): bytes to remove, overlapping, of texts (rid, text)."""
    found = texts.mapInArrow(_scan, "rid long, gram long, tile long, start int, owned short")
    again = cut(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    # Anchors that occur once stop here, told by a Bloom filter of bounded size. A few that pass
    # it have a single tile and drop out below, so the filter needs no exact join after it.
    seen = cut(maybe_in(found, "gram", again, "gram"))
    tiles = cut(seen.groupBy("gram", "tile").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start", "owned")).alias("one")))
    whole = seen.join(broadcast_if_small(tiles.filter("n > 1").select("gram", "tile")), ["gram", "tile"], "left_semi")
    whole = whole.select("rid", F.col("start").alias("low"), (F.col("start") + F.col("owned") + (LENGTH - 1)).cast("int").alias("high"))
    mixed = tiles.groupBy("gram").agg(F.count(F.lit(1)).alias("tiles")).filter("tiles > 1")
    wanted = tiles.join(mixed, "gram").select("one.*", "gram", (F.col("n") == 1).alias("alone"), (F.col("tiles") > MAX_TILES).alias("hot"))
    by_text = cut(wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "owned", "gram", "alone", "hot")).alias("tiles")))
    ids = broadcast_if_small(by_text.select("rid"))
    holders = texts.join(ids, "rid", "left_semi").dropDuplicates(["rid"]).join(by_text, "rid").select("rid", "text", "tiles")
    bytes_ = holders.mapInArrow(_tile_texts, "gram long, rid long, start int, bytes binary, alone boolean, hot boolean")
    if wanted.filter("hot").limit(1).count():
        bytes_ = cut(bytes_)
        windows = cut(bytes_.filter("hot").mapInArrow(_hot_windows, "rid long, low int, w1 long, w2 long"))
        twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
        hot = windows.join(twice, ["w1", "w2"], "left_semi").select("rid", "low", (F.col("low") + LENGTH).cast("int").alias("high"))
        whole, bytes_ = whole.unionByName(hot), bytes_.filter(~F.col("hot"))
    dealt = bytes_.select("gram", "rid", "start", "bytes", "alone").repartition("gram").sortWithinPartitions("gram", "rid", "start")
    return whole.unionByName(dealt.mapInArrow(_sorted_tiles, "rid long, low int, high int"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans of each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows.filter(F.octet_length("text") >= LENGTH).select("rid", "text"))
    by_text = cut(spans.groupBy("rid").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")))
    ids = broadcast_if_small(by_text.select("rid"))
    hit = rows.join(ids, "rid", "left_semi").join(by_text, "rid").select("doc_id", "text", "lows", "highs")
    none = F.lit(None).cast("array<int>")
    clear = rows.join(ids, "rid", "left_anti").select("doc_id", "text", none.alias("lows"), none.alias("highs"))
    schema = f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long"
    return hit.mapInArrow(_cut_out, schema).unionByName(clear.mapInArrow(_cut_out, schema))
