"""Maximal runs of periodic words, and the texts with each run cut down to its first period.

A run is a stretch of consecutive words that repeats itself with smallest
period q and that no neighbouring word extends. Every run of two periods or
more holds a root that is a longest Lyndon word under one of the two orders of
the words, so the runs of a text are found without a suffix array: a stack of
Lyndon words is kept while the words are scanned from right to left, one stack
an order, and each longest Lyndon word is extended to both sides.

Suffixes are compared, and roots extended, by the longest common extension of
two positions: the first words directly, beyond them by binary search over
rolling hashes; what the hashes call equal is then verified word by word, once
for each distance and stretch, so that no collision can change a result.

Each text is one row and is searched in the task that holds it; nothing is
shuffled. Memory grows with the longest text alone.

Defined results: a null text has no words; an empty text, or one of white
space, neither; both collapse to the empty text. Rows that repeat, or have no
id, are each read by themselves. An empty table gives an empty one. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import WORD, small_batches

#: A run has so many words at least, and so many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Words compared directly before hashes are asked.
DIRECT = 8
#: Modulus and base of the rolling hash.
MODULUS, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


class Extensions:
    """Longest common extensions of two positions of a list of word numbers."""

    def __init__(self, w: list[int]):
        self.w, self.n = w, len(w)
        self.same: dict[int, tuple[int, int]] = {}  # distance p: w[x] == w[x + p] for lo <= x < hi, and not at hi
        self._sums: list[int] = []

    def _equal(self, a: int, b: int, k: int) -> bool:
        """Whether the hashes of k words from a and from b agree."""
        if not self._sums:
            self._sums = list(accumulate(self.w, lambda h, x: (h * BASE + x + 1) % MODULUS, initial=0))
            self._powers = list(accumulate(range(self.n), lambda h, _: h * BASE % MODULUS, initial=1))
            self._words = np.array(self.w, "i4")
        s, p = self._sums, self._powers[k]
        return (s[a + k] - s[a] * p - s[b + k] + s[b] * p) % MODULUS == 0

    def _first_odd(self, a: int, b: int, k: int) -> int:
        """Words from a and b on that are the same, of k."""
        odd = np.flatnonzero(self._words[a : a + k] != self._words[b : b + k])
        return int(odd[0]) if len(odd) else k

    def forward(self, a: int, b: int) -> int:
        """Words that are the same from a < b on."""
        w, n = self.w, self.n
        k, most = 0, n - b
        direct = min(DIRECT, most)
        while k < direct and w[a + k] == w[b + k]:
            k += 1
        if k < direct or k == most:
            return k
        lo, hi = self.same.get(b - a, (n, n))
        if lo <= a < hi:
            return hi - a
        limit = min(most, lo - a) if a < lo else most  # from lo on they are known to be the same
        good, bad = min(k, limit), limit + 1
        step = k
        while good + step < bad and self._equal(a, b, good + step):
            good += step
            step += step
        bad = min(bad, good + step)
        while bad - good > 1:
            mid = (good + bad) // 2
            good, bad = (mid, bad) if self._equal(a, b, mid) else (good, mid)
        k = self._first_odd(a, b, good) if good > k else good
        if a < lo and a + k == lo and lo < n:
            k = hi - a
        self.same[b - a] = (a, a + k)
        return k

    def backward(self, a: int, b: int) -> int:
        """Words that are the same up to and with a < b, leftwards."""
        w = self.w
        k, direct = 0, min(DIRECT, a + 1)
        while k < direct and w[a - k] == w[b - k]:
            k += 1
        if k < direct or k == a + 1:
            return k
        good, bad, step = k, a + 2, k
        while good + step < bad and self._equal(a - good - step + 1, b - good - step + 1, good + step):
            good += step
            step += step
        bad = min(bad, good + step)
        while bad - good > 1:
            mid = (good + bad) // 2
            good, bad = (mid, bad) if self._equal(a - mid + 1, b - mid + 1, mid) else (good, mid)
        odd = np.flatnonzero(self._words[a - good + 1 : a + 1] != self._words[b - good + 1 : b + 1])
        return good - 1 - int(odd[-1]) if len(odd) else good


def lyndon_ends(w: list[int], same: Extensions) -> tuple[list[int], list[int]]:
    """For each position the end of its longest Lyndon word, under the order of the numbers and under the reverse one.

    The ends chain the stack: what stands right of position i is the word at
    i + 1, then the one that starts where that ends, and so on. A word takes in
    those on the stack while its suffix comes before theirs. A suffix that ends
    comes before its extensions in either order.
    """
    n = len(w)
    low, high = [n] * n, [n] * n
    forward = same.forward
    for i in range(n - 2, -1, -1):
        c, j = w[i], i + 1
        d = w[j]
        if c == d:
            k = forward(i, j)
            if j + k == n:
                low[i] = high[i] = j
                continue
            before = w[i + k] < w[j + k]
        else:
            before = c < d
        if before:
            high[i] = j
            j = low[j]
            while j < n:
                d = w[j]
                if c > d:
                    break
                if c == d:
                    k = forward(i, j)
                    if j + k == n or w[i + k] > w[j + k]:
                        break
                j = low[j]
            low[i] = j
        else:
            low[i] = j
            j = high[j]
            while j < n:
                d = w[j]
                if c < d:
                    break
                if c == d:
                    k = forward(i, j)
                    if j + k == n or w[i + k] < w[j + k]:
                        break
                j = high[j]
            high[i] = j
    return low, high


def _roots(w: list[int], ends: tuple[list[int], list[int]], side: int) -> list[tuple[int, int]]:
    """(start, period) of the Lyndon words that can start a run that counts.

    Such a run repeats its root by ``side`` words at least on the right or on the
    left; windows of as many words, or somewhat fewer, are told apart by hashes.
    Other words may pass, too: they are extended in vain.
    """
    n, size = len(w), 1
    h = (np.array(w, "u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    while 2 * size <= side:
        h = h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]
        h ^= h >> np.uint64(32)
        size *= 2
    m = len(h)
    padded, start, period = np.append(h, np.uint64(0)), [], []
    for e in ends:
        end = np.array(e, "i8")
        right = np.flatnonzero(h == padded[np.minimum(end[:m], m)])
        left = np.flatnonzero(h[: n - size] == h[end[size:] - size]) + size
        for s in (right, left):
            start.append(s)
            period.append(end[s] - s)
    return sorted(set(zip(np.concatenate(start).tolist(), np.concatenate(period).tolist(), strict=True)))


def find_runs(w: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of the word numbers, by start, then period."""
    if len(w) < max(min_words, min_periods):
        return []
    same = Extensions(w)
    side = -(-min_words * (min_periods - 1) // (2 * min_periods))  # what a run has beyond its root, on the longer side
    last: dict[int, int] = {}  # period: end of the latest run of it
    out = []
    for i, p in _roots(w, lyndon_ends(w, same), side):
        if i + p <= last.get(p, 0):
            continue
        left = same.backward(i - 1, i + p - 1) if i else 0
        end = i + p + (same.forward(i, i + p) if i + p < len(w) else 0)
        last[p] = end
        length = end - i + left
        if length >= max(min_words, min_periods * p):
            out.append((i - left, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and collapsed of each row.

    ``collapsed`` is the text's words joined by one space, without those that
    a run holds after its first period.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(WORD).findall
        for batch in batches:
            counts, found, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = split(text or "")
                numbers: dict[str, int] = {}
                got = find_runs([numbers.setdefault(x, len(numbers)) for x in words], min_words, min_periods)
                counts.append(len(words))
                found.append([{"start": s, "length": k, "period": p} for s, k, p in got])
                if got:
                    keep = np.ones(len(words), bool)
                    for s, k, p in got:
                        keep[s + p : s + k] = False
                    words = [words[x] for x in np.flatnonzero(keep).tolist()]
                texts.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent and the hashes of all runs and of the collapsed text.

    Of runs with one exponent the first counts, of those that start together
    the one of the least period; exponents are compared as fractions.
    """
    # runs come by start and period, so only a greater exponent takes the place of an earlier run
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("best.length * 1000 div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, every tenth text (by the hash of its id) made periodic from some word on.

    With h the crc32 of the id, g = h div 10 and n words, each word i >= a of
    the rows where 10 divides h becomes word a + (i - a) % p, where a = g % n
    and p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    words = rows.withColumn("words", F.when(F.col("g").isNotNull(), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    n = F.size("words")
    cut = words.withColumn("n", n).withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int"))).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    periodic = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), F.col("n") - F.col("a")))
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))
