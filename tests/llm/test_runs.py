"""Periodic runs against every stretch of every period, and the contract's digests against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from tests.llm.cases import LONG, documents, empty
from turnlens.llm import periodic_runs
from turnlens.llm.common import WORD
from turnlens.llm.entry import op11_periodic_runs


def brute(w: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        x = 0
        while x + q < n:
            if w[x] != w[x + q]:
                x += 1
                continue
            s = x
            while x + q < n and w[x] == w[x + q]:
                x += 1
            part = w[s : x + q]
            if len(part) >= max(least, times * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng: random.Random) -> list[int]:
    n, kinds, w = rng.randint(0, 150), rng.choice([1, 2, 2, 3, 5, 40]), []
    while len(w) < n:
        if w and rng.random() < 0.4:
            w += w[-rng.randint(1, min(14, len(w))) :] * rng.randint(1, 6)
        else:
            w.append(rng.randrange(kinds))
    return w


def test_runs_of_random_words():
    rng, found = random.Random(11), 0
    for _ in range(2500):
        w = some_words(rng)
        least, times = rng.choice([(24, 3), (24, 3), (6, 2), (2, 2), (10, 4)])
        got = periodic_runs.find_runs(w, least, times)
        assert got == brute(w, least, times)
        found += len(got)
    assert found > 5000


def test_runs_of_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic_runs.find_runs(b, 2, 2) == brute(b, 2, 2)


def test_collisions_of_the_hash_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "MODULUS", 7)
    rng = random.Random(5)
    for _ in range(300):
        w = some_words(rng)
        # what collides lengthens an extension that the words then cut back
        assert periodic_runs.find_runs(w) == brute(w)


def test_long_periods_and_powers():
    for p in (1, 7, 900):
        w = [x % p for x in range(60_000)]
        assert periodic_runs.find_runs(w) == [(0, 60_000, p)]


def expected(rows: list[tuple]) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        w = re.findall(WORD, text or "")
        n = len(w)
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute(w)
        gone = {i for s, k, p in runs for i in range(s + p, s + k)}
        best = max(runs, key=lambda r: (1000000 * r[1] // r[2], -r[0], -r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def test_query_against_brute_force(spark, tmp_path):
    rng, rows = random.Random(3), []
    for i in range(400):
        rows.append((i, " ".join(f"w{x}" for x in some_words(rng)) if i % 7 else rng.choice([None, "", " \n ", "é\tô\x0bz"]), "en", "a"))
    rows += rows[:3]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400)) > 20
    assert sorted(got) == sorted(expected([r[:2] for r in rows]))


def test_odd_rows(spark):
    found = periodic_runs.digests(periodic_runs.runs(documents(spark)))
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == 16 and rows[1].n_runs == 0 and rows[1].start is None and rows[None].n_runs == 0
    assert rows[1].collapsed_sha256 == rows[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[10].n_runs == len(brute(LONG.split()[:3000])) == 0
    assert periodic_runs.digests(periodic_runs.runs(empty(spark))).collect() == []
