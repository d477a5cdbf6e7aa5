"""The number of a table is that of a serial fold, however the table is split."""

from __future__ import annotations

import hashlib

from turnlens.operators import fingerprint


def test_any_partitioning_gives_the_serial_fold(spark):
    rows = [(i * 7 % 501, f"text {i}" if i % 9 else None) for i in range(500)]
    digits = [int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16) for _, t in sorted(rows)]
    want = fingerprint.folded(digits)
    for n in (1, 3, 17):
        df = spark.createDataFrame(rows, "id long, text string").repartition(n)
        assert tuple(fingerprint.fingerprint(df, ["id"], "text").first()) == want
    swapped = [(b if i == a else a if i == b else i, t) for a, b in [(rows[0][0], rows[1][0])] for i, t in rows]
    assert tuple(fingerprint.fingerprint(spark.createDataFrame(swapped, "id long, text string"), ["id"], "text").first()) != want
    assert fingerprint.fingerprint(spark.createDataFrame([], "id long, text string"), ["id"], "text").collect() in ([], [(0, 0)])


def test_stretches_join_in_any_grouping():
    a, b, c = (fingerprint.folded(x) for x in ([5, 0, 9], [], [1, 2, 3, 4]))
    assert fingerprint.joined(fingerprint.joined(a, b), c) == fingerprint.joined(a, fingerprint.joined(b, c)) == fingerprint.folded([5, 0, 9, 1, 2, 3, 4])
