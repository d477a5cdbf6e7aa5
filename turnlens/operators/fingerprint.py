"""One number for a table's rows in their order, without a sort of the whole.

The rows are read as digits of a number to a large base, modulo a prime, so
what two neighbouring stretches give is put together from their counts and
numbers alone. Ranges of the order go to tasks, each folds its rows once, and
the few results are combined in the order of the ranges: any split of the
table gives the same number, and two rows that change places another one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681 % ((1 << 61) - 1)


def folded(values: Iterable[int]) -> tuple[int, int]:
    """Count and number of a stretch."""
    n = number = 0
    for x in values:
        n, number = n + 1, (number * BASE + x) % MODULUS
    return n, number


def joined(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """Count and number of two stretches, one behind the other."""
    return a[0] + b[0], (a[1] * pow(BASE, b[0], MODULUS) + b[1]) % MODULUS


def fingerprint(rows: DataFrame, order: Sequence[str], content: str) -> DataFrame:
    """One row (n, number) of the strings in ``content`` by ``order``, which must tell the rows apart; null reads as empty."""
    digit = F.conv(F.substring(F.md5(F.coalesce(F.col(content).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    ranged = rows.select(*order, digit.alias("_digit")).repartitionByRange(*order).sortWithinPartitions(*order).select("_digit")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, number = folded(x for b in batches for x in b.column(0).to_pylist())
        if n:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "number": [number]})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, 0)
        for r in sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"]):
            total = joined(total, (r["n"], r["number"]))
        yield pa.RecordBatch.from_pydict({"n": [total[0]], "number": [total[1]]})

    parts = ranged.mapInArrow(fold, "part long, n long, number long")
    return parts.repartition(1).mapInArrow(combine, "n long, number long")  # a row a range
