"""Exact duplicates by two passes over a Bloom filter of hashes. [native]

Pass 1 hashes every text and counts, for each cell of a register-blocked
Bloom filter, how many texts set it; the cells set twice make up the filter.
Pass 2 probes it: a text with a cell that only it set cannot have a copy, so
its row passes straight through. Only the other rows, as digests, meet in a
shuffle, which settles them exactly.

Defined results: a null text counts as empty; empty texts are copies of each
other. The row with the largest id of each group stays (a null id is below
any other). Of rows that repeat both id and text one stays. Very long texts are
hashed whole. An empty table gives no rows. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import BROADCAST_ROWS, cut, join_by_size, kept_narrow, own_names

#: Filter cells for each row; 2 of 16 leave about 1.4 % of unrepeated rows to the exact pass.
CELLS_PER_ROW = 16
#: 64-bit registers of a filter that is broadcast (at most 16 MB of keys and bits).
MAX_BROADCAST_REGISTERS = 1 << 20


def _registers(rows: int) -> int:
    n = 64
    while n * 64 < rows * CELLS_PER_ROW:
        n *= 2
    return n


def registers_for(keys: int) -> int:
    """Registers of a filter to broadcast: CELLS_PER_ROW bits a key, up to the bound."""
    return min(_registers(keys), MAX_BROADCAST_REGISTERS)


def probe(hashed: Column, registers: int) -> tuple[Column, Column]:
    """The register of a 64-bit hash, and the two bits it sets there."""
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, at).bitwiseAND(F.lit(63)).cast("int"))
    return hashed.bitwiseAND(F.lit(registers - 1)), bit(58).bitwiseOR(bit(52))


def _flagged(rows: DataFrame, hashed: str, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with _maybe: whether the 64-bit hash may be among ``keys``, by a Bloom filter of bounded size, broadcast."""
    registers = registers_for(keys.count())
    register, mask = probe(F.col(key), registers)
    bits = keys.select(register.alias("_reg"), mask.alias("_mask")).groupBy("_reg").agg(F.expr("bit_or(_mask)").alias("_bits"))
    register, mask = probe(F.col(hashed), registers)
    met = rows.withColumns({"_reg": register, "_mask": mask}).join(F.broadcast(bits), "_reg", "left")
    return met.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))).drop("_reg", "_mask", "_bits")


def maybe_in(rows: DataFrame, hashed: str, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose 64-bit hash may be among ``keys``.

    No row of a key is lost; a few others pass. ``keys`` is read twice.
    """
    return _flagged(rows, hashed, keys, key).filter("_maybe").drop("_maybe")


def split_by(rows: DataFrame, hashed: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose hash is surely not among ``keys``, and those that :func:`maybe_in` lets pass."""
    flagged = _flagged(rows, hashed, keys, key)
    return flagged.filter("not _maybe").drop("_maybe"), flagged.filter("_maybe").drop("_maybe")


def _plain(normalize: Callable[[Column], Column] | None, text_col: str) -> Column:
    text = F.col(text_col)
    return F.coalesce(normalize(text) if normalize else text, F.lit(""))


def _bits(hashed: str) -> list[Column]:
    """The numbers of the two bits that a hash sets in its register; the same as in :func:`probe`."""
    return [F.shiftrightunsigned(hashed, at).bitwiseAND(F.lit(63)).cast("int") for at in (58, 52)]


def repeated_cells(digests: DataFrame, registers: int) -> DataFrame:
    """(_reg, _twice): the filter cells that two rows or more set."""
    return (
        digests.select(probe(F.col("_h"), registers)[0].alias("_reg"), F.explode(F.array_distinct(F.array(*_bits("_h")))).alias("_bit"))
        .groupBy("_reg", "_bit").agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .groupBy("_reg").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_twice"))
    )


def _flags(docs: DataFrame, normalize: Callable[[Column], Column] | None, id_col: str, text_col: str) -> DataFrame:
    """:func:`flag_copies` with _h, the 64-bit hash of the text."""
    texts = docs.select(F.col(id_col).alias("doc_id"), _plain(normalize, text_col).alias("_t"))
    # The digests are a few dozen bytes a row; kept, so that texts are read and hashed once, and rows stay numbered.
    digests = cut(texts.select("doc_id", F.xxhash64("_t").alias("_h"), F.sha2(F.col("_t"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")))
    rows = digests.count()
    registers = _registers(rows)
    if registers <= MAX_BROADCAST_REGISTERS:
        register, mask = probe(F.col("_h"), registers)
        met = digests.withColumn("_reg", register).join(F.broadcast(repeated_cells(digests, registers)), "_reg", "left")
        probed = met.withColumn("_maybe", F.coalesce("_twice", F.lit(0)).bitwiseAND(mask) == mask).drop("_reg", "_twice")
    else:
        # A filter of all rows would not fit a task: their hashes alone are counted, combined before the
        # shuffle, and the repeated ones fill a filter of bounded size.
        probed = _flagged(digests, "_h", cut(digests.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")), "_h")
    alone = probed.filter("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "_h")
    maybe = probed.filter("_maybe").drop("_maybe")
    # of rows that repeat id and text the first stays
    top = F.max(F.struct("doc_id", (-F.col("_row")).alias("_first")))
    groups, n_groups = kept_narrow(maybe.groupBy("text_sha256").agg(top.alias("_top"), F.count(F.lit(1)).alias("group_size")))
    groups = groups.select("text_sha256", F.col("_top.doc_id").alias("keep_id"), F.col("_top._first").alias("_first"), "group_size")
    settled = join_by_size(maybe, groups, "text_sha256", "group_size", rows, n_groups).withColumn("kept", F.col("_row") == -F.col("_first"))
    return alone.unionByName(settled.select(*alone.columns))


def flag_copies(docs: DataFrame, normalize: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _flags(docs, normalize, id_col, text_col).drop("_h")


@own_names
def drop_copies(docs: DataFrame, normalize: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are copies, all columns kept.

    Rows to drop are told by id and hash. Where these are too many to broadcast, a
    Bloom filter of them lets all other rows pass straight through, so that texts of
    documents without a copy never travel.
    """
    return without(docs, _flags(docs, normalize, id_col, text_col), F.xxhash64(_plain(normalize, text_col)), id_col)


def without(docs: DataFrame, flags: DataFrame, hashed: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``flags`` (doc_id, _h, kept: one row for each) keeps; ``hashed`` is the _h of a row of ``docs``."""
    gone, n = kept_narrow(flags.groupBy(F.col("doc_id").alias("_gid"), F.col("_h").alias("_gh")).agg(F.max("kept").alias("_one"), F.min("kept").alias("_all")).filter("not _all").drop("_all"))
    gone = gone.withColumn("_key", F.xxhash64("_gid", "_gh"))
    rows = docs.withColumn("_gh", hashed).withColumn("_key", F.xxhash64(F.col(id_col), "_gh"))
    clear, some = split_by(rows, "_key", gone, "_key")
    # a null id is equal to itself
    same = (rows[id_col].eqNullSafe(gone["_gid"])) & (some["_key"] == gone["_key"]) & (some["_gh"] == gone["_gh"])
    met = some.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, same, "left").drop(gone["_gh"], gone["_key"])
    stay = met.filter("_one is null").select(*docs.columns)
    one = met.filter("_one").dropDuplicates(["_gh", "_gid"]).select(*docs.columns)  # a row given twice
    return clear.select(*docs.columns).unionByName(stay).unionByName(one)
