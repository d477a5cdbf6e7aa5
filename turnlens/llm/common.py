"""Helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows handed to a Python worker at once; bounds a batch whatever the table's size.
BATCH_ROWS = 256


#: The session's setting by which shuffle files go when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; make one only where none is set (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut; shuffle files of the computation go at once."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    had = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, had) if had is not None else spark.conf.unset(CLEANUP)


def own_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` (docs, ...) -> rows with the columns of docs, safe from the caller's names: columns that operators add begin with an underscore, so those of the caller that do so have others meanwhile."""

    @wraps(stage)
    def run(docs: DataFrame, *args: object, **kwargs: object) -> DataFrame:
        theirs = [c for c in docs.columns if c.startswith("_")]
        if not theirs:
            return stage(docs, *args, **kwargs)
        mark = "caller"
        while any(c.lower().startswith(mark) for c in docs.columns):
            mark += "s"
        names = {c: f"{mark}{i}" for i, c in enumerate(theirs)}
        return stage(docs.withColumnsRenamed(names), *args, **kwargs).withColumnsRenamed({v: k for k, v in names.items()})

    return run


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session so long texts cannot fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def word_count(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of ids and labels that may be broadcast (a few dozen bytes each).
BROADCAST_ROWS = 250_000
#: Rows of ids and labels that a task takes; smaller results are not spread over more tasks.
TASK_ROWS = 100_000
#: A key with this part of all rows is hot; twice as many keys can be at most.
HOT_PARTS = 1024


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows of ids and labels, in no more tasks than those fill."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def kept_narrow(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut` of rows of ids and labels, and how many there are; later readers use few tasks for few rows."""
    df = cut(df)
    n = df.count()
    return narrow(df, n), n


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow, and cheap to count) with a broadcast hint if it has ``rows`` rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_by_size(rows: DataFrame, keys: DataFrame, on: str, size: str, total: int, n_keys: int) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, which has each value of ``on`` once and how many rows have it (``size``).

    A small ``keys`` (of ``n_keys`` rows) is broadcast. Beyond that only the hot keys are, those with at
    least 1/HOT_PARTS of the ``total`` rows, so that no task gets all rows of one key.
    """
    if n_keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on)
    hot = F.col(size) >= max(1000, total // HOT_PARTS)
    few = F.broadcast(keys.filter(hot))
    return rows.join(few, on).unionByName(rows.join(few.select(on), on, "left_anti").join(keys.filter(~hot), on))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of the edges (a, b), bigint; the label is the least node connected.

    Large-star and small-star rounds: each rewires neighbours to the least of
    them, by aggregates that combine before the shuffle and a join that broadcasts
    nodes of high degree, so a node of any degree spreads over tasks. Lineage is
    cut each round; only counts reach the driver.
    """

    def star(pairs: DataFrame, keep: Column, n: int) -> DataFrame:
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("c"))
        moved = join_by_size(pairs.filter(keep), least, "a", "c", n, n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")
        return narrow(narrow(moved, n).distinct(), n)

    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, n = kept_narrow(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        # settled once each node has one edge, to a node that has none
        roles = narrow(now, n).select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up")))).alias("r")).select("r.*")
        if not n or narrow(roles.groupBy("v").agg(F.sum("up").alias("u"), F.min("up").alias("low")).filter("u > 1 or (u > 0 and low = 0)"), n).isEmpty():
            break
        large = star(both(now), F.col("b") > F.col("a"), 2 * n)
        now, n = kept_narrow(star(large, F.lit(True), n))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(narrow(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct(), n))
