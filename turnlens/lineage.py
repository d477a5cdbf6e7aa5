"""Keep a plan's result where several branches, or later rounds, read it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The session's setting by which shuffle files go when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once into the checkpoint folder that the session names (one of our own only where none is); shuffle files of the computation go at once."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="turnlens-"))
    had = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own: files of ``df``'s are left alone
    finally:
        spark.conf.set(CLEANUP, had) if had is not None else spark.conf.unset(CLEANUP)


#: Rows of keys and numbers that may be broadcast.
BROADCAST_ROWS = 250_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow, and cheap to count) with a broadcast hint if it has ``rows`` rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
