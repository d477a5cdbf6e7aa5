"""Sources by name: each is a function (spark, path, limit) -> samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.sources import qa, scan

Source = Callable[..., DataFrame]
_SOURCES: dict[str, Source] = {}
#: Sources that take the limit themselves and stop reading at it.
_EARLY: set[str] = set()


def register(name: str, source: Source, early: bool = False) -> None:
    name = name.strip().lower()
    _SOURCES[name] = source
    (_EARLY.add if early else _EARLY.discard)(name)


def available() -> list[str]:
    return sorted(_SOURCES)


def load(spark: SparkSession, name: str, path: str | None = None, limit: int | None = None) -> DataFrame:
    """Samples (id, question, answer, context, meta) of a named source.

    An unknown name is a ValueError; a source that yields nothing, or fails to
    read, is a RuntimeError: no other data stands in for it. The limit takes
    the first samples by id, or of the files where the source stops early.
    """
    name = name.strip().lower()
    source = _SOURCES.get(name)
    if source is None:
        raise ValueError(f"unknown source {name!r}; one of {available()}")
    try:
        if name in _EARLY:
            out = source(spark, path, limit)
        else:
            out = source(spark, path) if path is not None else source(spark)
            out = out if limit is None else out.orderBy("id").limit(limit)
        empty = out.isEmpty()
    except Exception as e:
        raise RuntimeError(f"source {name!r} could not be read: {e}") from e
    if empty:
        raise RuntimeError(f"source {name!r} has no samples")
    return out


register("questions", qa.questions_json)
register("paper", qa.papers)
register("multihop", qa.multihop)
register("chunks", qa.corpus_chunks)
register("articles", qa.articles)
register("documents", qa.doc_qa)
register("abstracts", qa.abstracts)
register("synthetic", lambda spark, path=None, n=5: qa.synthetic(spark, n))
register("passages", lambda spark, path: qa.passages(spark, path).select("id", F.lit("").alias("question"), F.lit("").alias("answer"), F.array("text").alias("context"), qa.no_meta()))
register("lines", scan.samples, early=True)
