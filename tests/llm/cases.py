"""Odd rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(20_000))
LINE = "the quiet river runs below an old stone bridge where people meet on market days and sell fruit in small boats near town"
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", "b"), (5, "one", "de", "b"), (6, LINE, None, "b"), (7, LINE, "en", None),
    (8, LINE.replace("fruit", "fish"), "en", "c"), (9, f"{LINE}\n{LINE}\n\nother words here", "en", "c"), (10, LONG, "en", "a"), (11, "é漢🎉 <|endoftext|>", "fr", "a"),
    (12, "repeat row", "en", "a"), (12, "repeat row", "en", "a"), (None, "no id at all", "en", "a"), (13, LINE.upper() + "!!!", "en", "c"), (14, "one  two\rthree\x0bfour", "es", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=ROWS) -> DataFrame:
    """The rows, with extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("n_chars", "size", "kept", "id", "label", "score", "rid", "h")})


def empty(spark) -> DataFrame:
    return documents(spark).limit(0)
