"""An extension: the controller and the outcome profile over live turns.

The batch engine covers everything that needs no clock; these keep the same
rules over a stream. Late turns are bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnlens.functions import vocab
from turnlens.operators.control import SHIFT_EVERY

STATE = "last string, n_correct long, turn_id long"
OUT = "conversation_id long, turn_id long, outcome string, next_type string"


def next_type(outcome: str, last: str, n_correct: int, turn_id: int) -> str:
    """The rules of the column in ``operators.control``, for one turn."""
    hard = vocab.ESCALATION
    again = "Follow-Up" if turn_id % 2 else "Clarification"
    harder = hard[n_correct % len(hard)] if n_correct % SHIFT_EVERY else "Topic Shift"
    wanted = {"wrong": "Correction", "hallucinated": "Unanswerable", "abstained": again}.get(outcome, harder)
    if wanted == last or (wanted == "Follow-Up" and last in ("Clarification", *hard)):
        return "Comparative" if last == "Clarification" else "Clarification"
    return wanted


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, n, turn = state.get if state.exists else ("Seed", 0, -1)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for outcome in rows["outcome"]:
        turn += 1
        n += outcome == "correct"
        last = next_type(outcome, last, n, turn)
        out.append((key[0], turn, outcome, last))
    state.update((last, int(n), int(turn)))
    yield pd.DataFrame(out, columns=["conversation_id", "turn_id", "outcome", "next_type"])


def controller(turns: DataFrame) -> DataFrame:
    """The next type after each turn of a stream (conversation_id, ts, event_id, outcome); state is three values a conversation."""
    return turns.groupBy("conversation_id").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def profile(turns: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Outcomes by window of event time."""
    return turns.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "outcome").agg(F.count(F.lit(1)).alias("n"))
