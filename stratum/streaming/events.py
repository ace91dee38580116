"""Event-time aggregates and session state, the same for a batch and a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total. A stream closes windows when the watermark has passed them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


TURN_STATE = "turns int, topic string"
TURN_OUT = "conv_id long, turns int, topic string"
KEPT_TURNS = 20
#: What str.split takes for spaces, and what it doesn't.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0  -     　"
SPACE, WORD = f"[{_SPACES}]", f"[^{_SPACES}]"


def evolve(turns: int, topic: str | None, rows: pd.DataFrame) -> tuple[int, str | None]:
    """State after more turns: how many are kept, and the topic, which a user's turn replaces unless it is short."""
    for role, text in zip(rows["role"], rows["text"]):
        turns = min(KEPT_TURNS, turns + 1)
        if role == "user" and text and len(text.split()) > 3:
            topic = text.split()[0]
    return turns, topic


def session_contexts(turns: DataFrame) -> DataFrame:
    """The context of each conversation after its turns; a stream gives it anew after each batch."""
    if not turns.isStreaming:
        # what evolve says of each turn in order, as aggregates: only the last topic counts
        sets = (F.col("role") == "user") & F.col("text").rlike(f"^{SPACE}*({WORD}+{SPACE}+){{3}}{WORD}")
        topic = F.max_by(F.regexp_extract("text", f"{WORD}+", 0), F.when(sets, F.col("turn")))
        return turns.groupBy("conv_id").agg(F.least(F.lit(KEPT_TURNS), F.count("*")).cast("int").alias("turns"), topic.alias("topic"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, topic = state.get if state.exists else (0, None)
        n, topic = evolve(n, topic, pd.concat(list(frames)).sort_values("turn"))
        state.update((n, topic))
        yield pd.DataFrame([(key[0], n, topic)], columns=["conv_id", "turns", "topic"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, TURN_OUT, TURN_STATE, "update", GroupStateTimeout.NoTimeout)
