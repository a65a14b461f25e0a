"""Note reminders while conversations go on: the answer of ``dialogue.note_nudges`` after every batch of messages.

What a conversation's state holds does not grow with it: its last user message, what happened since then, and the calls
whose results have not come yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.operators.dialogue import EDIT_TOOLS, LASTING, READ_ONLY, shell_writes

STATE = "said boolean, lasting boolean, failed_at long, edited_at long, done boolean, open array<string>"


def nudge_updates(messages: DataFrame, note_tool: str, own_tools: str, reminder: str) -> DataFrame:
    """A stream of conv_id, reason for every conversation a batch touched; a null reason takes an earlier one back.

    ``messages`` as in ``dialogue.note_nudges``. A conversation's messages come in order of ``turn`` from batch to batch,
    in any order within one, as they do from a log; messages repeated within a batch change nothing.
    """
    call = (F.col("role") == "assistant") & F.col("tool").isNotNull()
    result, failed = F.col("role") == "toolResult", F.coalesce("is_error", F.lit(False))
    seen = messages.select(
        "conv_id",
        "turn",
        F.col("call_id"),
        (F.col("role") == "user").alias("user"),
        F.coalesce(F.rlike("text", F.lit(LASTING)), F.lit(False)).alias("lasting"),
        F.coalesce(call & ~F.col("tool").isin(READ_ONLY) & ~F.startswith("tool", F.lit(own_tools)) & shell_writes("arguments"), F.lit(False)).alias("writes"),
        F.coalesce(result & failed, F.lit(False)).alias("failed"),
        F.coalesce(result & ~failed, F.lit(False)).alias("worked"),
        F.coalesce(result & ~failed & F.col("tool").isin(EDIT_TOOLS), F.lit(False)).alias("edited"),
        F.coalesce(((F.col("role") == "custom") & F.col("kind").eqNullSafe(reminder)) | (call & F.col("tool").eqNullSafe(note_tool)), F.lit(False)).alias("done"),
    )

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        said, lasting, failed_at, edited_at, done, waiting = state.get if state.exists else (False, False, None, None, False, [])
        waiting = set(waiting)
        for m in pd.concat(list(frames)).sort_values("turn", kind="stable").itertuples(index=False):
            if m.user:
                said, lasting, failed_at, edited_at, done, waiting = True, bool(m.lasting), None, None, False, set()
                continue
            if not said:
                continue
            if m.writes and m.call_id is not None:
                waiting.add(m.call_id)
            done = done or bool(m.done)
            if m.failed and failed_at is None:
                failed_at = int(m.turn)
            if m.edited or (m.worked and m.call_id in waiting):
                edited_at = int(m.turn)
        state.update((said, lasting, failed_at, edited_at, done, sorted(waiting)))
        fixed = failed_at is not None and edited_at is not None and failed_at < edited_at
        reason = None if done or not said else "debugged" if fixed else "told" if lasting else None
        yield pd.DataFrame({"conv_id": [key[0]], "reason": pd.Series([reason], dtype=object)})

    kind = messages.schema["conv_id"].dataType.simpleString()
    return seen.groupBy("conv_id").applyInPandasWithState(fold, f"conv_id {kind}, reason string", STATE, "update", GroupStateTimeout.NoTimeout)


def follow_nudges(messages: DataFrame, table: str, state: str, note_tool: str, own_tools: str, reminder: str) -> None:
    """Take in the messages that have come and stop; run it again, or on a schedule. A batch that runs again after a
    failure writes its own partition once more."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    updates = nudge_updates(messages, note_tool, own_tools, reminder)
    query = updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def current_nudges(updates: DataFrame) -> DataFrame:
    """conv_id, reason: the conversations to remind now. ``updates``: the table with its ``batch`` column."""
    last = updates.groupBy("conv_id").agg(F.max_by(F.struct("reason"), "batch").alias("x"))
    return last.select("conv_id", "x.reason").filter("reason is not null")
