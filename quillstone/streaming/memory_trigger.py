"""Count-based memory trigger: one row whenever a session has gathered enough user messages for its agent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone import fixed_values as fixed
from quillstone.streaming.state import rocksdb

# Where an agent names no interval.
DEFAULT_INTERVAL = 10


def agent_interval(interval: Column) -> Column:
    """Messages per batch: the agent's own number within the allowed range, or the default."""
    bounded = F.greatest(F.lit(fixed.MEMORY_INTERVAL_MIN), F.least(F.lit(fixed.MEMORY_INTERVAL_MAX), interval))
    return F.when(interval.isNull(), F.lit(DEFAULT_INTERVAL)).otherwise(bounded).cast("long")


class _Counter(StatefulProcessor):
    """Messages and processed messages of one session; the state is two numbers and the batch's own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("messages", "total bigint, processed bigint, batches bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        total, processed, batches = self.state.get() if self.state.exists() else (0, 0, 0)
        total += int(batch["messages"].sum())
        interval = int(batch["interval"].iloc[-1])
        due = max(0, (total - processed) // interval)
        out = pd.DataFrame(
            {
                "agent_id": [batch["agent_id"].iloc[-1]] * due,
                "session_id": [key[0]] * due,
                "batch_no": [batches + i for i in range(due)],
                "processed": [processed + (i + 1) * interval for i in range(due)],
            }
        )
        self.state.update((total, processed + due * interval, batches + due))
        if due:
            yield out.astype({"agent_id": object, "session_id": object, "batch_no": "int64", "processed": "int64"})

    def close(self) -> None:
        pass


def memory_trigger_stream(messages: DataFrame, sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, session_id, batch_no, processed) for every full batch of user messages of a streaming message table.

    ``messages`` has session_id and role, ``sessions`` session_id and agent_id, ``agents`` agent_id, auto_memory_enabled
    and auto_memory_interval; ids are read as text. Sessions of agents that are unknown or not enabled trigger nothing.
    A micro-batch adds the messages of a session up before they go to its state, so a busy session is a few rows. A new
    interval holds from the next message on; what was processed stays so.
    """
    rocksdb(messages.sparkSession)
    enabled = agents.where("auto_memory_enabled").select(
        F.col("agent_id").cast("string").alias("agent_id"), agent_interval(F.col("auto_memory_interval")).alias("interval")
    )
    settings = sessions.select(F.col("session_id").cast("string").alias("session_id"), F.col("agent_id").cast("string").alias("agent_id")).join(enabled, "agent_id")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("session_id", sort=False).size().rename("messages").reset_index()

    users = messages.where((F.col("role") == "user") & F.col("session_id").isNotNull()).select(F.col("session_id").cast("string").alias("session_id"))
    sums = users.mapInPandas(counted, "session_id string, messages long").join(settings, "session_id")
    return sums.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Counter(),
        outputStructType="agent_id string, session_id string, batch_no long, processed long",
        outputMode="Append",
        timeMode="None",
    )
