"""States of agents in sessions (waiting, running, complete, timed out), as a batch and as a stream with timers.

An agent's state follows from the first time it was queued, started and finished, so that neither the order in which events come
nor repeated ones matter. Own definition: an agent that isn't finished within the limit after its start is timed out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ACTIONS = ("queued", "started", "finished")
LIMIT_MS = 10_000
OUT = "session_id string, agent string, state string, at_ms long"


def agent_states(events: DataFrame, limit_ms: int = LIMIT_MS, horizon_ms: int | None = None) -> DataFrame:
    """``events`` (session_id, agent, action, at_ms) -> OUT, one row for each agent of a session: its state at ``horizon_ms`` (null: when all limits have passed) and since when. Events of an unknown action, or without a time, take no part."""
    known = events.where(F.col("action").isin(*ACTIONS) & F.col("at_ms").isNotNull())
    if horizon_ms is not None:
        known = known.where(F.col("at_ms") <= horizon_ms)
    first = known.groupBy("session_id", "agent").agg(*[F.min(F.when(F.col("action") == a, F.col("at_ms"))).alias(a) for a in ACTIONS])
    due = F.col("started") + limit_ms
    over = F.lit(True) if horizon_ms is None else F.lit(horizon_ms) > due
    late = F.col("started").isNotNull() & F.when(F.col("finished").isNull(), over).otherwise(F.col("finished") > due)
    state = F.when(late, "TIMED_OUT").when(F.col("finished").isNotNull(), "COMPLETE").when(F.col("started").isNotNull(), "RUNNING").otherwise("WAITING")
    since = F.when(late, due).otherwise(F.coalesce("finished", "started", "queued"))
    return first.select("session_id", "agent", state.alias("state"), since.alias("at_ms"))


class _Agent(StatefulProcessor):
    """The first times of an agent's events, what was last said of it, and the timer that is set."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("agent", "queued long, started long, finished long, said string, timer long")

    def _said(self, queued: int | None, started: int | None, finished: int | None) -> tuple[str, int]:
        if started is not None and finished is not None and finished > started + self.limit_ms:
            return "TIMED_OUT", started + self.limit_ms
        if finished is not None:
            return "COMPLETE", finished
        return ("RUNNING", started) if started is not None else ("WAITING", queued or 0)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = list(self.held.get()) if self.held.exists() else [None, None, None, "", None]
        first, said, timer = held[:3], held[3], held[4]
        for row in rows:
            i = ACTIONS.index(row.action)
            first[i] = row.at_ms if first[i] is None else min(first[i], row.at_ms)
        state, at = self._said(*first)
        # When to look again: at the limit of a start, or when no event of what is over can come any more.
        look = (first[1] + self.limit_ms + 1) if state == "RUNNING" else at + self.limit_ms + 1 if state != "WAITING" else None
        if look != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if look is not None:
                self.handle.registerTimer(look)
        self.held.update((*first, f"{state} {at}", look))
        if said != f"{state} {at}":
            yield Row(session_id=key[0], agent=key[1], state=state, at_ms=at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        queued, started, finished, *_ = self.held.get() if self.held.exists() else (None,) * 5
        self.held.clear()
        if started is not None and finished is None:
            yield Row(session_id=key[0], agent=key[1], state="TIMED_OUT", at_ms=started + self.limit_ms)

    def close(self) -> None:
        pass


def stream_agent_states(stream: DataFrame, limit_ms: int = LIMIT_MS, late: str = "30 seconds") -> DataFrame:
    """``stream`` (session_id, agent, action, ts) -> OUT, a row for each change of a state; the last of an agent is the batch form's. Events more than ``late`` behind are left out. Needs the RocksDB state store.

    What is complete or timed out is forgotten once the watermark has passed it by the limit, so that state doesn't grow with the sessions seen.
    """
    known = stream.where(F.col("action").isin(*ACTIONS) & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = known.select("session_id", "agent", "action", "ts", F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("session_id", "agent").transformWithState(_Agent(limit_ms), OUT, "Update", "EventTime")
