"""Sessions of a stream of events, with state of our own: they close by timers, and late events are told apart."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A store that keeps state on disk and not in the heap; set spark.sql.streaming.stateStore.providerClass to it.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "begins array<bigint>, finishes array<bigint>, ns array<bigint>"


def widened(sessions: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sessions (begin, end, n) in order, those that touch made one."""
    new: list[tuple[int, int, int]] = []
    for begin, end, n in sorted(sessions):
        if new and begin < new[-1][1]:
            new[-1] = (new[-1][0], max(new[-1][1], end), new[-1][2] + n)
        else:
            new.append((begin, end, n))
    return new


def sessions_of(gap: timedelta):
    """The open sessions of a user, as (begin, end, n) with end a gap behind the last event, ordered and apart. An event
    widens the sessions that its own gap touches to one; a session closes when the watermark has passed its end. A user's
    state is one value, which travels with the user's rows, and the timer is that of the session which ends first."""
    micros = gap // timedelta(microseconds=1)

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        now = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut and not pd.isna(key[0]):
            held = widened([*held, *((t, t + micros, 1) for part in rows for t in part["at"].tolist())])
        done, left = [s for s in held if s[1] <= now], [s for s in held if s[1] > now]
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            # timers count milliseconds
            state.setTimeoutTimestamp(-(-min(s[1] for s in left) // 1000))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({"user": [key[0]] * len(done), "begin": [s[0] for s in done], "finish": [s[1] for s in done], "n": [s[2] for s in done]})

    return run


def stateful_sessions(events: DataFrame, time_col: str = "ts", user: str = "user_id", gap: timedelta = timedelta(minutes=30), delay: str = "10 minutes") -> DataFrame:
    """(user, session_start, session_end, n) of sessions that have closed, from a stream. Events that come later than the
    delay, behind the watermark, are left out by Spark; a session is given once, when no event can widen it any more. State
    holds open sessions only, so it follows the users that are active. Rows without a user move the clock on and have no
    sessions."""
    kinds = [events.schema[c].dataType.simpleString() for c in (user, time_col)]
    at = F.col(time_col).cast("timestamp")
    timed = events.select(F.col(user).alias("user"), at.alias("ts"), F.unix_micros(at).alias("at")).withWatermark("ts", delay)
    closed = timed.where("ts is not null").groupBy("user").applyInPandasWithState(sessions_of(gap), f"user {kinds[0]}, begin bigint, finish bigint, n bigint", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    when = lambda c: F.timestamp_micros(c).cast(kinds[1])
    return closed.select(F.col("user").alias(user), when("begin").alias("session_start"), when("finish").alias("session_end"), "n")
