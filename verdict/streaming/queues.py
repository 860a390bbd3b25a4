"""Streaming counterparts: daily quotas, sliding rate limits, and leases of jobs as a stateful fold.

These take streaming or batch DataFrames with an event time; on a stream, watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_quota(events: DataFrame, at: str, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """Events of each UTC day and key, as a tumbling window of a day."""
    marked = events.withWatermark(at, lateness) if events.isStreaming else events
    return marked.groupBy(F.window(at, "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), *keys, "n")


def attempts(events: DataFrame, at: str, keys: list[str], span: str = "10 minutes", step: str = "5 minutes", lateness: str = "1 hour") -> DataFrame:
    """Attempts of each key in sliding windows."""
    marked = events.withWatermark(at, lateness) if events.isStreaming else events
    return marked.groupBy(F.window(at, span, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


LEASE_STATE = "status string, attempts int, until timestamp"
LEASE_OUT = "job string, status string, attempts int"


def lease_step(state: tuple[str, int, pd.Timestamp | None], kind: str, at: pd.Timestamp, lease: pd.Timedelta, most: int) -> tuple[str, int, pd.Timestamp | None]:
    """A job after an event (claim, heartbeat, done, fail). An expired lease is settled first: at-least-once.

    queued -> leased by a claim; a lease that runs out, or a failure, gives queued again, or dead after `most` attempts.
    """
    status, tries, until = state
    if status == "leased" and until is not None and at > until:
        status, until = ("dead" if tries >= most else "queued"), None
    if kind == "claim" and status == "queued":
        return "leased", tries + 1, at + lease
    if status == "leased" and kind == "heartbeat":
        return status, tries, at + lease
    if status == "leased" and kind == "done":
        return "done", tries, None
    if status == "leased" and kind == "fail":
        return ("dead" if tries >= most else "queued"), tries, None
    return status, tries, until


def leases(events: DataFrame, *, lease: str = "5 minutes", most: int = 3, lateness: str = "1 hour", keep: str = "7 days") -> DataFrame:
    """The latest status of each job of a stream of events (job, kind, at), by a fold over keyed state.

    A lease that runs out is settled when the watermark passes its end, without another event. Jobs that are done or dead are
    forgotten `keep` after their last event, so state is bounded by the jobs that are open or recent.
    """
    span, kept = pd.Timedelta(lease), pd.Timedelta(keep)
    millis = lambda t: int(pd.Timestamp(t).timestamp() * 1000)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = tuple(state.get) if state.exists else ("queued", 0, None)
        now = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        if state.hasTimedOut:
            if own[0] in ("done", "dead"):
                state.remove()
                return
            own = lease_step(own, "", max(now, own[2] + pd.Timedelta("1ms")), span, most)
            last = now
        else:
            rows = pd.concat(list(frames)).sort_values("at", kind="stable")
            for r in rows.itertuples(index=False):
                own = lease_step(own, r.kind, r.at, span, most)
            last = rows["at"].iloc[-1]
        state.update(own)
        until = own[2] if own[0] == "leased" else last + kept if own[0] in ("done", "dead") else None
        if until is not None:
            state.setTimeoutTimestamp(max(millis(until), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "status": [own[0]], "attempts": [own[1]]})

    marked = events.withWatermark("at", lateness)
    return marked.groupBy("job").applyInPandasWithState(fold, LEASE_OUT, LEASE_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def leases_batch(events: DataFrame, *, lease: str = "5 minutes", most: int = 3) -> DataFrame:
    """The same fold over a whole batch, in one pass over each task's sorted events: only a job's state is held."""
    span = pd.Timedelta(lease)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, own = None, ("queued", 0, None)
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.job != job:
                    if job is not None:
                        out.append((job, *own[:2]))
                    job, own = r.job, ("queued", 0, None)
                own = lease_step(own, r.kind, r.at, span, most)
            yield pd.DataFrame(out, columns=["job", "status", "attempts"])
        if job is not None:
            yield pd.DataFrame([(job, *own[:2])], columns=["job", "status", "attempts"])

    ordered = events.where("job is not null").select("job", "kind", "at").repartition("job").sortWithinPartitions("job", "at", "kind")
    return ordered.mapInPandas(fold, LEASE_OUT)
