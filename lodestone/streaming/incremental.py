"""Increment- and time-driven operators: item-granular reuse, leases, history logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changes(previous: DataFrame, current: DataFrame, key: str = "key", value: str = "artifact") -> DataFrame:
    """key, value, status of current items: hit (unchanged) or miss (new or changed)."""
    old = previous.select(key, F.col(value).alias("_old"))
    same = F.col(value).eqNullSafe(F.col("_old")) & F.col("_there").isNotNull()
    return current.select(key, value).join(old.withColumn("_there", F.lit(True)), key, "left").select(key, value, F.when(same, "hit").otherwise("miss").alias("status"))


def incremental_map(previous: DataFrame, current: DataFrame, work: Callable[[DataFrame], DataFrame], key: str = "key", value: str = "artifact", result: str = "result") -> DataFrame:
    """key, value, result, status; work runs on missed items only, hits keep their previous result.

    previous has key, value, result. work gets key and value and returns key and result.
    """
    status = changes(previous, current, key, value)
    hits = status.where("status = 'hit'").join(previous.select(key, result), key).select(key, value, result, "status")
    missed = status.where("status = 'miss'")
    return hits.unionByName(missed.join(work(missed.select(key, value)), key).select(key, value, result, "status"))


def changed_stream(items: DataFrame, key: str = "key", value: str = "artifact", time: str | None = None, within: str | None = None) -> DataFrame:
    """Of a stream of (key, value), each pair once: what has to be worked on.

    Without a bound every pair is remembered for good. With time (an event-time column) and
    within (such as '2 days'), a pair is remembered for that long only, so state stays bounded.
    """
    if time is None or within is None:
        return items.dropDuplicates([key, value])
    return items.withWatermark(time, within).dropDuplicatesWithinWatermark([key, value])


def latest_state(events: DataFrame, key: str, time: str, fields: list[str]) -> DataFrame:
    """Update-mode view of an append-only log: each key's last record by time."""
    last = F.max_by(F.struct(*fields), F.struct(time, *fields))
    return events.groupBy(key).agg(last.alias("r"), F.max(time).alias(time)).select(key, time, "r.*")


LEASE_OUT = "id string, state string, expires_at timestamp"


def lease_stream(events: DataFrame) -> DataFrame:
    """Lease states from a stream of (id, op, at, ttl_seconds): created, renewed, released or expired.

    op is create, renew (from its time) or release; a missing ttl is an hour. Expiry comes by
    event time, so the stream needs a watermark on ``at``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            (expires,) = state.get
            out.append((key[0], "expired", pd.Timestamp(expires, unit="us")))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "op"])
            expires = state.get[0] if state.exists else None
            for r in rows.itertuples():
                now = int(r.at.value // 1000)
                if expires is not None and expires <= now:
                    out.append((key[0], "expired", pd.Timestamp(expires, unit="us")))
                    expires = None
                if r.op == "release":
                    if expires is not None:
                        out.append((key[0], "released", r.at))
                    expires = None
                elif r.op == "create" or expires is not None:
                    ttl = 3600 if pd.isna(r.ttl_seconds) else int(r.ttl_seconds)
                    out.append((key[0], "renewed" if expires is not None else "created", r.at + pd.Timedelta(seconds=ttl)))
                    expires = now + ttl * 1_000_000
            if expires is None:
                if state.exists:
                    state.remove()
            else:
                state.update((expires,))
                state.setTimeoutTimestamp(max(expires // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "state", "expires_at"])

    return events.groupBy("id").applyInPandasWithState(step, LEASE_OUT, "expires long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What an append stream yields from all input there is now, as Parquet below folder (shared by all executors).

    The same folder goes on where it stopped, exactly once for each row.
    """
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
