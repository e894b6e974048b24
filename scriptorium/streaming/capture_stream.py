"""Structured Streaming over capture events: watermarked roll-ups, dedup, gaps across batches, snapshots, rate limits.

The lateness rule is ours: events more than ``LATE`` behind the newest are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """SRC-21: a folder of Parquet files as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling windows of an hour per event type; state is dropped behind the watermark."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", LATE).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """STR-01 over session windows: a session ends after a gap without events."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", LATE).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(0)).alias("pasted")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events", "pasted")


def first_seen(events: DataFrame) -> DataFrame:
    """STR-09: each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def _gaps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    ms = rows["ts"].astype("datetime64[ms]").astype("int64")
    before = ms.shift(1)
    if state.exists:
        before.iloc[0] = state.get[0]
    state.update((int(ms.iloc[-1]),))
    known = before.notna()
    yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"][known], "gap_ms": (ms[known] - before[known]).astype("int64")})


def keystroke_gaps(events: DataFrame) -> DataFrame:
    """STR-02: gaps between a session's keystrokes, the last one of each kept from batch to batch."""
    keys = events.where("event_type = 'click'").groupBy("user_id")
    return keys.applyInPandasWithState(_gaps, "user_id long, event_id long, gap_ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    out = []
    size = state.get[0] if state.exists else None
    for row in pd.concat(list(batches)).sort_values("ts").itertuples():
        now = int(row.size_now)
        kind = ("paste" if now > 5000 else "new") if size is None else "paste" if now - size > 2000 else "grown" if now > size else "delete" if now < size else "same"
        out.append((key[0], row.ts, kind))
        size = now
    state.update((size,))
    yield pd.DataFrame(out, columns=["path", "ts", "change"])


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """STR-05: (path, ts, size_now) snapshots as changes against each path's size before."""
    return snapshots.groupBy("path").applyInPandasWithState(_changes, "path string, ts timestamp, change string", "size long", "append", GroupStateTimeout.NoTimeout)


def rate_limiter(limit: int, window_ms: int = 60_000):
    """STR-10: per key, a window that starts at the first request after the last one's end."""

    def allow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            ms = row.ts.value // 1_000_000
            if start is None or ms - start >= window_ms:
                start, used = ms, 0
            used += 1
            out.append((key[0], row.event_id, used <= limit))
        state.update((int(start), int(used)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    return lambda requests: requests.groupBy("user_id").applyInPandasWithState(allow, "user_id long, event_id long, allowed boolean", "start long, used long", "append", GroupStateTimeout.NoTimeout)
