"""Live metering with Structured Streaming: event frames, usage, quotas.

Late data: rows more than a day behind the newest event time are dropped, as their quota period is closed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.shared import shared_folder

LATENESS = "1 day"
#: Milliseconds of a day.
DAY = 86_400_000


def shared_dir(spark: SparkSession) -> str:
    """A place of its own for a query's state and results, below the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it has written: tasks write Parquet, a folder for each batch.
    In complete mode the last batch counts, else all."""
    spark, place = stream.sparkSession, shared_dir(stream.sparkSession)
    last = [-1]

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/out/batch={number}")  # a batch that runs again writes the same
        last[0] = number

    spark.createDataFrame([], stream.schema).write.parquet(f"{place}/out/batch=-1")
    stream.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{place}/state").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out/batch={last[0]}" if mode == "complete" else f"{place}/out")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events below `path` as a stream, with the schema of the table."""
    # as a pattern, as a plain path of a stream has to be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def daily_calls(events: DataFrame) -> DataFrame:
    """user_id, day, calls: each event counts once, late ones up to a day."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"])
    counts = seen.groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("calls"))
    return counts.select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "calls")


def usage_meter(events: DataFrame) -> DataFrame:
    """stream_id, input and cache as maxima, output as the last: as the batch operator, in update mode."""
    z = lambda c: F.coalesce(F.max(c), F.lit(0)).alias(c)
    last = F.coalesce(F.max_by("output", F.when(F.col("output").isNotNull(), F.col("seq"))), F.lit(0)).alias("output")
    return events.groupBy("stream_id").agg(z("input"), z("cache_write"), z("cache_read"), last)


def complete_frames(buffer: str) -> tuple[list[str], str]:
    """The data of complete events in a buffer, and the rest that waits for more."""
    *full, rest = buffer.replace("\r\n", "\n").split("\n\n")
    out = []
    for frame in full:
        data = "\n".join(line[5:].removeprefix(" ") for line in frame.split("\n") if line.startswith("data:"))
        try:
            if data != "[DONE]" and isinstance(json.loads(data), dict):
                out.append(data)
        except ValueError:
            pass
    return out, rest


def frame_stream(chunks: DataFrame) -> DataFrame:
    """stream_id, data: events put together from chunks (stream_id, seq, chunk) that arrive in any batches.

    State: the tail without an end, the next number, and chunks that came before their turn.  It goes with the stream's
    closing [DONE]; where chunks have a time `ts`, also a day after the last one.
    """
    timed = "ts" in chunks.columns

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail, due, early = state.get if state.exists else ("", 0, "{}")
        held = {int(k): v for k, v in json.loads(early).items()}
        newest, closed = 0, False
        for part in frames:
            held |= dict(zip(part["seq"].astype(int).tolist(), part["chunk"], strict=True))
            if timed:
                newest = max(newest, int(part["ts"].max().timestamp() * 1000))
        out = []
        while due in held:
            # a line end may be cut in two: a lone return waits for what follows
            whole = tail + held.pop(due)
            found, tail = complete_frames(whole)
            closed = closed or "data: [DONE]\n" in whole.replace("\r\n", "\n")
            out += found
            due += 1
        if closed and not held:
            state.remove()
        else:
            state.update((tail, due, json.dumps(held)))
            if timed:
                state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + DAY)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "data": out})

    rows = chunks.withWatermark("ts", LATENESS) if timed else chunks
    return rows.groupBy("stream_id").applyInPandasWithState(step, "stream_id bigint, data string", "tail string, due int, early string", "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)


def in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A group's rows by time and event.  A group may come in several parts, as rows are handed over by the ten thousand,
    and its rows come in any order."""
    rows = pd.concat(list(parts))
    return rows.iloc[np.lexsort((rows["event_id"].to_numpy(), rows["ts"].to_numpy()))]


def allowed_calls(events: DataFrame, limit: int) -> DataFrame:
    """event_id, user_id, day, nth, ok: a user's calls of a day numbered as they come; check and count are one step.

    State: a user's counts of days that late calls can still come for.  One state a user, not one a day, as each costs
    its own call.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counts = dict(json.loads(state.get[0])) if state.exists else {}
        rows = in_order(frames)
        which, days = pd.factorize(rows["day"], use_na_sentinel=False)
        days = [None if pd.isna(d) else d for d in days]
        nth = np.empty(len(rows), np.int64)
        for k, day in enumerate(days):
            own = np.flatnonzero(which == k)
            before = counts.get(day, 0)
            nth[own] = before + 1 + np.arange(len(own))
            counts[day] = before + len(own)
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "user_id": key[0], "day": rows["day"].to_numpy(), "nth": nth, "ok": nth <= limit})
        now = state.getCurrentWatermarkMs()
        ends = {day: 0 if day is None else int(np.datetime64(day, "ms").astype(np.int64)) + 2 * DAY for day in counts}
        state.update((json.dumps([[day, n] for day, n in counts.items() if day is None or ends[day] > now]),))
        state.setTimeoutTimestamp(max(*ends.values(), now + 1))

    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rows.select("user_id", "event_id", "ts", "day").groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, day string, nth bigint, ok boolean", "days string", "append", GroupStateTimeout.EventTimeTimeout)


def current_only(results: DataFrame, versions: DataFrame) -> DataFrame:
    """Results whose source is still the one in use: stale ones fall away."""
    return results.join(versions, ["key", "version"], "left_semi")
