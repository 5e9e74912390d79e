"""Streams handed on as they come, with the meter read on the way; quotas of courses and lessons in one state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.growing import FirstElement
from .metering import DAY, LATENESS, complete_frames, in_order

OUT = "stream_id bigint, kind string, seq bigint, chunk string, input bigint, output bigint, broken boolean"


def metered(usage: list, frames: list[str]) -> tuple[list, bool]:
    """[input, output, whether any was seen] after the frames, and whether the stream has ended.  Input is the largest that
    was told, output the last."""
    ended = False
    for frame in frames:
        event = json.loads(frame)
        told = event.get("usage") or (event.get("message") or {}).get("usage") or {}
        if isinstance(told, dict) and told:
            usage = [max(usage[0], int(told.get("input_tokens") or 0)), int(told.get("output_tokens", usage[1]) or 0), True]
        ended = ended or event.get("type") == "message_stop"
    return usage, ended


def passed_through(chunks: DataFrame) -> DataFrame:
    """OUT: two outputs of one stream of chunks (stream_id, seq, chunk, ts), told apart by `kind`.

    Each chunk is handed on untouched when it comes, a repeated one once.  The meter reads chunks in their order and gives
    one row when the stream ends.  A stream that breaks is metered a day after its last chunk, so that what it used is
    counted; chunks after the end are handed on and not metered.  State goes with that day.
    """

    def row(key, usage, broken):
        return pd.DataFrame({"stream_id": [key], "kind": ["usage"], "seq": [None], "chunk": [None], "input": [usage[0]], "output": [usage[1]], "broken": [broken]})

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"tail": "", "due": 0, "early": {}, "usage": [0, 0, False], "closed": False}
        if state.hasTimedOut:
            if held["usage"][2] and not held["closed"]:
                yield row(key[0], held["usage"], True)
            state.remove()
            return
        newest = 0
        for part in parts:
            newest = max(newest, int(part["ts"].max().timestamp() * 1000))
            fresh = {}
            for seq, chunk in zip(part["seq"].astype(int).tolist(), part["chunk"], strict=True):
                if seq >= held["due"] and str(seq) not in held["early"] and seq not in fresh:
                    fresh[seq] = chunk
            if fresh:
                n = len(fresh)
                yield pd.DataFrame({"stream_id": [key[0]] * n, "kind": ["chunk"] * n, "seq": list(fresh), "chunk": list(fresh.values()), "input": [None] * n, "output": [None] * n, "broken": [None] * n})
            held["early"] |= {str(k): v for k, v in fresh.items()}
            while str(held["due"]) in held["early"]:
                frames, held["tail"] = complete_frames(held["tail"] + held["early"].pop(str(held["due"])))
                held["due"] += 1
                if not held["closed"]:
                    held["usage"], held["closed"] = metered(held["usage"], frames)
                    if held["closed"] and held["usage"][2]:
                        yield row(key[0], held["usage"], False)
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + DAY)

    rows = chunks.withWatermark("ts", LATENESS)
    return rows.groupBy("stream_id").applyInPandasWithState(step, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def first_concept_stream(chunks: DataFrame, name: str = "concepts") -> DataFrame:
    """stream_id, at, language, concept: as `growing.first_concepts`, while the chunks (with ts) come in.  State: the
    automaton's, the next number and chunks before their turn; a day after the last chunk it goes."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        scan_state, due, early = state.get if state.exists else ("", 0, "{}")
        scan, held, newest, out = FirstElement(name, scan_state), json.loads(early), 0, []
        for part in parts:
            newest = max(newest, int(part["ts"].max().timestamp() * 1000))
            held |= {str(k): v for k, v in zip(part["seq"].astype(int).tolist(), part["chunk"], strict=True) if k >= due}
        while str(due) in held:
            found = scan.feed(held.pop(str(due)) or "")
            if found is not None:
                out.append((key[0], due, scan.fields.get("language"), found))
            due += 1
        state.update((scan.state(), due, json.dumps(held)))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + DAY)
        yield pd.DataFrame(out, columns=["stream_id", "at", "language", "concept"])

    return chunks.withWatermark("ts", LATENESS).groupBy("stream_id").applyInPandasWithState(step, "stream_id bigint, at bigint, language string, concept string", "scan string, due int, early string", "append", GroupStateTimeout.EventTimeTimeout)


def period(ts: Column, trial: Column) -> Column:
    """The month that a call counts in; a trial is one period."""
    return F.when(trial, "trial").otherwise(F.date_format(ts, "yyyy-MM"))


VERDICTS = "event_id bigint, user_id bigint, period string, kind string, verdict string"


def quota_verdicts(calls: DataFrame) -> DataFrame:
    """event_id, user_id, period, kind, verdict of calls (event_id, user_id, ts, kind, trial, courses, lessons): ok while the
    user's courses or lessons of the period are within the plan's, else course_quota or lesson_quota.  Refused calls are
    not counted, so a call is in if it is among the first."""
    rows = calls.withColumn("period", period(F.col("ts"), F.col("trial")))
    nth = F.row_number().over(Window.partitionBy("user_id", "period", "kind").orderBy("ts", "event_id"))
    limit = F.when(F.col("kind") == "course", F.col("courses")).otherwise(F.col("courses") * F.col("lessons"))
    return rows.select("event_id", "user_id", "period", "kind", F.when(nth <= limit, "ok").otherwise(F.concat("kind", F.lit("_quota"))).alias("verdict"))


def quota_stream(calls: DataFrame) -> DataFrame:
    """VERDICTS while calls come in: courses and lessons of a user and period in one state, check and count in one step.  A
    month's state goes when its last late calls can have come; a trial's stays."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = dict(zip(("course", "lesson"), state.get if state.exists else (0, 0), strict=True))
        rows, verdicts = in_order(parts), []
        for kind, courses, lessons in zip(rows["kind"], rows["courses"], rows["lessons"], strict=True):
            ok = used[kind] < (courses if kind == "course" else courses * lessons)
            used[kind] += int(ok)
            verdicts.append("ok" if ok else f"{kind}_quota")
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "user_id": key[0], "period": key[1], "kind": rows["kind"].to_numpy(), "verdict": verdicts})
        state.update((used["course"], used["lesson"]))
        if key[1] != "trial":
            over = int((pd.Timestamp(f"{key[1]}-01", tz="UTC") + pd.DateOffset(months=1)).timestamp() * 1000) + 2 * DAY
            state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))

    rows = calls.withWatermark("ts", LATENESS).withColumn("period", period(F.col("ts"), F.col("trial")))
    return rows.groupBy("user_id", "period").applyInPandasWithState(step, VERDICTS, "courses bigint, lessons bigint", "append", GroupStateTimeout.EventTimeTimeout)
