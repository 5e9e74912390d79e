"""Streams run over all that is there, with the SQL of their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import growing as G
from ..streaming import metering as S
from ..streaming import passthrough as P
from . import derived as D
from . import metering_queries


def stream(spark, sf_dir, name):
    return S.event_stream(spark, f"{sf_dir}/{name}.parquet")


def stream_daily_calls(spark, sf_dir):
    return S.finished(S.daily_calls(stream(spark, sf_dir, "events")), "complete")


def stream_quota(spark, sf_dir):
    rows = S.finished(S.allowed_calls(stream(spark, sf_dir, "events"), 3), "append")
    return rows.groupBy("user_id", "day").agg(F.count_if("ok").alias("allowed"), F.count_if(~F.col("ok")).alias("refused"))


def stream_usage_meter(spark, sf_dir):
    """Usage of streams while it comes in."""
    return S.finished(S.usage_meter(D.USAGE.over(events=stream(spark, sf_dir, "events"))), "complete")


def stream_frames(spark, sf_dir):
    """Event frames put together from the chunks of a stream."""
    rows = S.finished(S.frame_stream(D.SSE.over(conversations=stream(spark, sf_dir, "conversations"))), "append")
    return rows.select("stream_id", F.regexp_replace("data", r"\s", "").alias("data"))


def prefetch_discard(spark, sf_dir):
    """Results that were fetched ahead, without those whose source has changed since."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    results = e.select("event_id", F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("version"))
    versions = e.select(F.col("user_id").alias("key"), (F.col("user_id") % 3).alias("version")).distinct()
    return S.current_only(results, versions).select("event_id", "key", "version")


def timed(rows):
    """An hour for each stream, so that old streams time out while newer ones come in."""
    return rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("stream_id") * 3600))


def stream_passthrough(spark, sf_dir):
    """What each stream has handed on, and what its meter says; streams that broke long ago are metered as well."""
    chunks = timed(D.ANSWER_CHUNKS.over(conversations=stream(spark, sf_dir, "conversations")))
    rows = S.finished(P.passed_through(chunks), "append")
    usage = F.col("kind") == "usage"
    sizes = F.sum(F.when(~usage, F.char_length("chunk"))).cast("long")
    return rows.groupBy("stream_id").agg(F.count_if(~usage).alias("chunks"), sizes.alias("chars"), F.max("input").alias("input"), F.max("output").alias("output"), F.max(F.when(usage, F.col("broken"))).alias("broken"), F.count_if(usage).alias("metered"))


def stream_first_concept(spark, sf_dir):
    """The first concept of plans that are still being written."""
    rows = S.finished(P.first_concept_stream(timed(D.PLAN_CHUNKS.over(conversations=stream(spark, sf_dir, "conversations")))), "append")
    return rows.select("stream_id", "at", "language", F.md5("concept").alias("concept"))


def first_concept(spark, sf_dir):
    rows = G.first_concepts(D.PLAN_CHUNKS.df(spark, sf_dir))
    return rows.select("stream_id", "at", "language", F.md5("concept").alias("concept"))


def stream_quota_verdicts(spark, sf_dir):
    """Verdicts on calls for courses and lessons, as they come."""
    calls = D.CALLS.over(events=stream(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return S.finished(P.quota_stream(calls), "append").select("event_id", "user_id", "period", "kind", "verdict")


def quota_verdicts(spark, sf_dir):
    return P.quota_verdicts(D.CALLS.df(spark, sf_dir))


def valid_visuals(spark, sf_dir):
    """Figures that can be drawn."""
    return G.visuals(D.FIGURE_SPECS.df(spark, sf_dir), "id", "spec")


def lesson_opening(spark, sf_dir):
    """What a lesson that is still being written can open with."""
    rows = D.LESSONS.df(spark, sf_dir).withColumn("o", G.opening(F.col("lesson")))
    get = lambda path: F.get_json_object("o", path)
    return rows.select("id", get("$.hook.text").alias("hook"), get("$.prediction.question").alias("prediction"), get("$.explore.insight").alias("insight"), F.json_array_length(get("$.cards")).cast("long").alias("cards"), G.worth_showing(F.col("lesson")).alias("worth"))


QUERIES = {k.__name__: k for k in (stream_daily_calls, stream_quota, stream_usage_meter, stream_frames, prefetch_discard, stream_passthrough, stream_first_concept, first_concept, stream_quota_verdicts, quota_verdicts, valid_visuals, lesson_opening)}
SQL_CONCEPT = f"""SELECT a.stream_id, b.seq AS at, 'L' || a.stream_id AS language, md5('{{"name": "' || regexp_extract(a.chunk, '"concepts": \\[\\{{"name": "(.*)", "descr$', 1, 's') || '", "description": "' || regexp_extract(b.chunk, '^iption": "(.*)", "parts"', 1, 's') || '", "parts": [1, {{"a": "}}]"}}]}}') AS concept
FROM {D.PLAN_CHUNKS.sql} a JOIN {D.PLAN_CHUNKS.sql} b ON a.stream_id = b.stream_id AND a.seq = 0 AND b.seq = 1"""
SQL_VERDICTS = f"""SELECT event_id, user_id, period, kind, CASE WHEN row_number() OVER (PARTITION BY user_id, period, kind ORDER BY ts, event_id) <= CASE WHEN kind = 'course' THEN courses ELSE courses * lessons END THEN 'ok' ELSE kind || '_quota' END AS verdict
FROM (SELECT *, CASE WHEN trial THEN 'trial' ELSE strftime(ts, '%Y-%m') END AS period FROM {D.CALLS.sql})"""
ORACLE = {
    "stream_daily_calls": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT event_id) AS calls FROM events GROUP BY ALL",
    "stream_quota": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, least(count(*), 3) AS allowed, greatest(count(*) - 3, 0) AS refused FROM events GROUP BY ALL",
    "stream_usage_meter": metering_queries.ORACLE["stream_meter"],
    "stream_frames": metering_queries.ORACLE["sse_frames"],
    "stream_passthrough": f"""WITH c AS (SELECT stream_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars, count(*) FILTER (seq = 3) = 1 AS ended, max(seq) AS last FROM {D.ANSWER_CHUNKS.sql} GROUP BY 1),
u AS (SELECT conv_id AS stream_id, arg_max(10 * turn + length(text), turn) FILTER (turn BETWEEN 1 AND least(2, last - 1)) AS seen, max(40 + length(text)) FILTER (turn = 3) AS closing FROM conversations JOIN c ON c.stream_id = conv_id GROUP BY 1)
SELECT stream_id, chunks, chars, CASE WHEN m THEN 100 + stream_id END AS input, CASE WHEN NOT m THEN NULL WHEN ended THEN closing ELSE coalesce(seen, 1) END AS output, CASE WHEN m THEN NOT ended END AS broken, CAST(m AS BIGINT) AS metered FROM (SELECT *, ended OR (last > 0 AND stream_id + 48 < max(stream_id) OVER ()) AS m FROM c) JOIN u USING (stream_id)""",
    "stream_first_concept": SQL_CONCEPT,
    "first_concept": SQL_CONCEPT,
    "stream_quota_verdicts": SQL_VERDICTS,
    "quota_verdicts": SQL_VERDICTS,
    "valid_visuals": "SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'flow' WHEN 1 THEN 'bar' WHEN 3 THEN 'group' WHEN 7 THEN 'timeline' ELSE 'slider' END AS type FROM events WHERE CASE event_id % 9 WHEN 0 THEN event_id % 2 = 0 WHEN 1 THEN event_id % 4 <> 1 WHEN 3 THEN event_id % 2 = 0 WHEN 7 THEN event_id % 2 = 0 WHEN 8 THEN event_id % 5 < 3 AND event_id % 7 <> 0 ELSE false END",
    "lesson_opening": f"SELECT id, CASE WHEN json_valid(lesson) THEN json_extract_string(CASE WHEN json_valid(lesson) THEN lesson END, '$.hook.text') END AS hook, json_extract_string(CASE WHEN json_valid(lesson) THEN lesson END, '$.prediction.question') AS prediction, CAST(json_extract(CASE WHEN json_valid(lesson) THEN lesson END, '$.explore.insight') AS VARCHAR) AS insight, CASE WHEN json_type(CASE WHEN json_valid(lesson) THEN lesson END) = 'OBJECT' THEN 0 END AS cards, id % 1000 % 4 = 0 AS worth FROM {D.LESSONS.sql}",
    "prefetch_discard": "SELECT event_id, user_id AS key, event_id % 3 AS version FROM events WHERE event_id % 3 = user_id % 3",
}
