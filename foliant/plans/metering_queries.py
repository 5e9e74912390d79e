"""Queries over calls, usage and quotas, with their SQL.  Events stand for calls, turns of conversations for blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metering as M
from . import derived as D

SUBSCRIPTIONS, CAPS, CONTENT, USAGE, SSE, PROMPTS, REQUESTS = D.SUBSCRIPTIONS, D.CAPS, D.CONTENT, D.USAGE, D.SSE, D.PROMPTS, D.REQUESTS


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def tier_dim_join(spark, sf_dir):
    subs = SUBSCRIPTIONS.df(spark, sf_dir).withColumn("trialing", F.col("status") == "trialing")
    return M.with_tier(subs, M.TIERS.df(spark, sf_dir)).select("user_id", "tier", "courses", (F.col("courses") * F.col("lessons_per_course")).alias("lessons"), "read_chars", "model_lesson")


def classify_calls(spark, sf_dir):
    kind = M.call_kind(F.col("max_tokens"))
    return CAPS.df(spark, sf_dir).select("id", kind.alias("kind"), M.output_cap(kind).alias("cap"))


def entitlement_gate(spark, sf_dir):
    now = F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    end = F.timestamp_add("DAY", F.col("days").cast("int"), now)
    gate = M.entitlement(F.col("status"), end, now, F.col("confirmed"))
    return SUBSCRIPTIONS.df(spark, sf_dir).select("user_id", gate["status"].alias("code"), gate["code"].alias("reason"))


def request_validation(spark, sf_dir):
    """Each conversation as a request: its messages, the task it names."""
    rows = REQUESTS.df(spark, sf_dir).groupBy("conv_id").agg(F.min("task").alias("task"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda m: m["content"]).alias("contents"))
    return rows.select("conv_id", M.request_verdict(F.col("contents"), F.col("task")).alias("verdict"))


def content_check(spark, sf_dir):
    rows = CONTENT.df(spark, sf_dir).withColumn("b", M.content_blocks(F.col("content"))).filter("b is not null")
    return rows.select("id", F.size("b").cast("long").alias("n"), F.array_join("b", "|").alias("texts"))


def clamp_running_budget(spark, sf_dir):
    rows = M.running_clamp(turns(spark, sf_dir), "conv_id", "turn", "text", F.lit(1500))
    return rows.select("conv_id", "turn", "kept", "left")


def cache_marks(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.char_length("text").cast("long").alias("chars"), F.element_at(F.array(*(F.lit(m) for m in ("small", "medium", "large"))), (F.col("conv_id") % 3 + 1).cast("int")).alias("model"))
    return M.cache_marks(rows, "conv_id", "turn", "chars", F.col("model")).select("conv_id", "turn", "prefix", "mark")


def lesson_blocks(spark, sf_dir):
    rows = turns(spark, sf_dir).filter("turn < 4").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("n"), F.repeat("text", 12).alias("text"))
    return M.lesson_blocks(rows, F.lit("medium"), F.lit(2400)).select("call_id", "n", "chars", "prefix", "mark")


def course_size(spark, sf_dir):
    return PROMPTS.df(spark, sf_dir).select("id", M.fix_course_size(F.col("text"), 8).alias("text"))


def usage_totals(spark, sf_dir):
    return M.usage_of(USAGE.df(spark, sf_dir)).select("stream_id", "seq", "total_read", "hit")


def stream_meter(spark, sf_dir):
    return M.stream_usage(USAGE.df(spark, sf_dir))


def usage_rollup(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("value"), F.max("ts").alias("updated_at"))


def usage_upsert(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", F.floor("value").cast("long").alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), (F.col("event_type") == "click").cast("long").alias("cached"))
    first = rows.filter("event_id % 2 = 0").groupBy("user_id").agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cached")))
    return M.upserted(first, rows.filter("event_id % 2 = 1"))


def quota_daily(spark, sf_dir):
    rows = M.within_quota(events(spark, sf_dir), "DAY", F.lit(3), ["ts", "event_id"])
    return rows.groupBy("user_id", F.date_format(F.date_trunc("DAY", "ts"), "yyyy-MM-dd").alias("day")).agg(F.count_if("ok").alias("allowed"), F.count_if(~F.col("ok")).alias("refused"))


def quota_monthly(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("plan", F.element_at(F.array(*(F.lit(p) for p in ("trial", "basic", "pro", "max"))), (F.col("user_id") % 4 + 1).cast("int"))).withColumn("trialing", F.lit(False))
    rows = M.within_quota(M.with_tier(rows, M.TIERS.df(spark, sf_dir)), "MONTH", F.col("courses") * F.col("lessons_per_course"), ["ts", "event_id"])
    return rows.groupBy("user_id", "tier").agg(F.count_if("ok").alias("allowed"), F.count_if(~F.col("ok")).alias("refused"))


def rls_secure_view(spark, sf_dir):
    return M.owned(events(spark, sf_dir), F.lit(7)).select("event_id", "user_id", "event_type")


def account_delete(spark, sf_dir):
    children, reports = M.account_deleted(F.lit(7), events(spark, sf_dir).filter("event_id % 2 = 0"), events(spark, sf_dir).filter("event_id % 2 = 1"))
    count = lambda x, kind: x.groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.count("user_id").alias("named"))
    return count(children, "children").unionByName(count(reports, "reports"))


def sse_frames(spark, sf_dir):
    return M.frames(SSE.df(spark, sf_dir)).select("stream_id", F.regexp_replace("data", r"\s", "").alias("data"))


def report_queue_top5(spark, sf_dir):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events(spark, sf_dir).withColumn("nth", nth).filter("nth <= 5").select("user_id", "event_id", F.col("nth").cast("long").alias("nth"))


QUERIES = {
    k.__name__: k
    for k in (
        tier_dim_join, classify_calls, entitlement_gate, request_validation, content_check, clamp_running_budget, cache_marks, lesson_blocks, course_size, usage_totals, stream_meter, usage_rollup, usage_upsert,
        quota_daily, quota_monthly, rls_secure_view, account_delete, sse_frames, report_queue_top5,
    )
}
SQL_PLAN = "CASE WHEN coalesce(status = 'trialing', false) THEN 'trial' WHEN plan IN ('trial', 'basic', 'pro', 'max') THEN plan ELSE 'basic' END"
ORACLE = {
    "tier_dim_join": f"SELECT s.user_id, t.plan AS tier, t.courses, t.courses * t.lessons_per_course AS lessons, t.read_chars, t.model_lesson FROM (SELECT user_id, {SQL_PLAN} AS p FROM {SUBSCRIPTIONS.sql}) s JOIN {M.TIERS.sql} t ON t.plan = s.p",
    "classify_calls": f"SELECT id, kind, CAST(CASE kind WHEN 'lesson' THEN 6000 WHEN 'course' THEN 4000 ELSE 1000 END AS BIGINT) AS cap FROM (SELECT id, CASE WHEN n >= 4500 THEN 'lesson' WHEN n >= 3500 THEN 'course' ELSE 'free' END AS kind FROM (SELECT id, coalesce(try_cast(max_tokens AS BIGINT), 0) AS n FROM {CAPS.sql}))",
    "entitlement_gate": f"SELECT user_id, CAST(CASE WHEN status = 'active' THEN 200 WHEN status = 'trialing' AND days > 0 THEN CASE WHEN confirmed THEN 200 ELSE 429 END ELSE 402 END AS BIGINT) AS code, CASE WHEN status = 'active' THEN NULL WHEN status = 'trialing' AND days > 0 THEN CASE WHEN confirmed THEN NULL ELSE 'email_unconfirmed' END ELSE 'trial_over' END AS reason FROM {SUBSCRIPTIONS.sql}",
    "request_validation": f"SELECT conv_id, CASE WHEN min(task) IS NOT NULL AND min(task) NOT IN ('path', 'lesson', 'tutor', 'feedback', 'primer', 'worksheet') THEN 'unknown_task' WHEN count(*) FILTER (content = '[]') > 0 THEN 'invalid_content' ELSE 'ok' END AS verdict FROM {REQUESTS.sql} GROUP BY 1",
    "content_check": f"""SELECT id, len(t) AS n, array_to_string(t, '|') AS texts FROM (SELECT id, CASE json_type(j) WHEN 'VARCHAR' THEN [json_extract_string(j, '$')] WHEN 'ARRAY' THEN CASE WHEN json_array_length(j) BETWEEN 1 AND 8
  THEN list_transform(CAST(j AS JSON[]), lambda x: CASE json_type(x) WHEN 'VARCHAR' THEN json_extract_string(x, '$') WHEN 'OBJECT' THEN CASE WHEN json_extract_string(x, '$.type') = 'text' THEN json_extract_string(x, '$.text') END END) END END AS t
  FROM (SELECT id, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j FROM {CONTENT.sql})) WHERE t IS NOT NULL AND len(list_filter(t, lambda x: x IS NULL OR x = '')) = 0""",
    "clamp_running_budget": "SELECT conv_id, turn, CAST(kept AS BIGINT) AS kept, CAST(greatest(0, 1500 - b - kept) AS BIGINT) AS \"left\" FROM (SELECT conv_id, turn, b, least(n, greatest(0, 1500 - b)) AS kept FROM (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations))",
    "cache_marks": "SELECT conv_id, turn, CAST(prefix AS BIGINT) AS prefix, prefix >= CASE conv_id % 3 WHEN 0 THEN 16384 WHEN 1 THEN 4096 ELSE 2048 END AND nxt IS NOT NULL AND n > 0 AS mark FROM (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER w AS prefix, lead(turn) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))",
    "lesson_blocks": "SELECT call_id, n, chars, CAST(prefix AS BIGINT) AS prefix, prefix >= 4096 AND nxt IS NOT NULL AND chars > 0 AS mark FROM (SELECT *, sum(chars) OVER w AS prefix, lead(n) OVER w AS nxt FROM (SELECT conv_id AS call_id, turn AS n, least(length(text) * 12, CASE turn WHEN 0 THEN 8000 WHEN 1 THEN 3000 WHEN 2 THEN 2400 ELSE 13000 END) AS chars FROM conversations WHERE turn < 4) WINDOW w AS (PARTITION BY call_id ORDER BY n))",
    "course_size": f"""SELECT id, CASE WHEN regexp_matches(text, 'identify\\s+(exactly\\s+)?[0-9]+(\\s*[-–]\\s*[0-9]+)?\\s+core concepts', 'i') THEN regexp_replace(text, 'identify\\s+(exactly\\s+)?[0-9]+(\\s*[-–]\\s*[0-9]+)?\\s+core concepts', 'Identify exactly 8 core concepts', 'i') ELSE text || chr(10) || chr(10) || 'IMPORTANT: return exactly 8 concepts, no more and no fewer.' END AS text FROM {PROMPTS.sql}""",
    "usage_totals": f"SELECT stream_id, seq, coalesce(input, 0) + coalesce(cache_write, 0) + coalesce(cache_read, 0) AS total_read, coalesce(cache_read, 0) > 0 AS hit FROM {USAGE.sql}",
    "stream_meter": f"SELECT stream_id, coalesce(max(input), 0) AS input, coalesce(max(cache_write), 0) AS cache_write, coalesce(max(cache_read), 0) AS cache_read, coalesce(arg_max(output, seq) FILTER (output IS NOT NULL), 0) AS output FROM {USAGE.sql} GROUP BY 1",
    "usage_rollup": "SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS value, max(ts) AS updated_at FROM events GROUP BY ALL",
    "usage_upsert": "SELECT user_id, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(event_id % 7) AS BIGINT) AS output_tokens, count(*) FILTER (event_type = 'click') AS cached FROM events GROUP BY 1",
    "quota_daily": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, least(count(*), 3) AS allowed, greatest(count(*) - 3, 0) AS refused FROM events GROUP BY ALL",
    "quota_monthly": "WITH t AS (SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'trial' WHEN 1 THEN 'basic' WHEN 2 THEN 'pro' ELSE 'max' END AS tier, CASE user_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 120 END AS q, strftime(ts, '%Y-%m') AS m, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, tier, CAST(sum(least(n, q)) AS BIGINT) AS allowed, CAST(sum(greatest(n - q, 0)) AS BIGINT) AS refused FROM t GROUP BY ALL",
    "rls_secure_view": "SELECT event_id, user_id, event_type FROM events WHERE user_id = 7",
    "account_delete": "SELECT 'children' AS kind, count(*) AS n, count(*) AS named FROM events WHERE event_id % 2 = 0 AND user_id <> 7 UNION ALL SELECT 'reports', count(*), count(*) FILTER (user_id <> 7) FROM events WHERE event_id % 2 = 1",
    "sse_frames": f"""WITH a AS (SELECT stream_id, string_split(string_agg(chunk, '' ORDER BY seq), chr(10) || chr(10)) AS f FROM {SSE.sql} GROUP BY 1), d AS (SELECT stream_id, substr(x, 7) AS data FROM (SELECT stream_id, unnest(f[:-2]) AS x FROM a) WHERE starts_with(x, 'data: '))
SELECT stream_id, regexp_replace(data, '\\s', '', 'g') AS data FROM d WHERE data <> '[DONE]' AND json_valid(data) AND starts_with(data, '{{')""",
    "report_queue_top5": "SELECT user_id, event_id, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5",
}
