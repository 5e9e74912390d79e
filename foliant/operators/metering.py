"""Plans, calls, budgets, usage and quotas of a metered model proxy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixtures import Frame

# fixed values: the plans, allowances and output limits
TIERS = Frame(
    "plan string, courses bigint, lessons_per_course bigint, read_chars bigint, excerpt_chars bigint, context_chars bigint, model_course string, model_lesson string",
    [
        ("trial", 1, 10, 5000, 2400, 0, "small", "small"), ("basic", 3, 10, 5000, 2400, 0, "small", "small"),
        ("pro", 5, 12, 40000, 8000, 24000, "small", "medium"), ("max", 8, 15, 120000, 16000, 48000, "medium", "medium"),
    ],
)
CACHE_TOKENS = {"small": 4096, "medium": 1024, "large": 512}
CHARS_A_TOKEN = 4
TEMPLATE_CHARS, GLOBAL_CHARS, DOMAIN_CHARS = 13_000, 8_000, 3_000
FREE_CHARS, FREE_A_DAY, MAX_BLOCKS = 20_000, 200, 8
TASKS = ("path", "lesson", "tutor", "feedback", "primer", "worksheet")
COURSE_SIZE = r"(?is)^(.*?)Identify\s+(?:exactly\s+)?\d+(?:\s*[-–]\s*\d+)?\s+core concepts"


def plan_of(plan: Column, trialing: Column) -> Column:
    """The tier a subscription means: a trial first, unknown or missing plans are basic."""
    return F.when(F.coalesce(trialing, F.lit(False)), "trial").when(plan.isin("trial", "basic", "pro", "max"), plan).otherwise("basic")


def with_tier(calls: DataFrame, tiers: DataFrame) -> DataFrame:
    """`calls` (plan, trialing) with their tier's columns; there are four tiers."""
    return calls.withColumn("_tier", plan_of(F.col("plan"), F.col("trialing"))).join(F.broadcast(tiers.withColumnRenamed("plan", "tier")), F.col("_tier") == F.col("tier")).drop("_tier")


def call_kind(max_tokens: Column) -> Column:
    """lesson from 4500 output tokens, course from 3500, else free; what is no number is 0."""
    n = F.coalesce(F.try_to_number(max_tokens, F.lit("999999999")), F.lit(0))
    return F.when(n >= 4500, "lesson").when(n >= 3500, "course").otherwise("free")


def output_cap(kind: Column) -> Column:
    return F.when(kind == "lesson", 6000).when(kind == "course", 4000).otherwise(1000).cast("long")


def entitlement(status: Column, period_end: Column, now: Column, confirmed: Column) -> Column:
    """status and code of the gate: 402 for those without a live subscription, 429 for a trial whose address is not
    confirmed (else one person repeats the trial at will), 200 with no code for all others."""
    active = F.coalesce(status == "active", F.lit(False))
    trial = F.coalesce((status == "trialing") & (period_end > now), F.lit(False))
    said = lambda number, code: F.struct(F.lit(number).cast("long").alias("status"), F.lit(code).cast("string").alias("code"))
    return F.when(~active & ~trial, said(402, "trial_over")).when(~active & ~F.coalesce(confirmed, F.lit(False)), said(429, "email_unconfirmed")).otherwise(said(200, None))


def request_verdict(contents: Column, task: Column) -> Column:
    """ok, or why a request is refused: no messages, a task that is none of TASKS (none at all is fine), or a message
    without a content that `content_blocks` takes."""
    bad = F.exists(contents, lambda c: content_blocks(c).isNull())
    return F.when(F.coalesce(F.size(contents), F.lit(0)) < 1, "messages").when(~task.isin(*TASKS), "unknown_task").when(bad, "invalid_content").otherwise("ok")


def wants_stream(body: Column) -> Column:
    """Whether a request's JSON body asks for a stream: the literal true alone."""
    asked = F.try_variant_get(F.try_parse_json(body), "$.stream", "variant")
    return F.coalesce((F.schema_of_variant(asked) == "BOOLEAN") & F.try_variant_get(asked, "$", "boolean"), F.lit(False))


def running_clamp(blocks: DataFrame, group: str, order: str, text: str, budget: Column) -> DataFrame:
    """`blocks` with kept (characters that stay) and left (budget behind each): the budget runs out along the order."""
    size = F.char_length(text).cast("long")
    before = F.coalesce(F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.least(size, F.greatest(F.lit(0).cast("long"), budget - before))
    return blocks.withColumn("kept", kept).withColumn("left", F.greatest(F.lit(0).cast("long"), budget - before - kept))


def cache_marks(blocks: DataFrame, group: str, order: str, chars: str, model: Column) -> DataFrame:
    """`blocks` with mark: the characters up to here reach the model's least cacheable prefix; never on the last block."""
    least = F.coalesce(F.create_map(*(F.lit(x) for k, v in CACHE_TOKENS.items() for x in (k, v * CHARS_A_TOKEN)))[model].cast("double"), F.lit(float("inf")))
    w = Window.partitionBy(group).orderBy(order)
    total = F.sum(chars).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead(order).over(w).isNull()
    return blocks.withColumn("prefix", total).withColumn("mark", (F.col("prefix") >= least) & ~last & (F.col(chars) > 0))


def lesson_blocks(blocks: DataFrame, model: Column, excerpt: Column) -> DataFrame:
    """The four blocks of a lesson call (call_id, n from 0, text), each cut at its own ceiling, with cache marks by the
    characters so far: what all lessons share, what a domain shares, the excerpt, the prompt."""
    ceiling = F.when(F.col("n") == 0, GLOBAL_CHARS).when(F.col("n") == 1, DOMAIN_CHARS).when(F.col("n") == 2, excerpt).otherwise(TEMPLATE_CHARS)
    cut = blocks.withColumn("chars", F.least(F.char_length("text"), ceiling).cast("long")).withColumn("model", model)
    return cache_marks(cut, "call_id", "n", "chars", F.col("model"))


def fix_course_size(text: Column, n: int) -> Column:
    """The first order for a number of concepts rewritten, or an order added."""
    return F.when(text.rlike(COURSE_SIZE), F.regexp_replace(text, COURSE_SIZE + r"(.*)$", rf"$1Identify exactly {n} core concepts$2")).otherwise(F.concat(text, F.lit(f"\n\nIMPORTANT: return exactly {n} concepts, no more and no fewer.")))


def content_blocks(content: Column) -> Column:
    """The text blocks of a message's content in JSON: a string, or 1 to 8 strings and text blocks; null for all else."""
    v = F.try_parse_json(content)
    kind = F.schema_of_variant(v)
    one = F.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string")))
    items = F.try_variant_get(v, "$", "array<variant>")
    string = lambda x, path: F.try_variant_get(x, path, "string")
    texts = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", string(x, "$")).when(string(x, "$.type") == "text", string(x, "$.text")))
    many = F.when(kind.startswith("ARRAY") & (F.size(items) >= 1) & (F.size(items) <= MAX_BLOCKS) & ~F.exists(texts, lambda t: t.isNull() | (t == "")), texts)
    return F.coalesce(one, many)


def usage_of(rows: DataFrame) -> DataFrame:
    """Usage records with total_read and hit; missing numbers are 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.withColumns({c: z(c) for c in ("input", "output", "cache_write", "cache_read")}).withColumn("total_read", F.col("input") + F.col("cache_write") + F.col("cache_read")).withColumn("hit", F.col("cache_read") > 0)


def stream_usage(events: DataFrame) -> DataFrame:
    """stream_id, input, cache_write, cache_read (their maxima) and output (the last one): a row for each stream."""
    z = lambda c: F.coalesce(F.max(c), F.lit(0)).alias(c)
    last = F.coalesce(F.max_by("output", F.when(F.col("output").isNotNull(), F.col("seq"))), F.lit(0)).alias("output")
    return events.groupBy("stream_id").agg(z("input"), z("cache_write"), z("cache_read"), last)


def upserted(counters: DataFrame, calls: DataFrame) -> DataFrame:
    """Counters of users after further calls: added where there, else new."""
    names = ["calls", "input_tokens", "output_tokens", "cached"]
    rows = counters.select("user_id", *names).unionByName(calls.select("user_id", F.lit(1).cast("long").alias("calls"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).cast("long").alias(c) for c in names[1:])))
    return rows.groupBy("user_id").agg(*(F.sum(c).alias(c) for c in names))


def within_quota(calls: DataFrame, period: str, limit: Column, order: list[str]) -> DataFrame:
    """`calls` with nth (in the user's period, UTC) and ok: whether the call is within the limit."""
    nth = F.row_number().over(Window.partitionBy("user_id", F.date_trunc(period, "ts")).orderBy(*order)).cast("long")
    return calls.withColumn("nth", nth).withColumn("ok", F.col("nth") <= limit)


def owned(rows: DataFrame, caller: Column) -> DataFrame:
    """What a caller may see."""
    return rows.filter(F.col("user_id") == caller)


def account_deleted(user: Column, children: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children without the user's rows; reports keep theirs, without the name."""
    return children.filter(~F.col("user_id").eqNullSafe(user)), reports.withColumn("user_id", F.when(~F.col("user_id").eqNullSafe(user), F.col("user_id")))


def frames(stream: DataFrame) -> DataFrame:
    """stream_id, n, data: the complete server-sent events of chunks, joined in order; comments, [DONE] and what is no
    JSON are left out, and several data lines of an event are one."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "")
    rows = stream.groupBy("stream_id").agg(F.regexp_replace(whole, "\r\n", "\n").alias("all"))
    parts = rows.select("stream_id", F.posexplode(F.slice(F.split("all", "\n\n"), 1, F.greatest(F.size(F.split("all", "\n\n")) - 1, F.lit(0)))).alias("n", "frame"))
    data = F.array_join(F.transform(F.filter(F.split("frame", "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    rows = parts.select("stream_id", F.col("n").cast("long").alias("n"), data.alias("data"))
    return rows.filter((F.col("data") != "") & (F.col("data") != "[DONE]") & F.try_parse_json("data").isNotNull() & F.col("data").startswith("{"))
