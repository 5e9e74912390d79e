"""Queries over lessons, sections and small rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lessons as L
from ..operators import questions as Q
from . import derived as D

MARKUP, PARTIAL, RUNS, SPANS, OCR, PACKS, ANSWERS, SIDES, GUARDS = D.MARKUP, D.PARTIAL, D.RUNS, D.SIZED, D.OCR, D.PACKS, D.ANSWERS, D.SIDES, D.GUARDS


def html_escape(spark, sf_dir):
    return MARKUP.df(spark, sf_dir).select("id", L.escaped(F.col("t")).alias("body"), L.escaped(F.col("t"), True).alias("attribute"))


def interest_summary(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    names = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return turns.groupBy("conv_id").agg(L.interest_summary(names).alias("summary"))


def starter_picks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("place"), F.col("event_id").alias("id"))
    return L.starter_picks(e, F.col("id") % 11 == 0)


def heading_level(spark, sf_dir):
    return D.TITLED.df(spark, sf_dir).select("doc_id", "pos", L.heading_level(F.col("line")).alias("level"))


def document_sections(spark, sf_dir):
    return L.sections(D.TITLED.df(spark, sf_dir)).select("doc_id", "section", "own")


def locate_sections(spark, sf_dir):
    lines = D.TITLED.df(spark, sf_dir)
    outline = lines.filter(L.heading_level(F.col("line")) > 0).select("doc_id", F.col("pos").alias("n"), F.concat(F.lit("## "), F.col("line")).alias("title"), (F.col("pos") + 1).alias("page"))
    return L.located(outline, lines)


def lesson_progress(spark, sf_dir):
    return PARTIAL.df(spark, sf_dir).select("id", L.lesson_progress(F.col("t")).alias("share"))


def json_repair(spark, sf_dir):
    return L.repaired_json(PARTIAL.df(spark, sf_dir), "id", "t").filter("json is not null")


def runs_to_lines(spark, sf_dir):
    return L.runs_to_lines(RUNS.df(spark, sf_dir))


def dominant_lines(spark, sf_dir):
    return L.dominant_lines(SPANS.df(spark, sf_dir))


def ocr_regroup(spark, sf_dir):
    return L.ocr_lines(OCR.df(spark, sf_dir))


def ocr_languages(spark, sf_dir):
    use, missing = L.ocr_language(F.col("wanted"), F.split("installed", ","))
    return PACKS.df(spark, sf_dir).select("id", use.alias("use"), missing.alias("missing"))


def numeric_grading(spark, sf_dir):
    return ANSWERS.df(spark, sf_dir).select("id", L.numeric_grade(F.col("answer"), F.col("target"), F.col("tolerance")).alias("good"))


def prefetch_guards(spark, sf_dir):
    return GUARDS.df(spark, sf_dir).select("id", L.prefetch_ok(F.col("e"), F.col("h"), F.col("o"), F.col("s"), F.col("n")).alias("ok"))


def option_shuffle(spark, sf_dir):
    """Whatever the order, the correct option and its reason stay together, and no option is lost."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    of = lambda mark: F.array(*(F.concat(F.lit(mark + x), F.col("event_id")) for x in "abcd"))
    rows = e.select(F.col("event_id").alias("id"), of("o").alias("o"), of("w").alias("w"), (F.col("event_id") % 4).cast("int").alias("c"))
    s = L.shuffled(F.col("o"), F.col("w"), F.col("c"), F.col("id"))
    return rows.select("id", F.get(s["options"], s["correct"].cast("int")).alias("option"), F.get(s["why"], s["correct"].cast("int")).alias("why"), F.array_join(F.array_sort(s["options"]), ",").alias("every"))


def question_specs(spark, sf_dir):
    """Questions made whole: a choice's reasons, a number's tolerance, a hotspot's target."""
    rows = D.QUESTIONS.df(spark, sf_dir).select("id", Q.question(F.col("spec")).alias("q")).filter("q IS NOT NULL")
    return rows.select("id", "q.type", F.size("q.options").alias("options"), "q.correct", F.array_join("q.why", "|").alias("why"), F.col("q.answer").alias("number"), "q.tolerance", "q.target", F.col("q.visual").isNotNull().alias("figure"))


def question_grades(spark, sf_dir):
    """Answers to questions of all types."""
    rows = D.QUESTIONS.df(spark, sf_dir)
    return Q.graded(rows.select("id", Q.question(F.col("spec")).alias("q")), rows.select("id", "answer"))


def shown_numbers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), Q.shown_number(F.round(F.col("o_totalprice") * (F.col("o_orderkey") % 3), 1)).alias("shown"))


def triangle_area(spark, sf_dir):
    return SIDES.df(spark, sf_dir).select("id", L.triangle_area(F.col("a"), F.col("b"), F.col("c")).alias("area"))


def plan_override(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().withColumn("plan", F.lit("basic"))
    return L.set_plan(e, F.lit(7), 7, "pro")


def file_facts(spark, sf_dir):
    """Name, size and SHA-256 of each document as a file."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.coalesce("source", F.lit("unknown")), F.lit("-"), "doc_id", F.lit(".txt")).alias("name"), F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("sha256"))


QUERIES = {
    k.__name__: k
    for k in (
        html_escape, interest_summary, starter_picks, heading_level, document_sections, locate_sections, lesson_progress, json_repair, runs_to_lines, dominant_lines, ocr_regroup, ocr_languages, numeric_grading,
        prefetch_guards, question_specs, question_grades, shown_numbers, option_shuffle, triangle_area, plan_override, file_facts,
    )
}
SQL_LEVEL = r"""CAST(CASE WHEN length(line) > 80 OR regexp_matches(line, '[.!?;,]$') THEN 0 WHEN regexp_matches(lower(line), '^(part|book|חלק|שער)[\s:.-]+\S') THEN 1
  WHEN regexp_matches(line, '^(part|book|chapter|unit|appendix|section|פרק|חלק|שער|יחידה|נספח|סעיף)[\s:.-]+\S', 'i') THEN 2 WHEN regexp_matches(line, '^[0-9]{1,2}\.[0-9]{1,2}\.?\s+\S') THEN 3 WHEN regexp_matches(line, '^[0-9]{1,2}[.)]?\s+\S') THEN 2
  WHEN regexp_matches(line, '^\p{Lu}[\p{L}''’-]*(\s+(\p{Lu}[\p{L}''’-]*|of|the|and|in|a|to|for))*$') OR (regexp_matches(line, '^[\p{Lu}\s]+$') AND regexp_matches(line, '\p{Lu}{2}')) THEN 2 ELSE 0 END AS BIGINT)"""
BODY = "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLE = {
    "html_escape": f"SELECT id, {BODY} AS body, replace(replace({BODY}, '\"', '&quot;'), '''', '&#39;') AS attribute FROM {MARKUP.sql}",
    "interest_summary": "SELECT conv_id, CASE WHEN len(r) <= 2 THEN array_to_string(r, ' and ') ELSE array_to_string(r[1:2], ', ') || ' and ' || (len(r) - 2) || ' more' END AS summary FROM (SELECT conv_id, list(role ORDER BY turn, role) AS r FROM conversations GROUP BY 1)",
    "starter_picks": "SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END, event_id) AS n, event_id AS id FROM events) WHERE n <= 3",
    "heading_level": f"SELECT doc_id, pos, {SQL_LEVEL} AS level FROM {D.TITLED.sql}",
    "lesson_progress": "SELECT id, round(greatest(" + ", ".join(f"CASE WHEN regexp_matches(t, '[{{,]\\s*\"{x}\"') THEN {k + 1} ELSE 0 END" for k, x in enumerate(L.STEPS)) + f") / 7.0, 4) AS share FROM {PARTIAL.sql}",
    "runs_to_lines": f"""WITH o AS (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY page ORDER BY y DESC, x) - y > 2 THEN 1 ELSE 0 END AS new FROM {RUNS.sql}), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page ORDER BY y DESC, x) AS BIGINT) AS "row" FROM o),
p AS (SELECT *, CASE WHEN x - lag(x + width) OVER (PARTITION BY page, "row" ORDER BY x) > 1 THEN ' ' ELSE '' END || str AS piece FROM r) SELECT page, "row", string_agg(piece, '' ORDER BY x, piece) AS text FROM p GROUP BY ALL""",
    "dominant_lines": f"""WITH s AS (SELECT * FROM {SPANS.sql} WHERE trim(text, ' ') <> ''), z AS (SELECT page, line, size, sum(length(text)) AS chars, min(seq) AS first FROM s GROUP BY ALL), b AS (SELECT page, line, arg_max(size, (chars, -first)) AS size FROM z GROUP BY ALL)
SELECT page, line, string_agg(text, '' ORDER BY seq) AS text, 2 * coalesce(sum(length(text)) FILTER (bold), 0) > sum(length(text)) AS bold, b.size FROM s JOIN b USING (page, line) GROUP BY page, line, b.size""",
    "ocr_regroup": f"SELECT page, block, par, line, string_agg(text, ' ' ORDER BY x0, text) AS text, min(x0) AS x0, max(x1) AS x1 FROM {OCR.sql} WHERE conf >= 0 GROUP BY ALL",
    "ocr_languages": f"""SELECT id, array_to_string(CASE WHEN len(have) > 0 THEN have WHEN list_contains(i, 'eng') THEN ['eng'] ELSE i[1:1] END, '+') AS use, array_to_string(list_filter(w, lambda x: NOT list_contains(i, x)), '+') AS missing
FROM (SELECT id, w, i, list_filter(w, lambda x: list_contains(i, x)) AS have FROM (SELECT id, string_split(wanted, '+') AS w, string_split(installed, ',') AS i FROM {PACKS.sql}))""",
    "numeric_grading": f"""SELECT id, coalesce(abs(CASE WHEN regexp_matches(answer, '^[0-9]+,[0-9]$') THEN CAST(replace(answer, ',', '.') AS DOUBLE) WHEN contains(answer, '/') THEN CAST(string_split(answer, '/')[1] AS DOUBLE) / CAST(string_split(answer, '/')[2] AS DOUBLE) ELSE try_cast(answer AS DOUBLE) END - target) <= abs(tolerance), false) AS good FROM {ANSWERS.sql}""",
    "prefetch_guards": f"SELECT id, e AND NOT h AND o AND s AND coalesce(n, 1000000) >= 2 AS ok FROM {GUARDS.sql}",
    "option_shuffle": "SELECT event_id AS id, 'o' || substr('abcd', CAST(event_id % 4 + 1 AS INT), 1) || event_id AS option, 'w' || substr('abcd', CAST(event_id % 4 + 1 AS INT), 1) || event_id AS why, 'oa' || event_id || ',ob' || event_id || ',oc' || event_id || ',od' || event_id AS every FROM events",
    "question_specs": f"""SELECT id, type, CASE WHEN type = 'choice' THEN 2 + id % 3 ELSE NULL END AS options, CASE WHEN type = 'choice' THEN id % 2 END AS correct, CASE WHEN type = 'choice' THEN CASE WHEN id % 4 = 0 THEN 'w' ELSE '' END || repeat('|', 1 + id % 3) END AS why, CASE WHEN type = 'numeric' THEN CAST(id % 9 AS DOUBLE) END AS number,
  CASE WHEN type = 'numeric' THEN CAST(id % 3 AS DOUBLE) END AS tolerance, CASE WHEN type = 'hotspot' THEN 'side:' || (id % 5) END AS target, type = 'hotspot' AS figure FROM {D.QUESTIONS.sql} WHERE type <> ''""",
    "question_grades": f"SELECT id, CASE type WHEN 'choice' THEN id % 2 = id % 7 WHEN 'numeric' THEN abs(id % 7 - id % 9) <= id % 3 ELSE false END AS good FROM {D.QUESTIONS.sql} WHERE type <> ''",
    "shown_numbers": "SELECT o_orderkey AS id, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS shown FROM (SELECT o_orderkey, CAST(round(o_totalprice * (o_orderkey % 3), 1) AS DECIMAL(20, 1)) AS v FROM orders)",
    "triangle_area": f"SELECT id, round(CASE WHEN q > 0 THEN sqrt(q) END, 6) AS area FROM (SELECT id, (a+b+c)/2 * ((a+b+c)/2 - a) * ((a+b+c)/2 - b) * ((a+b+c)/2 - c) AS q FROM {SIDES.sql})",
    "plan_override": "SELECT DISTINCT user_id, CASE WHEN user_id = 7 THEN 'pro' ELSE 'basic' END AS plan FROM events",
    "file_facts": "SELECT doc_id, coalesce(source, 'unknown') || '-' || doc_id || '.txt' AS name, strlen(coalesce(text, '')) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents",
}
ORACLE["locate_sections"] = f"WITH o AS (SELECT doc_id, pos AS n, lower(line) AS k, pos + 1 AS page FROM {D.TITLED.sql} WHERE {SQL_LEVEL} > 0) SELECT o.doc_id, o.n, min(l.pos) AS pos, min(o.page) AS page FROM o JOIN {D.TITLED.sql} l ON l.doc_id = o.doc_id AND lower(trim(regexp_replace(l.line, '^#+\\s*', ''))) = o.k GROUP BY ALL"
ORACLE["document_sections"] = f"""WITH v AS (SELECT *, {SQL_LEVEL} AS level FROM {D.TITLED.sql}), s AS (SELECT *, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section FROM v),
c AS (SELECT doc_id FROM v GROUP BY 1 HAVING count(*) FILTER (level > 0) < 0.8 * count(*)) SELECT doc_id, section, CAST(sum(length(line)) AS BIGINT) AS own FROM s SEMI JOIN c USING (doc_id) GROUP BY ALL"""
