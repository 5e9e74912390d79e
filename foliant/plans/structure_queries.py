"""Queries over headings and chapters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as S
from . import derived as D

HEADS, PAGES, NUMERALS, TITLED = D.HEADS, D.PAGES, D.NUMERALS, D.TITLED
SQL_LAST = f"(SELECT book, max(page) + 2 AS last FROM {HEADS.sql} GROUP BY book)"


def parse_numeral(spark, sf_dir):
    return NUMERALS.df(spark, sf_dir).select("id", S.numeral(F.col("token")).alias("value")).filter("value is not null")


def heading_keyword(spark, sf_dir):
    rows = TITLED.df(spark, sf_dir).withColumn("h", S.keyword_heading(F.col("line")))
    return rows.filter("h is not null").select("doc_id", "pos", "h.level", F.coalesce("h.number", F.lit(0)).alias("number"), "h.title", "h.label")


def heading_outline(spark, sf_dir):
    rows = TITLED.df(spark, sf_dir).withColumn("h", S.outline_heading(F.col("line")))
    return rows.filter("h is not null").select("doc_id", "pos", "h.level", F.coalesce("h.number", F.lit(0)).alias("number"), "h.title", "h.label")


def heading_contents_drop(spark, sf_dir):
    lines = PAGES.df(spark, sf_dir)
    return S.without_contents(S.headings(lines), lines).select("book", "page", "pos", "label", "level")


def heading_loose_fallback(spark, sf_dir):
    lines = PAGES.df(spark, sf_dir)
    return S.with_fallback(S.without_contents(S.headings(lines), lines), lines).select("book", "page", "pos", "label", "kind")


def heading_dedupe(spark, sf_dir):
    found = HEADS.df(spark, sf_dir).withColumns({"number": F.lit(None).cast("long"), "title": F.col("label"), "kind": F.lit("x")})
    return S.deduped(found).select("book", "label", "page", "pos")


def chapters(spark, sf_dir):
    heads = HEADS.df(spark, sf_dir)
    return S.spans(heads, heads.groupBy("book").agg((F.max("page") + 2).alias("last")))


def chapter_spans(spark, sf_dir):
    return chapters(spark, sf_dir).select("book", "page", "pos", "end_page")


def chapter_paths(spark, sf_dir):
    return chapters(spark, sf_dir).select("book", "page", "pos", "parent", "path")


def chapter_lookup(spark, sf_dir):
    rows = chapters(spark, sf_dir).withColumn("number", F.col("pos"))
    return S.find_chapter(rows, "p6").withColumn("by", F.lit("page")).unionByName(S.find_chapter(rows, "3").withColumn("by", F.lit("number"))).unionByName(S.find_chapter(rows, "h1-").withColumn("by", F.lit("label")))


def chapter_index(spark, sf_dir):
    return S.rendered_index(chapters(spark, sf_dir))


def front_matter(spark, sf_dir):
    """A chapter before the first heading where more than 200 characters stand there, one for a book without headings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("book"), "doc_id", F.char_length("text").cast("long").alias("chars"))
    first = docs.filter("doc_id % 7 = 0").groupBy("book").agg(F.min("doc_id").alias("first_heading"))
    rows = docs.join(first, "book", "left").filter(F.col("first_heading").isNull() | (F.col("doc_id") < F.col("first_heading")))
    return rows.groupBy("book").agg(F.sum("chars").alias("chars"), F.count("*").alias("pages")).filter("chars > 200")


SQL_SPANS = f"""
h AS (SELECT * FROM {HEADS.sql}),
n AS (SELECT a.*, (SELECT arg_min(b.page, (b.page, b.pos)) FROM h b WHERE b.book = a.book AND (b.page, b.pos) > (a.page, a.pos) AND b.level <= a.level) AS closing FROM h a),
c AS (SELECT book, page, pos, level, label, CASE WHEN closing IS NULL THEN last ELSE greatest(page, closing - 1) END AS end_page FROM n JOIN {SQL_LAST} USING (book))"""

QUERIES = {k.__name__: k for k in (parse_numeral, heading_keyword, heading_outline, heading_contents_drop, heading_loose_fallback, heading_dedupe, chapter_spans, chapter_paths, chapter_lookup, chapter_index, front_matter)}


OUTLINE_SQL = r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})[.)]?\s+(\S.{0,90})$"
SQL_OUTLINE = f"""SELECT doc_id, pos, CAST(least(1 + len(string_split(num, '.')), 4) AS BIGINT) AS level, CAST(string_split(num, '.')[1] AS BIGINT) AS number, title, num || ' — ' || title AS label
FROM (SELECT doc_id, pos, regexp_extract(line, '{OUTLINE_SQL}', 1) AS num, regexp_extract(line, '{OUTLINE_SQL}', 2) AS title FROM {TITLED.sql})
WHERE num <> '' AND length(title) <= 80 AND NOT regexp_matches(title, '[.!?:;,]$') AND NOT regexp_matches(title, '^[a-z]')"""
KEYWORD = "|".join(sorted(S.KEYWORDS, key=len, reverse=True))
LEVELS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.KEYWORDS.items())
NO_NUMBER = ", ".join(f"'{w}'" for w in S.NO_NUMBER)
#: The tables' keyword lines have their numbers in digits; other writings are tested by cases.
SQL_KEYWORD = rf"""WITH p AS (SELECT doc_id, pos, line, regexp_extract(line, '^({KEYWORD})(?:\s+|)(\S+?)(?:[\s:\-–—.,)\]]+(.*))?$', ['word', 'token', 'rest'], 'i') AS m FROM {TITLED.sql} WHERE regexp_matches(line, '^({KEYWORD})(\s+\S|[0-9])', 'i')),
q AS (SELECT doc_id, pos, line, m.word AS word, m.token AS token, trim(regexp_replace(trim(m.rest, ' '), '^[ \t:.\-–—]+|[ \t:.\-–—]+$', '', 'g'), ' ') AS title, CASE WHEN regexp_matches(m.token, '^[0-9]{{1,4}}$') THEN CAST(m.token AS BIGINT) END AS n FROM p),
r AS (SELECT *, CASE WHEN n IS NOT NULL THEN title ELSE trim(token || ' ' || title, ' ') END AS named FROM q WHERE (n IS NOT NULL OR (length(line) <= 60 AND lower(token) NOT IN ({NO_NUMBER}) AND NOT regexp_matches(token, '^[a-z]'))) AND NOT (length(line) > 60 AND regexp_matches(line, '[.!?:;,]$')))
SELECT doc_id, pos, CAST(CASE lower(word) {LEVELS} END AS BIGINT) AS level, coalesce(n, 0) AS number, named AS title, word || coalesce(' ' || n, '') || CASE WHEN named <> '' THEN ' — ' || named ELSE '' END AS label FROM r"""
SQL_FOUND = f"""l AS (SELECT * FROM {PAGES.sql}), f AS (SELECT *, 2 AS level FROM l WHERE regexp_matches(line, '^Chapter [0-9]+$')),
crowd AS (SELECT book, page FROM (SELECT book, page, count(*) AS k FROM f GROUP BY ALL) JOIN (SELECT book, page, count(*) AS n FROM l GROUP BY ALL) USING (book, page) WHERE k >= 4 AND k >= 0.5 * n),
kept AS (SELECT f.* FROM f ANTI JOIN crowd x ON f.book = x.book AND f.page = x.page)"""

ORACLE = {
    "parse_numeral": f"SELECT id, value FROM {NUMERALS.sql} WHERE value IS NOT NULL",
    "heading_keyword": SQL_KEYWORD,
    "heading_outline": SQL_OUTLINE,
    "heading_contents_drop": f"WITH {SQL_FOUND} SELECT book, page, pos, line AS label, CAST(level AS BIGINT) AS level FROM kept",
    "heading_loose_fallback": f"""WITH {SQL_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY pos) AS nth FROM l),
m AS (SELECT book, page, list_sort(list(length(line)) FILTER (nth > 1)) AS sizes FROM r GROUP BY ALL),
g AS (SELECT r.book, r.page, r.pos, r.line FROM r JOIN m USING (book, page) WHERE nth = 1 AND length(line) BETWEEN 4 AND 60 AND len(string_split_regex(line, '\\s+')) <= 8 AND NOT regexp_matches(line, '[0-9]') AND NOT regexp_matches(line, '[.!?:;,]$')
  AND (sizes IS NULL OR length(line) <= 0.7 * sizes[len(sizes) // 2 + 1]) AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.book = r.book AND k.page = r.page)),
ok AS (SELECT book FROM (SELECT book, count(*) AS n FROM g GROUP BY 1) JOIN (SELECT book, count(DISTINCT page) AS pages FROM l GROUP BY 1) USING (book) LEFT JOIN (SELECT book, count(*) AS have FROM kept GROUP BY 1) USING (book) WHERE coalesce(have, 0) < 2 AND n <= greatest(4, 0.34 * pages))
SELECT book, page, pos, line AS label, 'keyword' AS kind FROM kept UNION ALL SELECT g.book, page, pos, line, 'title' FROM g SEMI JOIN ok ON g.book = ok.book""",
    "heading_dedupe": f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY book, label ORDER BY page, pos) AS k FROM {HEADS.sql}),
w AS (SELECT book, label, page, pos, k, page AS kept_page, true AS kept FROM h WHERE k = 1
  UNION ALL SELECT h.book, h.label, h.page, h.pos, h.k, CASE WHEN h.page - w.kept_page <= 1 THEN w.kept_page ELSE h.page END, h.page - w.kept_page > 1 FROM w JOIN h ON h.book = w.book AND h.label = w.label AND h.k = w.k + 1)
SELECT book, label, page, pos FROM w WHERE kept""",
    "chapter_spans": f"WITH {SQL_SPANS} SELECT book, page, pos, end_page FROM c",
    "chapter_paths": f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page, pos) AS k FROM {HEADS.sql}),
p AS (SELECT a.*, (SELECT arg_max(b.k, b.k) FROM h b WHERE b.book = a.book AND b.k < a.k AND b.level < a.level) AS up FROM h a),
t AS (SELECT book, page, pos, k, label AS path, up FROM p UNION ALL SELECT t.book, t.page, t.pos, t.k, q.label || ' › ' || t.path, q.up FROM t JOIN p q ON q.book = t.book AND q.k = t.up)
SELECT t.book, t.page, t.pos, o.label AS parent, t.path FROM t JOIN p ON p.book = t.book AND p.k = t.k LEFT JOIN p o ON o.book = p.book AND o.k = p.up WHERE t.up IS NULL""",
    "chapter_lookup": f"""WITH {SQL_SPANS}
SELECT book, arg_min(label, (-level, page, pos)) AS label, 'page' AS by FROM c WHERE page <= 6 AND end_page >= 6 GROUP BY 1
UNION ALL SELECT book, arg_min(label, (page, pos)), 'number' FROM c WHERE pos = 3 GROUP BY 1
UNION ALL SELECT book, arg_min(label, (page, pos)), 'label' FROM c WHERE contains(lower(label), 'h1-') GROUP BY 1""",
    "chapter_index": f"""WITH {SQL_SPANS}, x AS (SELECT *, repeat('  ', level - 1) || label AS head FROM c WHERE level <= 2)
SELECT book, page, pos, head || ' ' || repeat('.', greatest(4, 46 - length(head))) || ' ' || CASE WHEN page = end_page THEN 'page ' || page ELSE 'pages ' || page || '-' || end_page END AS text FROM x""",
    "front_matter": "SELECT source AS book, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS pages FROM documents d WHERE doc_id < coalesce((SELECT min(doc_id) FROM documents e WHERE e.source = d.source AND doc_id % 7 = 0), 1000000000) GROUP BY 1 HAVING sum(length(text)) > 200",
}
