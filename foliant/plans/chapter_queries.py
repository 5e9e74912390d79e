"""Queries over chapters, sections, outlines and manifests, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import chapters as C
from ..operators import digest as D
from ..operators import manifest as M
from ..operators.lessons import heading_level
from .derived import BOOKS, HEADS, KINDS, TITLED
from .lesson_queries import SQL_LEVEL

TARGET, LEAST = 2000, 400


def lines_and_heads(spark, sf_dir):
    rows = BOOKS.df(spark, sf_dir)
    return rows.drop("level"), rows.filter("level > 0").select("book", "page", "pos", F.col("level").cast("long").alias("level"), F.col("line").alias("label"), F.col("line").alias("title"))


def chapter_lines(spark, sf_dir):
    """Every line of every book with its chapter."""
    return C.chapter_lines(*lines_and_heads(spark, sf_dir)).select("book", "n", "page", "pos")


def chapter_sizes(spark, sf_dir):
    return C.chapters(*lines_and_heads(spark, sf_dir))


def section_source(spark, sf_dir):
    """What each concept is to be read in: the section of its name, or the book."""
    lines, heads = lines_and_heads(spark, sf_dir)
    own = heads.groupBy("book", F.upper("label").alias("section")).agg(F.count("*").alias("_n")).select(F.concat("book", F.lit(":"), "section").alias("concept"), "book", "section")
    none = lines.select("book").distinct().select(F.concat("book", F.lit(": none")).alias("concept"), "book", F.lit("Chapter Three, On Flux").alias("section"))
    rows = C.section_source(lines, heads, own.unionByName(none))
    return rows.groupBy("concept", "book").agg(F.count("*").alias("lines"), F.sum(F.char_length("line").cast("long")).alias("chars"), F.min(F.col("page") * 100000 + F.col("pos")).alias("first"))


def section_tree(spark, sf_dir):
    """The sections of every document with compressed levels, paths and spans."""
    rows = C.section_tree(TITLED.df(spark, sf_dir).withColumnRenamed("doc_id", "doc"))
    return rows.select("doc", "section", "level", F.md5("path").alias("path"), "chars", "total_chars")


DIGEST = 1500


def digest_parts(spark, sf_dir):
    """Documents as parts, a line a passage; a heading opens a part and names it."""
    rows = TITLED.df(spark, sf_dir).withColumn("level", heading_level(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.sum((F.col("level") > 0).cast("long")).over(w)).withColumn("title", F.coalesce(F.last(F.when(F.col("level") > 0, F.col("line")), ignorenulls=True).over(w), F.lit("Opening")))
    return rows.filter("level = 0").select(F.col("doc_id").alias("doc"), "part", "title", "pos", F.col("line").alias("text"))


def digest_depth(spark, sf_dir):
    """Which passages of every document its digest takes, and in which round."""
    rows = digest_parts(spark, sf_dir)
    return D.apportioned(rows.select("doc", "part", "pos", F.char_length("text").cast("long").alias("size")), DIGEST)


def source_digests(spark, sf_dir):
    """The digest of every document."""
    return D.digests(digest_parts(spark, sf_dir), DIGEST).select("doc", F.char_length("digest").cast("long").alias("chars"), F.md5("digest").alias("digest"))


def outline_nest(spark, sf_dir):
    """Outlines nested and flattened again."""
    heads = HEADS.df(spark, sf_dir).withColumn("at", F.col("page") * 1000 + F.col("pos"))
    out = C.nested(heads, "book", "at", ["label", "level", "page"])
    return C.flattened(out, "book", "outline", {"label": "string", "level": "long", "page": "long"})


def mapped(spark, sf_dir):
    return B.markdown(KINDS.df(spark, sf_dir))


def manifest_sections(spark, sf_dir):
    return M.sections(mapped(spark, sf_dir)).select("doc", "id", "seq", "level", "page_start", "page_end", F.md5(F.array_join("path", " › ")).alias("path"))


def manifest_chunks(spark, sf_dir):
    rows = M.chunk_map(mapped(spark, sf_dir), TARGET, LEAST)
    return rows.withColumns({"path": F.md5("path"), "headings": F.md5(F.array_join("headings", "|")), "blocks": F.array_join("blocks", ",")})


def manifest_objects(spark, sf_dir):
    return M.objects(mapped(spark, sf_dir)).select("doc", "seq", "kind", "id", "md_start", "md_end")


def manifest_pages(spark, sf_dir):
    return M.page_map(mapped(spark, sf_dir))


def manifest_whole(spark, sf_dir):
    """The manifests, read back: counts, the sizes of their lists and their first and last chunk."""
    rows = M.manifests(mapped(spark, sf_dir), target=TARGET, least=LEAST)
    get = lambda path: F.get_json_object("manifest", path)
    size = lambda name: F.json_array_length(get(f"$.{name}")).cast("long")
    return rows.select("doc", *(get(f"$.counts.{k}").cast("long").alias(k) for k in ("blocks", "headings", "chunks", "figures")), size("pages").alias("pages"), size("blocks").alias("named"), size("outline").alias("tops"), get("$.document.page_count").cast("long").alias("page_count"), get("$.chunks[0].id").alias("first_chunk"), get("$.tables[0].id").alias("first_table"))


QUERIES = {k.__name__: k for k in (chapter_lines, chapter_sizes, section_source, section_tree, digest_depth, source_digests, outline_nest, manifest_sections, manifest_chunks, manifest_objects, manifest_pages, manifest_whole)}

SQL_BOOK = f"""l AS (SELECT *, page * 100000 + pos AS spot FROM {BOOKS.sql}), h AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY spot) AS n FROM l WHERE level > 0),
c AS (SELECT l.book, l.page, l.pos, l.spot, l.line, coalesce(h.n, 0) AS n FROM l ASOF LEFT JOIN h ON h.book = l.book AND l.spot >= h.spot WHERE l.level = 0),
closed AS (SELECT h.*, (SELECT min(o.spot) FROM h o WHERE o.book = h.book AND o.spot > h.spot AND o.level <= h.level) AS closing FROM h)"""
SQL_TREE = f"""v AS (SELECT doc_id AS doc, pos, line, {SQL_LEVEL} AS raw FROM {TITLED.sql}), k AS (SELECT doc FROM v GROUP BY 1 HAVING count(*) FILTER (raw > 0) BETWEEN 1 AND count(*) - 1 AND count(*) FILTER (raw > 0) < 0.8 * count(*)),
r AS (SELECT *, sum(CASE WHEN raw > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS section FROM v SEMI JOIN k USING (doc)),
s AS (SELECT doc, section, arg_min(line, pos) AS title, arg_min(raw, pos) AS raw, CAST(sum(CASE WHEN raw = 0 THEN length(line) ELSE 0 END) AS BIGINT) AS chars FROM r WHERE section > 0 GROUP BY ALL),
up AS (SELECT a.*, (SELECT max(b.section) FROM s b WHERE b.doc = a.doc AND b.section < a.section AND b.raw < a.raw) AS parent, (SELECT min(b.section) FROM s b WHERE b.doc = a.doc AND b.section > a.section AND b.raw <= a.raw) AS closing FROM s a),
tree AS (SELECT *, 1 AS level, title AS path FROM up WHERE parent IS NULL UNION ALL SELECT u.*, t.level + 1, t.path || ' > ' || u.title FROM up u JOIN tree t ON t.doc = u.doc AND t.section = u.parent)"""
SQL_PARTS = f"""v AS (SELECT doc_id AS doc, pos, line, {SQL_LEVEL} AS level FROM {TITLED.sql}), pt AS (SELECT doc, pos, line, level, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS part, coalesce(last_value(CASE WHEN level > 0 THEN line END IGNORE NULLS) OVER w, 'Opening') AS title FROM v WINDOW w AS (PARTITION BY doc ORDER BY pos)),
p AS (SELECT doc, part, title, pos, line AS text FROM pt WHERE level = 0)"""


def sql_depth(budget: int) -> str:
    """took: doc, part, pos and round of the passages `g` (doc, part, pos, size) that fit."""
    return f"""a AS (SELECT *, row_number() OVER w AS i, sum(size) OVER w AS s, sum(size) OVER (PARTITION BY doc, part) AS n FROM g WINDOW w AS (PARTITION BY doc, part ORDER BY pos)), b AS (SELECT * FROM a WHERE s <= {budget}),
o AS (SELECT *, i = 1 AND sum(CASE WHEN i = 1 THEN size ELSE 0 END) OVER (PARTITION BY doc ORDER BY part, pos) <= {budget} AS one FROM b), rest AS (SELECT doc, CAST({budget} - coalesce(sum(size) FILTER (one), 0) AS BIGINT) AS room FROM o GROUP BY doc),
q AS (SELECT doc, part, size AS head, CAST(room * n // sum(n) OVER (PARTITION BY doc) AS BIGINT) AS fl, room * n % sum(n) OVER (PARTITION BY doc) AS fr, room FROM o JOIN rest USING (doc) WHERE i = 1), qq AS (SELECT doc, part, head, fl + CASE WHEN row_number() OVER (PARTITION BY doc ORDER BY fr DESC, part) <= room - sum(fl) OVER (PARTITION BY doc) THEN 1 ELSE 0 END AS quota FROM q),
t AS (SELECT o.*, NOT one AND i > 1 AND s - head <= quota AS two FROM o JOIN qq USING (doc, part)), spare AS (SELECT doc, room - coalesce(sum(size) FILTER (two), 0) AS room FROM t JOIN rest USING (doc) GROUP BY doc, room),
took AS (SELECT doc, part, pos, size, CASE WHEN one THEN 1 WHEN two THEN 2 WHEN sum(CASE WHEN one OR two THEN 0 ELSE size END) OVER (PARTITION BY doc ORDER BY part, pos) <= room THEN 3 END AS round FROM t JOIN spare USING (doc))"""


SQL_DIGEST = f"""{SQL_PARTS},
whole AS (SELECT doc, sum(length(text) + 2) - 2 AS chars, arg_max(text, (part, pos)) AS last, string_agg(text, chr(10) || chr(10) ORDER BY part, pos) AS text FROM p GROUP BY doc),
g AS (SELECT doc, part, pos, length(text) + {D.MARKS} + least(length(title), {D.LABEL}) AS size FROM p SEMI JOIN (SELECT doc FROM whole WHERE chars > {DIGEST}) USING (doc)), {sql_depth(DIGEST - DIGEST // 3 - DIGEST // 10 - 40)},
names AS (SELECT doc, part, arg_min(title, pos) AS title, sum(length(text)) AS n FROM p GROUP BY ALL), shares AS (SELECT *, floor(100.0 * n / sum(n) OVER (PARTITION BY doc) + 0.5) AS share, greatest(1, floor(({DIGEST // 3} - 12) / count(*) OVER (PARTITION BY doc)) - 9) AS room FROM names),
outl AS (SELECT doc, left('[OUTLINE] ' || string_agg(left(title, CAST(room AS BIGINT)) || ' (' || CAST(share AS BIGINT) || '%)', '; ' ORDER BY part), {DIGEST // 3}) AS outline FROM shares GROUP BY doc),
mk AS (SELECT p.*, lag(pos) OVER w AS b_pos, lag(part) OVER w AS b_part FROM p SEMI JOIN (SELECT * FROM took WHERE round IS NOT NULL) USING (doc, part, pos) WINDOW w AS (PARTITION BY doc ORDER BY part, pos)),
body AS (SELECT doc, string_agg(CASE WHEN b_pos IS NOT NULL AND pos <> b_pos + 1 THEN '[...]' || chr(10) ELSE '' END || CASE WHEN part IS DISTINCT FROM b_part THEN '[' || left(title, {D.LABEL}) || ']' || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY part, pos) AS body FROM mk GROUP BY doc),
made AS (SELECT doc, CASE WHEN chars <= {DIGEST} THEN text ELSE left(outline || chr(10) || chr(10) || coalesce(body || chr(10) || chr(10), '') || '[CLOSING] ' || left(last, {DIGEST // 10}), {DIGEST}) END AS digest FROM whole JOIN outl USING (doc) LEFT JOIN body USING (doc))"""
SQL_OUTLINE = f"""h AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page, pos) AS n FROM {HEADS.sql}), up AS (SELECT a.*, (SELECT max(b.n) FROM h b WHERE b.book = a.book AND b.n < a.n AND b.level < a.level) AS parent FROM h a),
tree AS (SELECT *, 1 AS depth FROM up WHERE parent IS NULL UNION ALL SELECT u.*, t.depth + 1 FROM up u JOIN tree t ON t.book = u.book AND t.n = u.parent)"""
SQL_MAP = f"""m AS (SELECT *, CASE WHEN kind = 'footnote' THEN 1 ELSE 0 END AS foot, length(CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'list' THEN '- ' || text WHEN 'quote' THEN '> ' || text WHEN 'footnote' THEN '[^' || seq || ']: ' || text ELSE text END) AS n FROM {KINDS.sql}),
k AS (SELECT *, CASE WHEN page IS DISTINCT FROM lag(page) OVER (PARTITION BY doc ORDER BY foot, seq) AND kind <> 'footnote' THEN length('<!-- page ' || page || ' -->') + 2 ELSE 0 END AS mark FROM m),
b AS (SELECT * EXCLUDE (n), CAST(coalesce(sum(mark + n + 2) OVER (PARTITION BY doc ORDER BY foot, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + mark AS BIGINT) AS md_start, n AS size, CAST(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY seq) AS BIGINT) AS sec FROM k),
e AS (SELECT *, md_start + size AS md_end FROM b),
h AS (SELECT * FROM e WHERE kind = 'heading'), up AS (SELECT a.doc, a.sec, a.seq, a.level, a.page, trim(a.text, ' ') AS title, (SELECT max(b.sec) FROM h b WHERE b.doc = a.doc AND b.sec < a.sec AND b.level < a.level) AS parent, (SELECT arg_min(b.page, b.sec) FROM h b WHERE b.doc = a.doc AND b.sec > a.sec AND b.level <= a.level) AS closing, (SELECT max(page) FROM e WHERE e.doc = a.doc) AS last FROM h a),
tree AS (SELECT *, title AS path FROM up WHERE parent IS NULL UNION ALL SELECT u.*, t.path || ' › ' || u.title FROM up u JOIN tree t ON t.doc = u.doc AND t.sec = u.parent),
w AS (SELECT doc, seq, CAST(0 AS BIGINT) AS chunk, length(text) AS chars FROM e WHERE seq = 0
  UNION ALL SELECT e.doc, e.seq, w.chunk + CASE WHEN f THEN 1 ELSE 0 END, CASE WHEN f THEN length(e.text) ELSE w.chars + length(e.text) END FROM (SELECT w.*, w.chars >= {TARGET} OR (x.kind = 'heading' AND w.chars >= {LEAST}) AS f, x.seq AS next FROM w JOIN e x ON x.doc = w.doc AND x.seq = w.seq + 1) w JOIN e ON e.doc = w.doc AND e.seq = w.next),
span AS (SELECT doc, chunk, min(sec) AS sec, min(page) AS page_start, max(page) AS page_end, CAST(sum(length(text)) AS BIGINT) AS chars, coalesce(string_agg(text, '|' ORDER BY seq) FILTER (kind = 'heading'), '') AS headings, string_agg(seq, ',' ORDER BY seq) AS blocks,
  coalesce(min(md_start) FILTER (kind <> 'footnote' AND md_end > md_start), min(md_start) FILTER (md_end > md_start), 0) AS md_start, coalesce(max(md_end) FILTER (kind <> 'footnote' AND md_end > md_start), max(md_end) FILTER (md_end > md_start), 0) AS md_end FROM w JOIN e USING (doc, seq) GROUP BY doc, chunk),
chunked AS (SELECT s.*, coalesce(path, '') AS path, coalesce(level, 1) AS level FROM span s LEFT JOIN tree t ON t.doc = s.doc AND t.sec = s.sec)"""
PAD = "CASE WHEN length(CAST({n} AS VARCHAR)) >= {w} THEN CAST({n} AS VARCHAR) ELSE lpad(CAST({n} AS VARCHAR), {w}, '0') END"
ORACLE = {
    "chapter_lines": f"WITH {SQL_BOOK} SELECT book, n, page, pos FROM c",
    "chapter_sizes": f"""WITH {SQL_BOOK}, s AS (SELECT book, n, CAST(sum(length(line)) AS BIGINT) AS chars, count(*) AS lines FROM c GROUP BY ALL), p AS (SELECT book, min(page) AS first, max(page) AS last FROM l GROUP BY 1)
SELECT book, n, line AS label, level, page AS start_page, CASE WHEN closing IS NULL THEN last ELSE greatest(page, closing // 100000 - 1) END AS end_page, coalesce(chars, 0) AS chars, coalesce(lines, 0) AS lines FROM closed JOIN p USING (book) LEFT JOIN s USING (book, n)
UNION ALL SELECT book, 0, 'Front matter', 1, first, coalesce((SELECT min(page) FROM h WHERE h.book = p.book), last), chars, lines FROM p JOIN s USING (book) WHERE n = 0 AND (chars > 200 OR NOT EXISTS (SELECT 1 FROM h WHERE h.book = p.book))""",
    "section_source": f"""WITH {SQL_BOOK}, f AS (SELECT book, upper(line) AS section, arg_min(spot, spot) AS spot, arg_min(coalesce(closing, 1000000000000), spot) AS closing FROM closed GROUP BY ALL),
q AS (SELECT book || ':' || section AS concept, book, spot, closing FROM f UNION ALL SELECT DISTINCT book || ': none', book, -1, 1000000000000 FROM l)
SELECT concept, q.book, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, min(l.spot) AS first FROM q JOIN l ON l.book = q.book AND l.spot > q.spot AND l.spot < q.closing GROUP BY ALL""",
    "section_tree": f"WITH RECURSIVE {SQL_TREE} SELECT t.doc, section, CAST(level AS BIGINT) AS level, md5(path) AS path, chars, CAST((SELECT sum(o.chars) FROM s o WHERE o.doc = t.doc AND o.section >= t.section AND (t.closing IS NULL OR o.section < t.closing)) AS BIGINT) AS total_chars FROM tree t",
    "digest_depth": f"WITH {SQL_PARTS}, g AS (SELECT doc, part, pos, length(text) AS size FROM p), {sql_depth(DIGEST)} SELECT doc, part, pos, size, round FROM took WHERE round IS NOT NULL",
    "source_digests": f"WITH {SQL_DIGEST} SELECT doc, length(digest) AS chars, md5(digest) AS digest FROM made",
    "outline_nest": f"WITH RECURSIVE {SQL_OUTLINE} SELECT book, n, depth, label, level, page FROM tree",
    "manifest_sections": f"WITH RECURSIVE {SQL_MAP} SELECT doc, 's' || {PAD.format(n='sec', w=3)} AS id, seq, level, page AS page_start, CASE WHEN closing IS NULL THEN last ELSE greatest(page, closing - 1) END AS page_end, md5(path) AS path FROM tree",
    "manifest_chunks": f"WITH RECURSIVE {SQL_MAP} SELECT doc, 'c' || {PAD.format(n='(chunk + 1)', w=3)} AS id, md5(path) AS path, level, row_number() OVER (PARTITION BY doc, path ORDER BY chunk) AS part, count(*) OVER (PARTITION BY doc, path) AS parts, page_start, page_end, chars, md5(headings) AS headings, blocks, md_start, md_end FROM chunked",
    "manifest_objects": f"WITH RECURSIVE {SQL_MAP}, o AS (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY seq) AS i FROM e WHERE kind IN ('table', 'figure', 'formula', 'footnote')) SELECT doc, seq, kind, CASE kind WHEN 'table' THEN 't' || {PAD.format(n='i', w=3)} WHEN 'figure' THEN 'f' || {PAD.format(n='i', w=3)} ELSE 'b' || {PAD.format(n='(seq + 1)', w=4)} END AS id, md_start, md_end FROM o",
    "manifest_pages": f"WITH RECURSIVE {SQL_MAP} SELECT doc, page AS number, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS blocks, coalesce(min(md_start) FILTER (kind <> 'footnote' AND md_end > md_start), min(md_start) FILTER (md_end > md_start), 0) AS md_start, coalesce(max(md_end) FILTER (kind <> 'footnote' AND md_end > md_start), max(md_end) FILTER (md_end > md_start), 0) AS md_end FROM e GROUP BY doc, page",
    "manifest_whole": f"""WITH RECURSIVE {SQL_MAP}, n AS (SELECT doc, count(*) AS chunks FROM chunked GROUP BY 1), t AS (SELECT doc, count(*) AS tops FROM tree WHERE parent IS NULL GROUP BY 1)
SELECT doc, count(*) AS blocks, count(*) FILTER (kind = 'heading') AS headings, max(chunks) AS chunks, count(*) FILTER (kind = 'figure') AS figures, count(DISTINCT page) AS pages, count(*) FILTER (kind IN ('heading', 'table', 'figure', 'formula', 'footnote')) AS named, coalesce(max(tops), 0) AS tops, max(page) AS page_count, 'c001' AS first_chunk, CASE WHEN count(*) FILTER (kind = 'table') > 0 THEN 't001' END AS first_table FROM e LEFT JOIN n USING (doc) LEFT JOIN t USING (doc) GROUP BY doc""",
}
