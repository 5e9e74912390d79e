"""Queries over lines and words of documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning, retrieval
from . import derived as D

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
BUDGET = 3000


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark, sf_dir):
    return T.lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def book_lines(spark, sf_dir):
    """Documents as pages of the book that their source is."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book"), "text")
    return T.lines(docs).withColumnRenamed("doc_id", "page").select("book", "page", "pos", "line")


SQL_LINES = D.SQL_LINES + ", book AS (SELECT source AS book, doc_id AS page, pos, line FROM lines)"
SQL_WORDS = f"list_filter(string_split_regex(lower(%s), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({STOP}))"
SQL_CLEAN = r"trim(regexp_replace(%s, '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ')"


def sql_chunks(table: str, text: str, keep: str) -> str:
    """CTE bodies: `chunked` (keep, chunks) of a table's text."""
    return rf"""
sentences AS (SELECT {keep}, {text} AS t, regexp_extract_all({text}, '{T.SENTENCE_KEEP_TAIL}') AS s FROM {table}),
folded AS (SELECT {keep}, t, list_reduce(list_prepend({{'done': []::VARCHAR[], 'now': ''}}, list_transform(s, lambda x: {{'done': []::VARCHAR[], 'now': x}})),
  lambda a, x: CASE WHEN length(a.now) + length(x.now) > 1200 AND length(a.now) > 200
    THEN {{'done': list_append(a.done, trim(a.now, ' ')), 'now': (CASE WHEN regexp_matches(right(a.now, 150), '[.!?。！？׃]\s') THEN regexp_replace(right(a.now, 150), '^(?s:.*?)[.!?。！？׃]\s', '') ELSE '' END) || x.now}}
    ELSE {{'done': a.done, 'now': a.now || x.now}} END) AS r FROM sentences),
chunked AS (SELECT {keep}, CASE WHEN length(t) <= 1200 THEN [trim(t, ' ')] ELSE list_filter(list_append(r.done, trim(r.now, ' ')), lambda x: x <> '') END AS chunks FROM folded)"""


SQL_PASSAGES = f"""
texts AS (SELECT doc_id, source, {SQL_CLEAN % 'text'} AS t0 FROM documents), {sql_chunks("(SELECT * FROM texts WHERE t0 <> '')", 't0', 'doc_id, source')},
passages AS (SELECT doc_id, source, unnest(range(0, len(chunks))) AS pos, unnest(chunks) AS text FROM chunked)"""
#: Which source each item asks in, where it asks in one.
SQL_ASKED = "asked AS (SELECT item_id, text, name AS source FROM benchmark JOIN (SELECT source AS name, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) ON item_id % m = k)"


def sql_scored(scope: bool = False) -> str:
    s, using = ("source, ", "source, word") if scope else ("", "word")
    n = "(SELECT count(*) FROM passages p WHERE p.source = q.source)" if scope else "(SELECT count(*) FROM passages)"
    return f"""
WITH {SQL_PASSAGES}, {SQL_ASKED},
tok AS (SELECT {s}doc_id, pos, unnest({SQL_WORDS % 'text'}) AS word FROM passages),
tf AS (SELECT {s}doc_id, pos, word, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT {s}word, count(*) AS df FROM tf GROUP BY ALL),
q0 AS (SELECT query_id, {s}word, count(*) AS times FROM (SELECT item_id AS query_id, {s}unnest({SQL_WORDS % 'text'}) AS word FROM {'asked' if scope else 'benchmark'}) GROUP BY ALL),
q AS (SELECT q.*, {n} AS n FROM q0 q),
scored AS (SELECT query_id, doc_id, pos, round(sum(times * (1 + ln(tf)) * ln(1 + n / df)), 6) AS score FROM q JOIN tf USING ({using}) JOIN df USING ({using}) GROUP BY ALL HAVING score > 0),
good AS (SELECT s.*, best FROM scored s JOIN (SELECT query_id, max(score) AS best FROM scored GROUP BY 1) USING (query_id) WHERE score >= 0.55 * best),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS rank FROM good),
chosen AS (SELECT * FROM ranked WHERE rank <= 5),
fitted AS (SELECT query_id, list_reduce(list(struct_pack(used := chars, picked := [struct_pack(rank := rank, doc_id := doc_id, pos := pos, chars := chars)]) ORDER BY rank),
  lambda a, x: CASE WHEN a.used + x.used <= {BUDGET} THEN struct_pack(used := a.used + x.used, picked := list_concat(a.picked, x.picked)) ELSE a END).picked AS picked
  FROM (SELECT r.*, length(text) AS chars FROM ranked r JOIN passages USING (doc_id, pos)) GROUP BY query_id),
picked AS (SELECT query_id, p.rank, p.doc_id, p.pos, p.chars FROM (SELECT query_id, unnest(picked) AS p FROM fitted)),
placed AS (SELECT k.*, text, CAST(coalesce(sum(k.chars) OVER (PARTITION BY query_id ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM picked k JOIN passages USING (doc_id, pos)),
trimmed AS (SELECT query_id, doc_id, pos, used, {SQL_TRIMMED} AS text FROM placed WHERE used < {BUDGET})"""


SQL_TRIMMED = rf"CASE WHEN length(text) <= {BUDGET} - used THEN text WHEN length(regexp_extract(left(text, {BUDGET} - used), '^((?s:.*)[.!?׃。])', 1)) - 1 > 0.4 * ({BUDGET} - used) THEN trim(regexp_extract(left(text, {BUDGET} - used), '^((?s:.*)[.!?׃。])', 1), ' ') ELSE trim(left(text, {BUDGET} - used), ' ') END"


def doc_passages(spark, sf_dir):
    return retrieval.passages(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def scored(spark, sf_dir):
    return retrieval.score(doc_passages(spark, sf_dir), read(spark, sf_dir, "benchmark"), floor=retrieval.FLOOR)


def retrieve_tfidf_topk(spark, sf_dir):
    return retrieval.top(scored(spark, sf_dir))


def retrieve_floor(spark, sf_dir):
    return retrieval.ranked(scored(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("kept"), F.max("best").alias("best"))


def asked_in_source(spark, sf_dir):
    """Each item with the source that it asks in: the sources in turn."""
    names = read(spark, sf_dir, "documents").select("source").filter("source is not null").distinct()
    numbered = names.agg(F.array_sort(F.collect_set("source")).alias("all"))  # sources are few
    items = read(spark, sf_dir, "benchmark").join(F.broadcast(numbered))
    return items.select("item_id", "text", F.try_element_at("all", (F.col("item_id") % F.size("all") + 1).cast("int")).alias("source"))


def retrieve_in_chapter(spark, sf_dir):
    """Each item asks in one source; words are counted there."""
    return retrieval.top(retrieval.score(doc_passages(spark, sf_dir), asked_in_source(spark, sf_dir), scope=("source",), floor=retrieval.FLOOR))


def retrieve_budget_prefix(spark, sf_dir):
    """Without a question: each document from its start, up to the budget, the last passage trimmed."""
    rows = retrieval.trim(doc_passages(spark, sf_dir), "doc_id", ("pos",), BUDGET)
    return rows.select("doc_id", "pos", "used", F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("md5"))


def picked(spark, sf_dir):
    return retrieval.pick(retrieval.ranked(scored(spark, sf_dir)), BUDGET)


def retrieve_knapsack(spark, sf_dir):
    return picked(spark, sf_dir).select("query_id", "rank", "doc_id", "pos", "chars")


def retrieve_relevant(spark, sf_dir):
    """All steps: floor, skip rule, document order, trimming, gap marks."""
    rows = retrieval.relevant(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), read(spark, sf_dir, "benchmark"), BUDGET)
    return rows.select("query_id", "doc_id", "pos", F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("md5"), "opens", "gap")


def retrieve_gap_markers(spark, sf_dir):
    return retrieval.gap_marks(retrieval.top(scored(spark, sf_dir)))


def retrieve_coverage(spark, sf_dir):
    rows = picked(spark, sf_dir)
    return rows.groupBy("query_id").agg(F.sum("chars").alias("chars"), F.count_distinct("doc_id").alias("documents"))


def tokenize_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("kinds"))


def doc_frequency(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("df"))


def doc_terms_top8(spark, sf_dir):
    return retrieval.terms(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source")


def fingerprint_repeat(spark, sf_dir):
    return cleaning.repeated_edges(book_lines(spark, sf_dir), share=0.05)


def furniture_anti_join(spark, sf_dir):
    left = cleaning.drop_furniture(book_lines(spark, sf_dir), share=0.05)
    return left.groupBy("book", "page").agg(F.count("*").alias("lines_left"))


def furniture_stats(spark, sf_dir):
    return cleaning.dropped(book_lines(spark, sf_dir))


def material_fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))


def script_ratio(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rtl, latin = T.rtl_letters(F.col("text")), T.latin_letters(F.col("text"))
    return docs.select("doc_id", rtl.alias("rtl"), latin.alias("latin"), F.when(rtl > latin, "rtl").otherwise("ltr").alias("direction"))


def direction_vote(spark, sf_dir):
    return cleaning.direction_votes(DIRECTIONS.df(spark, sf_dir), "book")


def material_stats(spark, sf_dir):
    """Characters, words, share of letters and digits, sentences, distinct words of each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    w = F.filter(F.split(F.lower("t"), T.WORD_SPLIT), lambda x: x != "")
    n = F.char_length("t")
    rows = docs.select("doc_id", n.cast("long").alias("chars"), F.regexp_count("t", F.lit(r"\p{L}")).alias("letters"), F.regexp_count("t", F.lit(r"[0-9]")).alias("digits"), F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("kinds"), F.regexp_count("t", F.lit(r"[.!?]+")).cast("long").alias("sentences"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 6)
    return rows.select("doc_id", "chars", "words", "sentences", share("letters", "chars").alias("letter_share"), share("digits", "chars").alias("digit_share"), share("kinds", "words").alias("vocabulary"), share("words", "sentences").alias("words_per_sentence"))


def material_gate(spark, sf_dir):
    """null for prose, else the first reason against a document: thresholds are ours, but for the 600 characters."""
    s = material_stats(spark, sf_dir)
    code = F.when(F.col("chars") < 600, "too-short").when(F.col("digit_share") > 0.3, "mostly-numbers").when((F.col("letter_share") < 0.55) | (F.col("sentences") < 3), "not-prose").when(F.col("vocabulary") < 0.1, "repetitive")
    return s.select("doc_id", F.coalesce(code, F.lit("ok")).alias("verdict"))


def worksheet_gate(spark, sf_dir):
    s = material_stats(spark, sf_dir)
    return s.select("doc_id", F.when(F.col("chars") < 80, "too-short").when(F.col("vocabulary") < 0.1, "repetitive").otherwise("ok").alias("verdict"))


def pages_html_headings(spark, sf_dir):
    """The first heading, list items and paragraphs of web pages."""
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


def digest_round_robin(spark, sf_dir):
    """One line of each document of a source before any second one, up to a budget of characters.

    A line has 40 characters at least, so a source's digest has a bounded number: all others go before anything moves.
    """
    from pyspark.sql import Window

    budget, least = 5000, 40
    every = F.transform(F.split("text", "\n"), lambda x, k: F.struct(k.cast("long").alias("pos"), F.trim(x).alias("line")))
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.filter(every, lambda x: F.char_length(x["line"]) >= least)).alias("turn", "x"))
    rows = rows.select("source", "doc_id", "x.pos", (F.col("turn") + 1).cast("long").alias("turn"), F.char_length("x.line").cast("long").alias("size"))
    order = Window.partitionBy("source").orderBy("turn", "doc_id")
    rows = rows.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= budget // least)
    rows = rows.withColumn("used", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(F.col("used") <= budget).select("source", "doc_id", "pos", "turn", "used")


def chunk_text(spark, sf_dir):
    """Documents as chunks of whole sentences (the tail kept)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.pack_sentences(F.col("text")).alias("chunks"))
    return docs.select("doc_id", F.posexplode("chunks").alias("n", "chunk")).select("doc_id", F.col("n").cast("long").alias("n"), F.char_length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("md5"))


CONTENTS, DIRECTIONS, MARKED, HYPHENS = D.CONTENTS, D.DIRECTIONS, D.MARKED, D.BROKEN


def line_tests(spark, sf_dir):
    line = F.col("line")
    return MARKED.df(spark, sf_dir).select("doc_id", "pos", T.is_page_number(line).alias("page_number"), T.is_contents_row(line).alias("contents_row"), T.is_decoration(line).alias("decoration"), T.is_list_item(line).alias("list_item"), T.is_caption(line).alias("caption"))


def page_number_filter(spark, sf_dir):
    return MARKED.df(spark, sf_dir).filter(T.is_page_number(F.col("line"))).select("doc_id", "pos", "line")


def decoration_filter(spark, sf_dir):
    return MARKED.df(spark, sf_dir).filter(T.is_decoration(F.col("line"))).select("doc_id", "pos")


def list_items(spark, sf_dir):
    return MARKED.df(spark, sf_dir).filter(T.is_list_item(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("items"))


def caption_lines(spark, sf_dir):
    return MARKED.df(spark, sf_dir).filter(T.is_caption(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("captions"))


def toc_pages(spark, sf_dir):
    return cleaning.contents_pages(CONTENTS.df(spark, sf_dir))


def flip_line(spark, sf_dir):
    rows = doc_lines(spark, sf_dir).withColumn("flipped", T.flip(F.col("line")))
    return rows.select("doc_id", "pos", F.md5("flipped").alias("flipped"), (T.flip(F.col("flipped")) == F.col("line")).alias("back"))


def hyphen_join(spark, sf_dir):
    """Lines of each document with words healed that a hyphen cut."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return HYPHENS.df(spark, sf_dir).groupBy("id").agg(T.join_hyphens(ordered).alias("lines")).select("id", F.array_join("lines", "|").alias("lines"))


def _re(p):
    return p.replace("'", "''")


I = "'i'"  # noqa: E741
SQL_NUMBER = f"(regexp_matches(line, '{_re(T.PAGE_NUMBER)}', {I}) AND line <> '')"
SQL_TOC = f"regexp_matches(line, '{_re(T.TOC_ROW)}', {I})"
SQL_RULE = f"regexp_matches(line, '{_re(T.DECORATION)}')"
SQL_ITEM = f"(regexp_matches(line, '{_re(T.BULLET)}') OR regexp_matches(line, '{_re(T.NUMBERED)}') OR regexp_matches(line, '{_re(T.BULLET_RTL)}'))"
SQL_CAPTION = f"regexp_matches(trim(line, ' '), '{_re(T.CAPTION)}', {I})"
SQL_FP = "regexp_replace(lower(trim(%s, ' ')), '[0-9]+', '#', 'g')"


def _sql_edges(share):
    return f"""
edged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY pos) AS nth, count(*) OVER (PARTITION BY book, page) AS n FROM book) WHERE nth <= 3 OR n - nth + 1 <= 3),
seen AS (SELECT DISTINCT book, page, {SQL_FP % 'line'} AS fp FROM edged WHERE length(line) BETWEEN 4 AND 90),
rep AS (SELECT book, fp, count(*) AS n FROM seen JOIN (SELECT book, count(DISTINCT page) AS pages FROM book GROUP BY 1) USING (book) GROUP BY book, fp, pages
  HAVING pages >= 4 AND count(*) >= greatest(3, floor(pages * {share}))),
left_over AS (SELECT b.* FROM book b ANTI JOIN (SELECT e.book, e.page, e.pos FROM edged e JOIN rep r ON e.book = r.book AND {SQL_FP % 'e.line'} = r.fp WHERE length(e.line) BETWEEN 4 AND 90) x ON b.book = x.book AND b.page = x.page AND b.pos = x.pos)"""


SQL_STATS = r"""
w AS (SELECT doc_id, text AS t, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, length(t) AS chars, len(regexp_extract_all(t, '\p{L}')) AS letters, len(regexp_extract_all(t, '[0-9]')) AS digits, len(w) AS words, len(list_distinct(w)) AS kinds, len(regexp_extract_all(t, '[.!?]+')) AS sentences FROM w),
s AS (SELECT doc_id, chars, words, sentences, round(coalesce(letters / nullif(chars, 0), 0), 6) AS letter_share, round(coalesce(digits / nullif(chars, 0), 0), 6) AS digit_share,
  round(coalesce(kinds / nullif(words, 0), 0), 6) AS vocabulary, round(coalesce(words / nullif(sentences, 0), 0), 6) AS words_per_sentence FROM c)"""

QUERIES = {
    k.__name__: k
    for k in (
        retrieve_tfidf_topk, retrieve_floor, retrieve_in_chapter, retrieve_budget_prefix, retrieve_knapsack, retrieve_relevant, retrieve_gap_markers, retrieve_coverage, tokenize_counts, doc_frequency, doc_terms_top8,
        fingerprint_repeat, furniture_anti_join, furniture_stats, material_fingerprint, script_ratio, direction_vote, material_stats, material_gate, worksheet_gate, pages_html_headings,
        digest_round_robin, chunk_text, line_tests, page_number_filter, decoration_filter, list_items, caption_lines, toc_pages, flip_line, hyphen_join,
    )
}

ORACLE = {
    "retrieve_tfidf_topk": f"{sql_scored()} SELECT query_id, doc_id, pos, score, rank FROM chosen",
    "retrieve_floor": f"{sql_scored()} SELECT query_id, count(*) AS kept, max(score) AS best FROM good GROUP BY 1",
    "retrieve_in_chapter": f"{sql_scored(True)} SELECT query_id, doc_id, pos, score, rank FROM chosen",
    "retrieve_budget_prefix": f"WITH {SQL_PASSAGES}, placed AS (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM passages) SELECT doc_id, pos, used, length(text) AS chars, md5(text) AS md5 FROM (SELECT doc_id, pos, used, {SQL_TRIMMED} AS text FROM placed WHERE used < {BUDGET}) WHERE text <> ''",
    "retrieve_knapsack": f"{sql_scored()} SELECT query_id, rank, doc_id, pos, chars FROM picked",
    "retrieve_relevant": f"{sql_scored()}, g AS (SELECT *, lag(doc_id) OVER w AS d, lag(pos) OVER w AS p FROM trimmed WHERE text <> '' WINDOW w AS (PARTITION BY query_id ORDER BY doc_id, pos)) SELECT query_id, doc_id, pos, length(text) AS chars, md5(text) AS md5, d IS DISTINCT FROM doc_id AS opens, coalesce(d = doc_id AND pos <> p + 1, false) AS gap FROM g",
    "retrieve_gap_markers": f"{sql_scored()}, g AS (SELECT query_id, doc_id, pos, lag(doc_id) OVER w AS d, lag(pos) OVER w AS p FROM chosen WINDOW w AS (PARTITION BY query_id ORDER BY doc_id, pos)) SELECT query_id, doc_id, pos, d IS DISTINCT FROM doc_id AS opens, coalesce(d = doc_id AND pos <> p + 1, false) AS gap FROM g",
    "retrieve_coverage": f"{sql_scored()} SELECT query_id, CAST(sum(chars) AS BIGINT) AS chars, count(DISTINCT doc_id) AS documents FROM picked GROUP BY 1",
    "chunk_text": f"WITH {sql_chunks('documents', 'text', 'doc_id')} SELECT doc_id, n, length(chunk) AS chars, md5(chunk) AS md5 FROM (SELECT doc_id, unnest(range(0, len(chunks))) AS n, unnest(chunks) AS chunk FROM chunked)",
    "tokenize_counts": f"SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS kinds FROM (SELECT doc_id, {SQL_WORDS % 'text'} AS w FROM documents)",
    "doc_frequency": f"SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct({SQL_WORDS % 'text'})) AS word FROM documents) GROUP BY 1",
    "doc_terms_top8": f"""WITH tf AS (SELECT source, doc_id, word, count(*) AS tf FROM (SELECT source, doc_id, unnest({SQL_WORDS % 'text'}) AS word FROM documents) GROUP BY ALL),
df AS (SELECT source, word, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
s AS (SELECT source, doc_id, word, round(tf * ln(1 + n / df), 6) AS score FROM tf JOIN df USING (source, word) JOIN n USING (source) WHERE df <= greatest(2.0, 0.6 * n)),
r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source, doc_id ORDER BY score DESC, word DESC) AS rank, word, score FROM s) SELECT * FROM r WHERE rank <= 8""",
    "fingerprint_repeat": f"WITH {SQL_LINES}, {_sql_edges(0.05)} SELECT book, fp, n FROM rep",
    "furniture_anti_join": f"WITH {SQL_LINES}, {_sql_edges(0.05)} SELECT book, page, count(*) AS lines_left FROM left_over GROUP BY ALL",
    "furniture_stats": f"WITH {SQL_LINES}, {_sql_edges(0.35)}, toc AS (SELECT book, count(*) AS k FROM (SELECT book, page FROM book GROUP BY ALL HAVING count(*) >= 4 AND count(*) FILTER ({SQL_TOC}) >= 3 AND count(*) FILTER ({SQL_TOC}) >= 0.4 * count(*)) GROUP BY 1) SELECT b.book, b.n - coalesce(l.n, 0) AS headers, b.page_numbers, b.decoration, coalesce(toc.k, 0) AS contents_pages FROM (SELECT book, count(*) AS n, count(*) FILTER ({SQL_NUMBER}) AS page_numbers, count(*) FILTER ({SQL_RULE}) AS decoration FROM book GROUP BY 1) b LEFT JOIN (SELECT book, count(*) AS n FROM left_over GROUP BY 1) l USING (book) LEFT JOIN toc USING (book)",
    "material_fingerprint": "SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint FROM documents",
    "script_ratio": r"SELECT doc_id, rtl, latin, CASE WHEN rtl > latin THEN 'rtl' ELSE 'ltr' END AS direction FROM (SELECT doc_id, len(regexp_extract_all(text, '[\x{0590}-\x{05ff}\x{0600}-\x{06ff}]')) AS rtl, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM documents)",
    "direction_vote": f"WITH v AS (SELECT book, CAST(sum(len(list_intersect(list_distinct(regexp_extract_all(text, '[\\x{{0590}}-\\x{{05ff}}]+')), {T.MARKERS}))) AS BIGINT) AS forward, CAST(sum(len(list_intersect(list_distinct(regexp_extract_all(reverse(text), '[\\x{{0590}}-\\x{{05ff}}]+')), {T.MARKERS}))) AS BIGINT) AS backward FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page) AS nth FROM {DIRECTIONS.sql}) WHERE nth <= 30 GROUP BY book) SELECT book, forward, backward, backward > forward AS flipped FROM v",
    "material_stats": f"WITH {SQL_STATS} SELECT * FROM s",
    "material_gate": f"WITH {SQL_STATS} SELECT doc_id, CASE WHEN chars < 600 THEN 'too-short' WHEN digit_share > 0.3 THEN 'mostly-numbers' WHEN letter_share < 0.55 OR sentences < 3 THEN 'not-prose' WHEN vocabulary < 0.1 THEN 'repetitive' ELSE 'ok' END AS verdict FROM s",
    "worksheet_gate": f"WITH {SQL_STATS} SELECT doc_id, CASE WHEN chars < 80 THEN 'too-short' WHEN vocabulary < 0.1 THEN 'repetitive' ELSE 'ok' END AS verdict FROM s",
    "pages_html_headings": "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages",
    "digest_round_robin": f"WITH {SQL_LINES}, t AS (SELECT source, doc_id, pos, length(line) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS turn FROM lines WHERE length(line) >= 40), u AS (SELECT source, doc_id, pos, turn, CAST(sum(k) OVER (PARTITION BY source ORDER BY turn, doc_id) AS BIGINT) AS used FROM t) SELECT * FROM u WHERE used <= 5000",
    "line_tests": f"SELECT doc_id, pos, {SQL_NUMBER} AS page_number, {SQL_TOC} AS contents_row, {SQL_RULE} AS decoration, {SQL_ITEM} AS list_item, {SQL_CAPTION} AS caption FROM {MARKED.sql}",
    "page_number_filter": f"SELECT doc_id, pos, line FROM {MARKED.sql} WHERE {SQL_NUMBER}",
    "decoration_filter": f"SELECT doc_id, pos FROM {MARKED.sql} WHERE {SQL_RULE}",
    "list_items": f"SELECT doc_id, count(*) AS items FROM {MARKED.sql} WHERE {SQL_ITEM} GROUP BY 1",
    "caption_lines": f"SELECT doc_id, count(*) AS captions FROM {MARKED.sql} WHERE {SQL_CAPTION} GROUP BY 1",
    "toc_pages": f"SELECT book, page, count(*) AS n, count(*) FILTER ({SQL_TOC}) AS rows FROM {CONTENTS.sql} GROUP BY ALL HAVING count(*) >= 4 AND count(*) FILTER ({SQL_TOC}) >= 3 AND count(*) FILTER ({SQL_TOC}) >= 0.4 * count(*)",
    "flip_line": rf"WITH {SQL_LINES}, r AS (SELECT doc_id, pos, regexp_extract_all(reverse(line), '(?s)(?:[0-9A-Za-z.,:/\\-]*[0-9A-Za-z]|.)') AS p FROM lines) SELECT doc_id, pos, md5(array_to_string(list_transform(p, lambda x: CASE WHEN length(x) > 1 AND regexp_matches(x, '^[0-9A-Za-z.,:/\\-]+$') THEN reverse(x) ELSE x END), '')) AS flipped, true AS back FROM r",
    "hyphen_join": rf"""WITH l AS (SELECT id, list([line] ORDER BY n) AS l FROM {HYPHENS.sql} GROUP BY id),
r AS (SELECT id, list_reduce(l, lambda k, x: CASE WHEN regexp_matches(k[-1], '[A-Za-zÀ-ɏ]{{2,}}-$') AND regexp_matches(x[1], '^[a-zß-ÿ]')
  THEN list_concat(list_append(k[:-2], left(k[-1], length(k[-1]) - 1) || regexp_extract(x[1], '^(\S+)\s*', 1)), list_filter([regexp_replace(x[1], '^\S+\s*', '')], lambda y: y <> '')) ELSE list_concat(k, x) END) AS l FROM l)
SELECT id, array_to_string(l, '|') AS lines FROM r""",
}
