"""Inputs that the tables do not have, made of those they have: one SELECT that both engines run.

The operators work on boxes, blocks, headings, bundles and records of a proxy; here a document's lines stand for them,
their places worked out from positions and lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T

SQL_LINES = """
lines AS (
  SELECT doc_id, source, i - 1 AS pos, trim(part, ' ') AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i)
  WHERE trim(part, ' ') <> ''
)"""


class Derived:
    """A SELECT over tables and `lines` (doc_id, source, pos, line), each named in braces."""

    def __init__(self, select: str):
        self.select = select

    def over(self, **given: DataFrame) -> DataFrame:
        """The SELECT over these frames, streams among them."""
        return next(iter(given.values())).sparkSession.sql(self.select, **given)

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        given = {}
        for name in ("lines", "documents", "conversations", "events", "orders"):
            if "{" + name + "}" in self.select:
                given[name] = T.lines(read("documents").select("doc_id", "source", "text")) if name == "lines" else read(name)
        return spark.sql(self.select, **given)

    @property
    def sql(self) -> str:
        body = self.select.format(**{n: n for n in ("lines", "documents", "conversations", "events", "orders")})
        return f"(WITH {SQL_LINES} {body})" if "{lines}" in self.select else f"({body})"


def whole(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


#: Boxes of lines as a reader without geometry gives them: one below the other, as wide as they are long.
PLAIN_BOXES = Derived("SELECT concat('d', doc_id) AS doc, CAST(1 AS BIGINT) AS page, pos AS seq, line AS text FROM {lines}")

#: Pages of two columns under a wide heading, and of one column, with some larger and smaller lines.
LAID_OUT = Derived(f"""
SELECT doc, page, seq, x0, top, x0 + wide AS x1, top + 12 AS bottom, text, size, CAST(CASE WHEN two THEN seq % 2 ELSE 0 END AS BIGINT) AS col FROM (
  SELECT doc, page, seq, two, CASE kind WHEN 0 THEN concat('• item ', substr(line, 1, 30)) WHEN 1 THEN concat('Figure ', pos, ': a thing') WHEN 2 THEN concat('x_', pos, ' = y^2 + z') WHEN 3 THEN concat('[', pos, '] a note') WHEN 4 THEN concat(substr(line, 1, 20), ' consid-') WHEN 5 THEN concat('eration of ', substr(line, 1, 40)) ELSE line END AS text,
    CAST(CASE WHEN two THEN 60 + 260 * (seq % 2) ELSE 60 + 15 * (length(line) % 2) END AS DOUBLE) AS x0,
    CAST(CASE WHEN seq = 0 THEN 480 WHEN two THEN least(210, 20 + 6 * length(line)) ELSE least(450, 20 + 6 * length(line)) END AS DOUBLE) AS wide,
    CAST(60 + CASE WHEN two THEN 14 * floor((seq + 1) / 2) ELSE 14 * seq END + 26 * floor(seq / 7) AS DOUBLE) AS top,
    CAST(CASE length(line) % 9 WHEN 0 THEN 14 WHEN 1 THEN 9 WHEN 2 THEN 18 ELSE 11 END AS DOUBLE) AS size
  FROM (SELECT concat('d', doc_id) AS doc, {whole('1 + pos / 24')} AS page, pos % 24 AS seq, pos, line, (pos * 5 + doc_id) % 11 AS kind, pos % 24 <> 0 AND (doc_id + {whole('pos / 24')}) % 2 = 0 AS two FROM {{lines}}))""")
#: Pieces of lines as a reader of pages gives them, on pages of one, two and three columns and with notes in the margin:
#: every line whole, cut in two at a third, at a change of font with or without a space, or with a wide gap.
FRAGMENTS = Derived(f"""
SELECT doc, page, seq, x0, top, x0 + length(text) * unit AS x1, top + 10 AS bottom, trim(text) AS text, size, bold, text LIKE ' %' AS pad_left, text LIKE '% ' AS pad_right FROM (
  SELECT doc, page, 2 * n AS seq, x0, top, substr(line, 1, cut) AS text, unit, size, doc_id % 3 = 0 AS bold FROM cut_lines
  UNION ALL SELECT doc, page, 2 * n + 1, x0 + cut * unit + far, top + slip, substr(line, cut + 1), unit, CASE WHEN far > 0 THEN size ELSE 9.0 END, n % 5 = 1 FROM cut_lines)
WHERE trim(text) <> ''""".replace("cut_lines", f"""(
    SELECT *, CASE WHEN n % 3 = 0 THEN length(line) ELSE {whole('length(line) / 3')} END AS cut, CAST(CASE n % 7 WHEN 1 THEN 40 WHEN 2 THEN 3 ELSE 0 END AS DOUBLE) AS far, CAST(n % 2 AS DOUBLE) AS slip, CAST(least(5.0, wide / length(line)) AS DOUBLE) AS unit FROM (
      SELECT *, CAST(CASE WHEN n = 0 AND kind > 0 THEN 480 WHEN kind = 0 THEN 440 WHEN kind = 1 THEN 190 WHEN kind = 2 THEN 120 WHEN n % 4 = 3 THEN 20 ELSE 330 END AS DOUBLE) AS wide,
        CAST(CASE WHEN n = 0 AND kind > 0 THEN 55 WHEN kind = 1 THEN 60 + 260 * (n % 2) WHEN kind = 2 THEN 55 + 165 * (n % 3) WHEN kind = 3 AND n % 4 = 3 THEN 480 ELSE 60 END AS DOUBLE) AS x0,
        CAST(50 + CASE kind WHEN 1 THEN 16 * floor((n + 1) / 2) WHEN 2 THEN 16 * floor((n + 2) / 3) ELSE 16 * n END AS DOUBLE) AS top, CAST(CASE WHEN n = 0 THEN 16 ELSE 11 END AS DOUBLE) AS size
      FROM (SELECT doc_id, concat('d', doc_id) AS doc, {whole('1 + pos / 30')} AS page, pos % 30 AS n, line, (doc_id + {whole('pos / 30')}) % 4 AS kind FROM {{lines}})))"""))
#: Books with geometry: a running head at the top of most pages, page numbers, rules, contents pages, and whole lines; some
#: lines are of another script, in every fifth book the wrong way round.
PRINTED = Derived(f"""
SELECT book AS doc, page, seq, top, top + 10 AS bottom, text FROM (
  SELECT DISTINCT book, page, CAST(0 AS BIGINT) AS seq, CAST(30 AS DOUBLE) AS top, concat('The Quarterly Review - Volume 4, page ', page) AS text FROM books WHERE page % 5 <> 0
  UNION ALL SELECT DISTINCT book, page, CAST(100000 AS BIGINT), CAST(815 AS DOUBLE), concat('- ', page, ' -') FROM books
  UNION ALL SELECT book, page, pos + 1, CAST(60 + (pos * 13) % 700 AS DOUBLE), CASE WHEN page % 9 = 8 THEN concat(pos, '. A part ..... ', pos * 3) WHEN (page + pos) % 17 = 3 THEN '* * * *' WHEN (page + pos) % 4 <> 1 THEN line WHEN nth % 5 = 0 THEN reverse('פרק 12 הוא אשר על כל זה') ELSE 'לא את של גם כי אשר על 7' END FROM books)
""".replace("books", f"(SELECT doc_id % 40 AS nth, concat('k', doc_id % 40) AS book, {whole('1 + doc_id / 40')} AS page, pos, line FROM {{lines}})"))
SHEETS = Derived(f"SELECT DISTINCT concat('k', doc_id % 40) AS doc, {whole('1 + doc_id / 40')} AS page, CAST(842 AS DOUBLE) AS height FROM {{lines}}")
#: Lines, tables, images and drawings of crowded pages; some lines are captions.
OBJECT_LINES = Derived(f"""
SELECT doc, page, seq, x0, top, x0 + wide AS x1, top + 10 AS bottom, text FROM (
  SELECT concat('d', doc_id) AS doc, {whole('1 + pos / 60')} AS page, pos % 60 AS seq, CAST(60 + 90 * (length(line) % 3) AS DOUBLE) AS x0, CAST(40 + 13 * (pos % 60) AS DOUBLE) AS top, CAST(least(300, 20 + 5 * length(line)) AS DOUBLE) AS wide,
    CASE pos % 5 WHEN 0 THEN concat('Figure ', pos, ': ', line) WHEN 3 THEN concat('Table ', pos, ' - ', line) ELSE line END AS text FROM {{lines}})""")
TABLES = Derived(f"""
SELECT doc, page, seq, x0, top, x0 + wide AS x1, top + tall AS bottom FROM (
  SELECT concat('d', doc_id) AS doc, {whole('1 + pos / 60')} AS page, pos % 60 AS seq, CAST(50 + 20 * (length(line) % 7) AS DOUBLE) AS x0, CAST(30 + (pos * 41 + length(line)) % 720 AS DOUBLE) AS top, CAST(150 + length(line) % 250 AS DOUBLE) AS wide, CAST(15 + length(line) % 50 AS DOUBLE) AS tall
  FROM {{lines}} WHERE length(line) % 4 = 0)""")
IMAGES = Derived(f"""
SELECT doc, page, seq, x0, top, x0 + wide AS x1, top + tall AS bottom FROM (
  SELECT concat('d', doc_id) AS doc, {whole('1 + pos / 60')} AS page, pos % 60 AS seq, CAST((pos * 37 + length(line) * 3) % 300 AS DOUBLE) AS x0, CAST((pos * 53 + length(line)) % 600 AS DOUBLE) AS top, CAST(20 + length(line) * 7 % 500 AS DOUBLE) AS wide, CAST(20 + length(line) * 11 % 700 AS DOUBLE) AS tall
  FROM {{lines}} WHERE length(line) % 5 = 1)""")
DRAWINGS = Derived(f"""
SELECT doc, page, 1000 + seq AS seq, x0, top, x0 + wide AS x1, top + tall AS bottom FROM (
  SELECT concat('d', doc_id) AS doc, {whole('1 + pos / 60')} AS page, pos % 60 AS seq, CAST(40 + 180 * (pos % 3) + length(line) % 120 AS DOUBLE) AS x0, CAST(40 + 250 * ({whole('pos / 3')} % 3) + length(line) * 13 % 150 AS DOUBLE) AS top, CAST(4 + length(line) % 45 AS DOUBLE) AS wide, CAST(3 + length(line) * 3 % 50 AS DOUBLE) AS tall FROM {{lines}})""")
PAGE_SIZES = Derived(f"SELECT DISTINCT concat('d', doc_id) AS doc, {whole('1 + pos / 60')} AS page, CAST(595 AS DOUBLE) AS width, CAST(842 AS DOUBLE) AS height, doc_id % 5 = 0 AS scanned FROM {{lines}}")
SPANS = Derived(f"""
SELECT doc, page, seq, x0, top, x0 + 40 AS x1, top + 10 AS bottom, text FROM (
  SELECT concat('d', doc_id) AS doc, {whole('1 + pos / 30')} AS page, pos AS seq, CAST((pos * 37 + doc_id * 13) % 280 AS DOUBLE) AS x0, CAST((pos * 29 + doc_id * 7) % 95 AS DOUBLE) AS top, concat('s', pos) AS text FROM {{lines}})""")
CELLS = Derived(f"""
SELECT doc, page, seq, x0, top, x0 + 100 AS x1, top + 50 AS bottom FROM (
  SELECT concat('d', doc_id) AS doc, CAST(1 AS BIGINT) AS page, pos AS seq, CAST(100 * (pos % 3) AS DOUBLE) AS x0, CAST(50 * floor(pos / 3) AS DOUBLE) AS top FROM {{lines}} WHERE pos < 6)""")
FIGURES = Derived("""
SELECT doc, page, seq, x0, top, x0 + 120 AS x1, top + 20 AS bottom FROM (
  SELECT concat('d', doc_id) AS doc, CAST(1 AS BIGINT) AS page, pos AS seq, CAST(90 * pos AS DOUBLE) AS x0, CAST(20 + 25 * pos AS DOUBLE) AS top FROM {lines} WHERE pos < 3)""")
CAPTIONS = Derived("""
SELECT doc, page, seq, x0, top, x0 + 60 AS x1, top + 10 AS bottom, caption FROM (
  SELECT concat('d', doc_id) AS doc, CAST(1 AS BIGINT) AS page, pos AS seq, CAST((pos * 47) % 200 AS DOUBLE) AS x0, CAST((pos * 31 + doc_id * 11) % 160 AS DOUBLE) AS top, (pos + doc_id) % 3 <> 0 AS caption FROM {lines} WHERE pos < 8)""")
#: Lines as blocks of several kinds, four to a page.
BLOCKS = Derived(f"""
SELECT doc, seq, kind, 1 + seq % 3 AS level, text, {whole('1 + seq / 4')} AS page FROM (
  SELECT concat('d', doc_id) AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq, line AS text,
    CASE (length(line) + pos) % 8 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 2 THEN 'footnote' WHEN 3 THEN 'quote' ELSE 'paragraph' END AS kind FROM {{lines}})""")
#: Headings of a book: a document's lines, level and page by place, some labels again and again.
HEADS = Derived(f"""
SELECT concat('b', doc_id) AS book, {whole('1 + pos * 1.5')} AS page, pos, 1 + (pos * pos * 7 + doc_id * 3) % 4 AS level,
  CASE WHEN (pos + doc_id) % 3 = 0 THEN concat('H', pos % 2) ELSE concat('H', doc_id % 10, '-', pos + 10) END AS label FROM {{lines}}""")
#: Pages of books in which some lines are headings, and some pages open with a bare title.
PAGES = Derived(f"""
SELECT concat('c', doc_id % 40) AS book, {whole('1 + doc_id / 40')} AS page, pos,
  CASE WHEN pos = 0 AND doc_id % 7 = 3 THEN 'A bare title' WHEN doc_id % 11 = 5 OR (doc_id + pos) % 6 = 0 THEN concat('Chapter ', 1 + pos)
    ELSE concat('Prose that goes on for ', repeat('more and ', 1 + length(line) % 9), 'no more.') END AS line FROM {{lines}}""")
#: Books of whole lines, with headings of chapters and of their sections; some books have none.
BOOKS = Derived(f"""
SELECT book, page, pos, CASE kind WHEN 2 THEN concat('Chapter ', 1 + (page + pos) % 12) WHEN 3 THEN concat(1 + pos % 9, '.', 1 + page % 4, ' Names of places') ELSE line END AS line, kind AS level FROM (
  SELECT concat('k', doc_id % 40) AS book, {whole('1 + doc_id / 40')} AS page, pos, line, CASE WHEN doc_id % 40 = 7 THEN 0 WHEN (doc_id + pos) % 9 = 0 THEN 2 WHEN (doc_id + pos) % 9 = 4 THEN 3 ELSE 0 END AS kind FROM {{lines}})""")
#: Blocks of every kind, whole lines, four to a page.
KINDS = Derived(f"""
SELECT doc, seq, kind, CASE WHEN kind = 'heading' THEN 1 + (seq * seq + length(text)) % 6 ELSE 0 END AS level, text, {whole('1 + seq / 4')} AS page FROM (
  SELECT concat('d', doc_id) AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq, line AS text,
    CASE (length(line) + pos) % 11 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 2 THEN 'footnote' WHEN 3 THEN 'quote' WHEN 4 THEN 'table' WHEN 5 THEN 'figure' WHEN 6 THEN 'formula' WHEN 7 THEN 'heading' ELSE 'paragraph' END AS kind FROM {{lines}})""")
#: Pages of which some are tables of contents.
CONTENTS = Derived("""
SELECT concat('b', doc_id % 20) AS book, doc_id AS page, pos,
  CASE WHEN doc_id % 4 = 0 THEN concat(pos, '. Topic ', pos, ' .... ', pos * 7) WHEN doc_id % 4 = 1 AND pos % 2 = 0 THEN concat('Chapter: the part ', pos, ' and more ', pos * 3) ELSE line END AS line FROM {lines}""")
#: Lines among which page numbers, rules, list items and captions stand.
MARKED = Derived("""
SELECT doc_id, pos, CASE (doc_id * 7 + pos) % 13 WHEN 0 THEN concat('- ', pos + 1, ' -') WHEN 1 THEN '* * * *' WHEN 2 THEN concat(pos + 1, '. item of a list') WHEN 3 THEN concat('Figure ', pos + 1, ': a map')
  WHEN 4 THEN '• a thing' WHEN 5 THEN 'xiv' WHEN 6 THEN concat(pos + 1, ' / 12') WHEN 7 THEN concat('שרטוט ', pos + 1, ' - קו') ELSE line END AS line FROM {lines}""")
#: Lines of which some are headings of several kinds.
TITLED = Derived("""
SELECT doc_id, pos, CASE (doc_id + pos) % 7 WHEN 0 THEN concat('Chapter ', 1 + pos) WHEN 1 THEN concat('Part ', pos % 3, ' of all') WHEN 2 THEN 'THE LAND' WHEN 3 THEN concat(1 + pos % 9, '.', 1 + pos % 4, ' Names') WHEN 4 THEN 'The Art of War' ELSE line END AS line FROM {lines}""")
#: Tokens that are numbers of several writings, and their values; words among them.
NUMERALS = Derived(f"""
SELECT id, CASE kind WHEN 0 THEN concat('', n) WHEN 1 THEN concat(n, '.') WHEN 2 THEN concat(repeat('X', CAST(tens AS INT)), CASE ones WHEN 0 THEN '' WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' ELSE 'IX' END, ':')
  WHEN 3 THEN concat(substr('יכלמנסעפצ', CAST(1 + tens AS INT), 1), '"', substr('אבגדהוזחט', CAST(1 + ones % 9 AS INT), 1)) WHEN 4 THEN concat(substr('אבגדהוזחט', CAST(1 + ones % 9 AS INT), 1), chr(39)) WHEN 5 THEN CASE n % 3 WHEN 0 THEN 'Third' WHEN 1 THEN 'one' ELSE 'שלישי' END ELSE concat('word', ones) END AS token,
  CASE kind WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN 10 * (tens + 1) + 1 + ones % 9 WHEN 4 THEN 1 + ones % 9 WHEN 5 THEN CASE n % 3 WHEN 1 THEN 1 ELSE 3 END END AS value
FROM (SELECT *, {whole('n / 10')} AS tens, n % 10 AS ones FROM (SELECT doc_id * 1000 + pos AS id, (doc_id + pos) % 7 AS kind, 1 + (doc_id * 7 + length(line)) % 39 AS n FROM {{lines}}))""")
#: Propositions, some of which are none.
PROPOSITIONS = Derived("""
SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'p and q' WHEN 1 THEN 'not p or q' WHEN 2 THEN 'p → q → r' WHEN 3 THEN '(p xor q) iff r' WHEN 4 THEN 'p or not p' ELSE 'p q' END AS text FROM {events}""")
#: A table for each document: its lines and their lengths.
GRIDS = Derived("SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN concat(line, '|x') WHEN 1 THEN concat(line, chr(10), 'y') ELSE line END AS cell, concat('', length(line)) AS size FROM {lines}")
DIRECTIONS = Derived("""
SELECT concat('b', doc_id % 30) AS book, doc_id AS page, CASE doc_id % 3 WHEN 0 THEN 'הוא אשר על כל זה' WHEN 1 THEN reverse('לא את של גם כי אשר על') ELSE substr(text, 1, 60) END AS text FROM {documents}""")
#: Lines of which some end in a hyphen or begin small.
BROKEN = Derived("""
SELECT doc_id AS id, pos AS n, CASE pos % 4 WHEN 0 THEN concat(substr(lower(line), 1, 20), ' consid-') WHEN 1 THEN concat('eration of ', substr(line, 1, 12)) WHEN 2 THEN 'ple-' ELSE substr(line, 1, 30) END AS line FROM {lines}""")
#: Words of letters that count: digits as the letters of their place.
LETTERS = Derived("SELECT doc_id AS id, translate(concat('', doc_id * 7919), '0123456789', 'ךאבגדהםמצת') AS word FROM {documents}")
#: Numbers as learners write them.
NUMBERS = Derived("""
SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN concat('', event_id) WHEN 1 THEN concat(' ', event_id, '.5 ') WHEN 2 THEN concat(event_id % 90, ',5') WHEN 3 THEN concat(1 + event_id % 9, ',', 100 + event_id % 800)
  WHEN 4 THEN concat(event_id % 7, '/', event_id % 5) WHEN 5 THEN concat('−', event_id) WHEN 6 THEN concat('"', event_id, '"') WHEN 7 THEN 'abc' ELSE concat(event_id, '.1.2') END AS s FROM {events}""")
#: Expressions with their operands.
EXPRESSIONS = Derived("""
SELECT event_id AS id, event_id % 7 AS a, event_id % 5 AS b, event_id % 3 AS c, CASE event_id % 6 WHEN 0 THEN concat(event_id % 7, ' + ', event_id % 5, ' * ', event_id % 3) WHEN 1 THEN concat('(', event_id % 7, ' - ', event_id % 5, ') ^ 2')
  WHEN 2 THEN concat(event_id % 7, ' / ', event_id % 3) WHEN 3 THEN concat('-', event_id % 5, ' ^ 2 + sqrt(16)') WHEN 4 THEN concat('abs(', event_id % 5, ' - ', event_id % 7, ') % 4') ELSE 'x + 1' END AS text FROM {events}""")
SAMPLE = Derived("SELECT concat('o', o_custkey % 40) AS g, CAST(o_totalprice AS DOUBLE) AS v FROM {orders}")
#: Triangles and quadratics.
SIDES = Derived("SELECT event_id AS id, CAST(3 + event_id % 7 AS DOUBLE) AS a, CAST(4 + event_id % 5 AS DOUBLE) AS b, CAST(2 + event_id % 11 AS DOUBLE) AS c FROM {events}")
QUADRATICS = Derived("SELECT event_id AS id, CAST(1 + event_id % 3 AS DOUBLE) AS a, CAST(event_id % 9 - 8 AS DOUBLE) AS b, CAST(-(event_id % 5) AS DOUBLE) AS c FROM {events}")
SEARCHES = Derived("SELECT doc_id AS id, 1 + doc_id % 40 AS size, doc_id % (1 + doc_id % 40) AS target FROM {documents}")
CROSSES = Derived("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'Aa' WHEN 1 THEN 'AA' ELSE 'aa' END AS mother, CASE doc_id % 4 WHEN 0 THEN 'aa' WHEN 1 THEN 'AA' ELSE 'Aa' END AS father FROM {documents}")

SUBSCRIPTIONS = Derived(f"""
SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'basic' WHEN 1 THEN 'pro' WHEN 2 THEN 'max' WHEN 3 THEN 'other' END AS plan, CASE {whole('user_id / 5')} % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'cancelled' END AS status,
  user_id % 41 - 20 AS days, user_id % 3 <> 0 AS confirmed FROM (SELECT DISTINCT user_id FROM {{events}})""")
CAPS = Derived("SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'many' WHEN 1 THEN CAST(NULL AS STRING) ELSE concat('', event_id * 37 % 6000) END AS max_tokens FROM {events}")
CONTENT = Derived("""
SELECT conv_id * 1000 + turn AS id, CASE (conv_id + turn) % 8 WHEN 0 THEN concat('"t', turn, '"') WHEN 1 THEN concat('["a', turn, '", "{{b"]') WHEN 2 THEN concat('[{{"type": "text", "text": "x', conv_id, '"}}, "u"]') WHEN 3 THEN '[{{"type": "image", "source": "s"}}]'
  WHEN 4 THEN '[]' WHEN 5 THEN '7' WHEN 6 THEN concat('["', repeat('a", "', conv_id % 9), 'z"]') ELSE 'not json' END AS content FROM {conversations}""")
REQUESTS = Derived("""
SELECT conv_id, turn, CASE conv_id % 9 WHEN 0 THEN 'path' WHEN 1 THEN 'lesson' WHEN 2 THEN 'tutor' WHEN 3 THEN 'feedback' WHEN 4 THEN 'primer' WHEN 5 THEN 'worksheet' WHEN 6 THEN 'mine' END AS task,
  CASE WHEN (conv_id + turn) % 23 = 0 THEN '[]' ELSE concat('"t', turn, '"') END AS content FROM {conversations}""")
PROMPTS = Derived("""
SELECT conv_id * 1000 + turn AS id, CASE turn % 3 WHEN 0 THEN concat('Plan. Identify exactly ', conv_id % 9, ' core concepts. Identify 3 core concepts.') WHEN 1 THEN concat('identify ', conv_id % 7, ' - 6 core concepts now') ELSE concat('Nothing to see in ', conv_id) END AS text FROM {conversations}""")
USAGE = Derived("""
SELECT user_id AS stream_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN event_id % 700 END AS input, CASE WHEN event_id % 2 = 0 THEN event_id % 900 END AS output, CASE WHEN event_id % 7 = 0 THEN event_id % 5000 END AS cache_write, CASE WHEN event_id % 5 = 0 THEN event_id % 90 END AS cache_read FROM {events}""")
#: The frames of an event stream, each cut in two chunks.
SSE = Derived("""
SELECT conv_id AS stream_id, turn * 2 + half AS seq, CASE WHEN half = 1 THEN concat('": ', turn, '}}', chr(10), chr(10), CASE WHEN turn % 4 = 3 THEN concat('data: [DONE]', chr(10), chr(10)) ELSE '' END)
  ELSE concat(CASE WHEN turn % 3 = 1 THEN concat(': comment', chr(10), chr(10)) ELSE '' END, CASE WHEN turn % 5 = 2 THEN 'data: cut' ELSE 'data: {{"k' END) END AS chunk
FROM {conversations} CROSS JOIN (SELECT 0 AS half UNION ALL SELECT 1 AS half)""")
#: A plan that a model writes, a chunk for each turn; the first concept closes in the second chunk.
PLAN_CHUNKS = Derived("""
SELECT conv_id AS stream_id, turn AS seq, CASE turn WHEN 0 THEN concat('{{"title": "a ', chr(92), 'u007b title", "language": "L', conv_id, '", "goals": [{{"x": 1}}], "concepts": [{{"name": "', said, '", "descr') WHEN 1 THEN concat('iption": "', said, '", "parts": [1, {{"a": "}}]"}}]}}, {{"name": "B"')
  ELSE concat(', "more": "', said, '"') END AS chunk FROM (SELECT conv_id, turn, translate(text, concat('"', chr(92), chr(10), chr(13), chr(9)), '') AS said FROM {conversations})""")
#: A model's answer as event frames, one or two for each turn; it ends with the fourth, or breaks before.
ANSWER_CHUNKS = Derived("""
SELECT conv_id AS stream_id, turn AS seq, concat(CASE WHEN turn > 0 THEN concat(chr(10), chr(10)) ELSE '' END, CASE turn WHEN 0 THEN concat('data: {{"type": "message_start", "message": {{"usage": {{"input_tokens": ', 100 + conv_id, ', "output_tokens": 1}}}}}}')
  WHEN 3 THEN concat('data: {{"type": "message_delta", "usage": {{"output_tokens": ', 40 + length(text), '}}}}', chr(10), chr(10), 'data: {{"type": "message_stop"}}', chr(10), chr(10)) ELSE concat('data: {{"type": "message_delta", "usage": {{"output_tokens": ', 10 * turn + length(text), '}}}}') END) AS chunk FROM {conversations}""")
#: Calls for courses and lessons, under plans of several sizes; some users are on trial.
CALLS = Derived("""
SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN 'course' ELSE 'lesson' END AS kind, user_id % 6 = 0 AS trial, CASE WHEN user_id % 6 = 0 THEN 1 ELSE 1 + user_id % 3 END AS courses, 2 + user_id % 2 AS lessons FROM {events}""")
#: Figures as a model gives them, many of which cannot be drawn.
FIGURE_SPECS = Derived("""
SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN concat('{{"type": "flow", "steps": ["a"', CASE WHEN event_id % 2 = 0 THEN ', "b"' ELSE '' END, ']}}') WHEN 1 THEN concat('{{"type": "bar", "bars": [{{"label": "x", "value": ', CASE WHEN event_id % 4 = 1 THEN '"much"' ELSE concat('', event_id) END, '}}]}}')
  WHEN 2 THEN '{{"type": "sculpture"}}' WHEN 3 THEN concat('{{"type": "group", "items": [{{"type": "', CASE WHEN event_id % 2 = 0 THEN 'flow' ELSE 'group' END, '", "steps": ["a", "b"]}}]}}') WHEN 4 THEN '{{"type": "bar", "bars": "none"}}' WHEN 5 THEN 'no json' WHEN 6 THEN '[1]'
  WHEN 7 THEN concat('{{"type": "timeline", "events": [{{"label": "a", "year": ', 1900 + event_id % 90, '}}, {{"label": "b"', CASE WHEN event_id % 2 = 0 THEN ', "year": 2000' ELSE '' END, '}}]}}') ELSE concat('{{"type": "slider", "min": ', event_id % 5, ', "max": 3, "outputs": [{{"label": "y", "expr": "', CASE WHEN event_id % 7 = 0 THEN 'window.location' ELSE 'x * 2' END, '"}}]}}') END AS spec FROM {events}""")
#: Questions as a model writes them, with an answer to each; some cannot be asked (their type is empty here).
QUESTIONS = Derived("""
SELECT id, answer, CASE kind WHEN 0 THEN 'choice' WHEN 1 THEN 'numeric' WHEN 2 THEN CASE WHEN id % 5 < 3 THEN 'hotspot' ELSE '' END ELSE '' END AS type, CASE kind
  WHEN 0 THEN concat('{{"text": "q", "options": ["a", "b"', repeat(', "c"', CAST(id % 3 AS INT)), '], "correct": ', id % 2, ', "whyWrong": ', CASE WHEN id % 4 = 0 THEN '["w"]' ELSE '"no"' END, ', "visual": {{"type": "nonsense"}}}}')
  WHEN 1 THEN concat('{{"type": "numeric", "text": "q", "answer": ', id % 9, ', "tolerance": -', id % 3, '}}') WHEN 2 THEN concat('{{"type": "hotspot", "text": "q", "target": "side:', id % 5, '", "visual": {{"type": "shape", "shape": "triangle"}}}}')
  WHEN 3 THEN '{{"type": "numeric", "text": "q", "answer": "six"}}' ELSE '{{"type": "choice", "text": "q"' END AS spec FROM (SELECT event_id AS id, event_id % 11 % 5 AS kind, concat('', event_id % 7) AS answer FROM {events})""")
LESSONS = Derived("""
SELECT conv_id * 1000 + turn AS id, CASE turn % 4 WHEN 0 THEN concat('{{"hook": {{"text": "h', conv_id, '"}}, "cards": [{{"idea": "c"}}], "prediction": {{"question": "p', turn, '"}}, "quiz": [1]}}') WHEN 1 THEN concat('{{"cards": [1, 2], "explore": {{"insight": [', conv_id, ']}}}}') WHEN 2 THEN '[1, 2]' ELSE '{{"hook": ' END AS lesson FROM {conversations}""")
BUNDLES = Derived("""
SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'no json' ELSE concat('{{"schema": "', CASE WHEN doc_id % 7 = 0 THEN 'other/1' ELSE 'foliant/1' END, '", "kind": "bundle", "markdown": "', repeat('word ', doc_id % 9),
  '", "manifest": {{"outline": [{{"title": "Part ', doc_id, '", "level": 1, "page_start": 1, "page_end": 5, "children": [{{"title": "One", "level": 2, "page_start": 1, "page_end": 2, "children": [{{"title": "Sub", "level": 3, "page_start": 2, "page_end": 2}}]}}, {{"title": "Two", "level": 2, "page_start": 3, "page_end": 5}}]}}, {{"title": "End ',
  doc_id, '", "level": 1, "page_start": 5, "page_end": 5}}]}}}}') END AS raw FROM {documents}""")
RANGES = Derived("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN concat('', event_id % 90) WHEN 1 THEN concat(event_id % 90, '-', event_id % 90 + 7) WHEN 2 THEN concat(event_id % 90, '-') ELSE '' END AS value FROM {events}")
PACKS = Derived("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'heb+eng' WHEN 1 THEN 'fra' ELSE 'heb+fra+eng' END AS wanted, CASE doc_id % 4 WHEN 0 THEN 'eng,osd' WHEN 1 THEN 'heb,osd' WHEN 2 THEN 'eng,heb' ELSE 'fra,heb' END AS installed FROM {documents}")
ANSWERS = Derived("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN concat(event_id % 9, ',5') WHEN 1 THEN concat('', event_id % 13) WHEN 2 THEN '1/3' ELSE 'abc' END AS answer, CAST(event_id % 7 AS DOUBLE) AS target, CAST(event_id % 5 - 2 AS DOUBLE) AS tolerance FROM {events}")
GUARDS = Derived("SELECT event_id AS id, event_id % 2 = 0 AS e, event_id % 3 = 0 AS h, event_id % 5 <> 0 AS o, event_id % 7 <> 0 AS s, CASE WHEN event_id % 4 <> 0 THEN event_id % 6 END AS n FROM {events}")
MARKUP = Derived("SELECT conv_id * 1000 + turn AS id, concat(text, ' <b>', chr(39), 'q', chr(39), '</b> & \"z\"') AS t FROM {conversations}")
#: Lessons that are still being written.
PARTIAL = Derived("SELECT conv_id * 1000 + turn AS id, substr('{{\"hook\": \"x\", \"explore\": 1, \"cards\": [2], \"practice\": 3, \"quiz\": [4], \"summary\": \"z\"}}', 1, CAST((conv_id * 7 + turn * 5) % 90 AS INT)) AS t FROM {conversations}")
#: Text runs of a page, their baselines slightly apart; spans of lines; words of a recogniser.
RUNS = Derived(f"SELECT doc_id AS page, concat('r', pos) AS str, CAST(20 + length(line) % 9 AS DOUBLE) AS width, CAST((pos % 5) * 28 AS DOUBLE) AS x, CAST(700 - 12 * floor(pos / 5) + 0.25 * (pos % 5) AS DOUBLE) AS y FROM {{lines}}")
SIZED = Derived(f"SELECT doc_id AS page, {whole('pos / 3')} AS line, pos AS seq, substr(line, 1, CAST(1 + pos % 7 AS INT)) AS text, CAST(CASE pos % 4 WHEN 0 THEN 14 WHEN 1 THEN 11 ELSE 12 END AS DOUBLE) AS size, pos % 2 = 0 AS bold FROM {{lines}}")
OCR = Derived(f"SELECT doc_id AS page, {whole('pos / 8')} AS block, {whole('pos / 4')} AS par, {whole('pos / 2')} AS line, concat('w', pos) AS text, CAST((pos * 17) % 300 AS DOUBLE) AS x0, CAST((pos * 17) % 300 + 20 AS DOUBLE) AS x1, CAST(pos % 6 * 20 - 15 AS DOUBLE) AS conf FROM {{lines}}")
