"""Text as columns: lines, words, fingerprints, and the tests that a line can pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that retrieval leaves out
STOPWORDS = (
    "the and for are but not you all can her was one our out has have with this that from they been will would their when which "
    "there what about into than then them these של את על עם לא כל זה זו אשר אבל גם היא הוא הם הן כי אם או יש אין"
).split()
# fixed values: words of a text that runs from right to left
MARKERS = "של את על לא זה הוא היא אשר כי עם אין יש כל גם או אם בין לפי אל כדי לאחר בית".split()
# fixed values: how a page number, a contents row, a rule and a list item look
PAGE_NUMBER = r"^([-–—\[\(\s]*[0-9]{1,4}[-–—\]\)\s]*|m{0,3}(c[md]|d?c{0,3})(x[cl]|l?x{0,3})(i[xv]|v?i{0,3})|(עמ['׳]?|עמוד|page|p\.)\s*[0-9]{1,4}|[0-9]{1,4}\s*(/|מתוך|of)\s*[0-9]{1,4})$"
TOC_ROW = r"[.·․…]\s?[.·․…]\s?[.·․…]\s?[.·․…]|^(פרק|שער|חלק|נספח|סעיף|יחידה|chapter|part|section|appendix|unit)([^\p{L}\p{N}_].{0,79}?)?\s[0-9]{1,4}\s*$"
DECORATION = r"^[-–—_=*~.·•\s]*([-–—_=*~.·•]\s*){3,}$"
BULLET = r"^([•▪◦‣∙·●○*\-–—])\s*(\S.*)$"
NUMBERED = r"^(\(?([0-9]{1,3}|[ivxlcdm]{1,5}|[a-z]|[א-ת])[.)\]]|[0-9]{1,3}\.[0-9]{1,2}\)?)\s+(\S.*)$"
BULLET_RTL = r"^(\S.*?)\s*([•▪◦‣∙●○])$"
# fixed values: the words that a caption starts with
CAPTION_WORDS = ("איור", "תרשים", "תמונה", "טבלה", "לוח", "גרף", "שרטוט", "תרשים זרימה", "figure", "fig", "table", "chart", "diagram", "image", "exhibit", "plate")
# fixed values: a caption's number and what parts it from its text
CAPTION = rf"^({'|'.join(CAPTION_WORDS)})\s*\.?\s*([0-9א-ת]{{1,4}}(\.[0-9]{{1,2}})?)?\s*[:.\-–—)]?\s+\S"
LTR_RUN = r"[0-9A-Za-z][0-9A-Za-z.,:/\\-]*"
RTL_LETTER = r"[\x{0590}-\x{05ff}\x{0600}-\x{06ff}]"
# fixed values: a word, and a sentence's end
WORD_SPLIT = r"[^\p{L}\p{N}_]+"
SENTENCE = r"[^.!?。！？׃]+[.!?。！？׃]+|\S+$"
SENTENCE_KEEP_TAIL = r"[^.!?。！？׃]+[.!?。！？׃]+|[^.!?。！？׃]+$"


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line that isn't empty: all columns but the text, pos (from 0), line (trimmed)."""
    rest = [c for c in docs.columns if c not in (doc, text)]
    rows = docs.select(doc, *rest, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return rows.withColumn("pos", F.col("pos").cast("long")).withColumn("line", F.trim("line")).filter(F.col("line") != "")


def words(text: Column, stop: bool = True) -> Column:
    """Lower-case words of more than two characters, without stop words."""
    keep = lambda w: (F.char_length(w) > 2) & (~w.isin(STOPWORDS) if stop else F.lit(True))
    return F.filter(F.split(F.lower(text), WORD_SPLIT), keep)


def line_fingerprint(line: Column) -> Column:
    """Trimmed, lower case, each run of digits as one #."""
    return F.regexp_replace(F.lower(F.trim(line)), r"[0-9]+", "#")


def is_page_number(line: Column) -> Column:
    return line.rlike("(?iu)" + PAGE_NUMBER) & (line != "")


def is_contents_row(line: Column) -> Column:
    return line.rlike("(?iu)" + TOC_ROW)


def is_decoration(line: Column) -> Column:
    return line.rlike(DECORATION)


def is_list_item(line: Column) -> Column:
    return line.rlike(BULLET) | line.rlike(NUMBERED) | line.rlike(BULLET_RTL)


def is_caption(line: Column) -> Column:
    return F.trim(line).rlike("(?iu)" + CAPTION)


def rtl_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(RTL_LETTER)).cast("long")


def latin_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]")).cast("long")


def flip(line: Column) -> Column:
    """A line reversed, with its left-to-right runs the right way round; doing it twice gives the line back."""
    pieces = F.regexp_extract_all(F.reverse(line), F.lit(rf"(?s)({LTR_RUN_BACK}|.)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9A-Za-z.,:/\\\\-]+$") & (F.char_length(p) > 1), F.reverse(p)).otherwise(p)), "")


#: A left-to-right run as it stands in a reversed line.
LTR_RUN_BACK = r"[0-9A-Za-z.,:/\\-]*[0-9A-Za-z]"


def marker_hits(text: Column) -> Column:
    """How many different marker words a text has."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\x{0590}-\x{05ff}]+)"), F.lit(1)))
    return F.size(F.array_intersect(found, F.array(*map(F.lit, MARKERS)))).cast("long")




def join_hyphens(items: Column) -> Column:
    """An array of lines with words healed that a hyphen cut at a line's end.

    A line that ends in two or more Latin letters and a hyphen takes the first word of a following line that starts
    with a small Latin letter; the rest of that line, if any, may give on in the same way.
    """
    empty = F.array().cast("array<string>")

    def step(kept, line):
        last = F.try_element_at(kept, F.lit(-1))
        heals = F.coalesce(last.rlike(r"[A-Za-zÀ-ɏ]{2,}-$") & line.rlike(r"^[a-zß-ÿ]"), F.lit(False))
        word, rest = F.regexp_extract(line, r"^(\S+)\s*", 1), F.regexp_replace(line, r"^\S+\s*", "")
        healed = F.concat(F.substring(last, F.lit(1), F.char_length(last) - 1), word)
        head = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(heals, F.concat(head, F.array(healed), F.when(rest != "", F.array(rest)).otherwise(empty))).otherwise(F.concat(kept, F.array(line)))

    return F.aggregate(items, empty, step)


def clean(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r ]{2,}|[\t\n\x0B\f\r]", " "))  # single spaces stay as they are


def let(value: Column, body) -> Column:
    """`body(value)` with the value worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack_sentences(text: Column, size: int = 1200, overlap: int = 150, least: int = 200, keep_tail: bool = True) -> Column:
    """Chunks of whole sentences up to `size` characters; a chunk starts with the end of the one before it.

    A chunk is closed when the next sentence would pass the size and it has more than `least` characters.  The overlap
    is what follows the first sentence end within its last `overlap` characters.  keep_tail=False drops all but the
    last bare word of text after the last sentence end.  A row's fold is a small function in Python: as an expression it
    is interpreted for every sentence.
    """
    # as Java has them: $ also before a line end that ends the text, white space of ASCII alone
    sentence = re.compile((SENTENCE_KEEP_TAIL if keep_tail else SENTENCE).replace("$", r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"), re.ASCII)
    opening = re.compile(r"[.!?。！？׃]\s", re.ASCII)

    def packed(whole: str | None) -> list[str] | None:
        if whole is None:
            return None
        if len(whole) <= size:
            return [whole.strip(" ")]
        sentences = sentence.findall(whole)
        joined, done, start, end = "".join(sentences), [], 0, 0
        for n in map(len, sentences):
            if end - start + n > size and end - start > least:
                done.append(joined[start:end])
                tail = joined[max(end - overlap, start) : end]
                found = opening.search(tail)
                start = end - (len(tail) - found.end() if found else 0)
            end += n
        return [c for c in (x.strip(" ") for x in (*done, joined[start:end])) if c]

    return F.udf(packed, "array<string>", useArrow=False)(text)
