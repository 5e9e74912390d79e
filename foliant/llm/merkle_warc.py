"""Fixity audit of WARC replicas by Merkle trees.

A replica keeps its records in the order of their SHA-256, as content-addressed stores do; so both replicas cut their
archives into the same ranges without asking each other.  The digest's leading bits say where a record stands: the first
few are its file (of at most about RECORDS records), the next ones the branches inside the file.  Each replica's tree is
built on its own and written level by level: the lowest nodes cover a few records, every other one up to 2^BITS nodes.
A node's digest covers, for each child in order, its range of offsets from the node's start and its digest.  An audit
compares the roots and goes down: at each level only the children of nodes that differed are read and compared, and only
the records of the lowest nodes that differ are held against each other.  Changed, missing and extra records all come out
of the descent.  No key gathers rows: equal rows are counted before they move, and other records spread by their digest.

Edge cases: null identifiers, addresses and bodies count as empty in the record, and are kept apart as nulls; rows that
repeat in full are one record with a copy count, which its digest covers; several records of one identifier and address
that differ are paired by their digests' order; replicas without records have no root and no differences, and against an
empty replica every record is missing or extra; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Records of a file at most, about; bits of the digest for each level (2^BITS children).
RECORDS, BITS = 1024, 4
#: Bits of a digest that place a record.
PLACE = 60
CRLF = "\r\n"


def record(page_id, url, body):
    """The record's text: header lines, a blank line, the body and two line ends."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), empty(page_id), F.lit(f">{CRLF}WARC-Target-URI: "), empty(url),
        F.lit(f"{CRLF}Content-Length: "), F.octet_length(empty(body)).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(head, empty(body), F.lit(CRLF * 2))


def leaves(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, length, digest (binary), place: a row for each distinct record; only digests are shuffled."""
    text = record(F.col(key), F.col(url), F.col(body))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.octet_length(text).cast("long").alias("length"), F.unhex(F.sha2(text, 256)).alias("_sha"))
    rows = rows.groupBy("page_id", "url", "length", "_sha").agg(F.count("*").alias("_copies"))
    several = F.unhex(F.sha2(F.concat(F.hex("_sha"), F.lit("x"), F.col("_copies").cast("string")), 256))
    digest = F.when(F.col("_copies") == 1, F.col("_sha")).otherwise(several)
    place = F.conv(F.left(F.hex(digest), F.lit(PLACE // 4)), 16, 10).cast("long")
    return rows.select("page_id", "url", "length", digest.alias("digest"), place.alias("place"))


def prefix(bits: int, of: int = PLACE, col: str = "place"):
    """The first `bits` of the `of` bits of `col`."""
    return F.shiftright(col, of - bits)


def covered(nodes: DataFrame, above, col: str) -> DataFrame:
    """The nodes above: node, length, digest.  A few rows fall to one; each has length, digest and its place `col`."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(col).alias("at"), "digest", "length")))
    before = lambda p, k: F.aggregate(F.slice(p, 1, k), F.lit(0).cast("long"), lambda n, c: n + c["length"])
    grouped = nodes.groupBy(above.alias("node")).agg(parts.alias("_p"), F.sum("length").alias("length"))
    said = F.transform("_p", lambda c, k: F.concat_ws(" ", c["at"].cast("string"), before(F.col("_p"), k).cast("string"), c["length"].cast("string"), F.hex(c["digest"])))
    return grouped.select("node", "length", F.unhex(F.sha2(F.concat_ws("\n", said), 256)).alias("digest"))


def tree(records: DataFrame, depth: int) -> list[DataFrame]:
    """The levels of a replica's tree, the root's first, each written before the next is built on it."""
    levels = [cut(covered(records, prefix(BITS * depth), "place"))]
    for _ in range(depth):
        levels.append(cut(covered(levels[-1], F.shiftright("node", BITS), "node")))
    return levels[::-1]


def depths(records: int) -> tuple[int, int]:
    """Levels from the root down to the files, and down to the lowest nodes."""
    files = max(0, math.ceil(math.log2(max(1, records / RECORDS)) / BITS))
    return files, files + max(1, math.ceil(math.log2(max(2, RECORDS // 4)) / BITS))


def descend(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame | None:
    """The lowest nodes on which the trees differ, None if the roots are equal."""
    differ = None
    for a, b in zip(ours, theirs, strict=True):
        if differ is not None:
            a, b = (x.join(differ, F.shiftright(x["node"], BITS) == differ["_above"], "left_semi") for x in (a, b))
        pair = a.select("node", F.col("digest").alias("_a")).join(b.select("node", F.col("digest").alias("_b")), "node", "full")
        differ = cut(pair.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.col("node").alias("_above")))
        if differ.isEmpty():
            return None
    return differ


def located(records: DataFrame, lowest: DataFrame, depth: int, files: int) -> DataFrame:
    """The records of the `lowest` nodes, with file, pos (in the file) and offset."""
    whole = lowest.select(F.shiftright("_above", BITS * (depth - files)).alias("_f")).distinct()
    rows = records.withColumn("file", prefix(BITS * files))
    rows = rows.join(whole, rows["file"] == whole["_f"], "left_semi")
    own = Window.partitionBy("file").orderBy("place", "digest", "page_id", "url")  # about RECORDS rows
    rows = rows.withColumn("pos", F.row_number().over(own).cast("long") - 1).withColumn("offset", F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return rows.join(lowest, prefix(BITS * depth) == lowest["_above"], "left_semi")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """kind (changed, missing or extra), file, pos, offset, length, page_id, url, expected, found: a row for each record
    on which the replicas differ; places are those of the first replica, of extra records those of the second.  Both
    frames are those of `leaves`."""
    first, second = cut(first), cut(second)
    files, depth = depths(max(first.count(), second.count()))
    lowest = descend(tree(first, depth), tree(second, depth))
    if lowest is None:
        lowest = first.select(F.col("place").alias("_above")).limit(0)
    same = ["page_id", "url", "length", "digest", "file"]
    ours, theirs = located(first, lowest, depth, files), located(second, lowest, depth, files)
    both = ours.withColumn("_side", F.lit(1)).unionByName(theirs.withColumn("_side", F.lit(2)))
    alone = both.groupBy(*same).agg(F.sum("_side").alias("_side"), F.max("pos").alias("pos"), F.max("offset").alias("offset")).filter("_side < 3")
    nth = F.row_number().over(Window.partitionBy("page_id", "url", "_side").orderBy("digest", "file"))
    one = alone.withColumn("_nth", nth)
    of = lambda side, c: F.max(F.when(F.col("_side") == side, F.col(c)))
    pairs = one.groupBy("page_id", "url", "_nth").agg(*(of(s, c).alias(f"{c}_{s}") for s in (1, 2) for c in ("file", "pos", "offset", "length", "digest")))
    there = F.col("digest_1").isNotNull()
    kind = F.when(there & F.col("digest_2").isNotNull(), "changed").when(there, "missing").otherwise("extra")
    place = (F.when(there, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(c) for c in ("file", "pos", "offset", "length"))
    return pairs.select(kind.alias("kind"), *place, "page_id", "url", F.lower(F.hex("digest_1")).alias("expected"), F.lower(F.hex("digest_2")).alias("found"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage, by crc32 of the identifier modulo 97: 0 changed, 1 lost, 2 a further record."""
    fate = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")) % 97
    pages = pages.select("page_id", "url", "html").withColumn("_fate", fate)
    half = F.floor(F.char_length("html") / 2).cast("int")
    changed = F.when(F.col("_fate") == 0, F.concat(F.left("html", half), F.lit("#"), F.substring("html", half + 2, F.char_length("html")))).otherwise(F.col("html"))
    kept = pages.filter("_fate <> 1").withColumn("html", changed)
    more = pages.filter("_fate = 2").withColumn("url", F.concat("url", F.lit("#copy")))
    return kept.unionByName(more).drop("_fate")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all pages against a replica with known damage."""
    pages = table(spark, sf_dir, "pages")
    out = audit(leaves(pages), leaves(damaged(pages)))
    return out.select("kind", "file", "pos", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), "page_id", "url", "expected", "found")
