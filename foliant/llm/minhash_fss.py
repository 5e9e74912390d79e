"""Near-duplicates on word shingles: fast similarity sketches, banding, exact verification, components.

1. One pass shingles every whole text, and sketches the set (SIZE coordinates, `fast_sketch.sketches`).  Documents with
   equal sets are one class from here on, its least identifier stands for it; so exact copies cost nothing more.
2. BANDS bands of ROWS coordinates each give a bucket key.  A pair with a similarity of 0.75 shares no bucket with a
   probability of (1 - 0.75^4)^40 = 2.5e-7, and less the more similar it is.
3. In every bucket each member is held against one member, the pivot (chosen by the key, so that pivots differ between
   bands): rows in proportion to members, whatever the size of a bucket.  Pairs whose sketches agree on at least AGREE
   of the coordinates (at a similarity of 0.75 all but one in a million) are confirmed on full sets, and links are
   joined to components.
4. Buckets that still hold several components, and more than the pair just tested, are searched whole: members are
   dealt out in blocks of about BLOCK, and every pair of blocks meets in one task: first with their sketches (step 3's
   test), then, those that resemble a member of another component, with 24-bit codes of all their shingles.  Codes can
   only overstate a similarity, so nothing is lost by them; one pair for two components goes on to the confirmation on full sets.  Should one fail there, all pairs are
   taken.  Pairs within a component need no test, as they cannot change it.
No bucket and no number of partners is capped.

Edge cases: null texts and texts without words are empty, with no shingle and no link, and stay; texts of fewer words
than a shingle are one shingle; a null doc_id is never linked and stays; rows that repeat an identifier are one
document for the links; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, table
from .components import components
from .fast_sketch import band_keys, set_digest, shingle_set, sketches

SIZE, ROWS, BANDS = 256, 4, 40
BLOCK = 1024
AGREE = 0.60
#: Shingles, and texts, that are sketched at once.
FLAT, TEXTS = 1_000_000, 2048
#: Members of one pivot that meet in a task when links are confirmed.
MEMBERS = 512


def sketched(df: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, digest, keys (an array of bucket keys), sketch (a byte of each coordinate)."""

    def flush(ids, sets):
        full = [s for s in sets if len(s)]
        out = sketches(full, SIZE)
        keys = band_keys(out[:, : ROWS * BANDS], ROWS).astype(np.int64)
        small = (out & np.uint64(255)).astype(np.uint8)
        where = np.cumsum([len(s) > 0 for s in sets]) - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([keys[w] if len(s) else [] for s, w in zip(sets, where, strict=True)], pa.list_(pa.int64())),
                pa.array([small[w].tobytes() if len(s) else None for s, w in zip(sets, where, strict=True)], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "digest", "keys", "sketch"],
        )

    def run(batches):
        ids, sets, flat = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                sets.append(shingle_set(t, words))
                flat += len(sets[-1])
                if flat >= FLAT or len(ids) >= TEXTS:
                    yield flush(ids, sets)
                    ids, sets, flat = [], [], 0
        if ids:
            yield flush(ids, sets)

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_v"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary")


#: Bits of the filter of wanted documents, whatever their number (two megabytes).
FILTER_BITS = 1 << 24


def shingles_of(docs: DataFrame, wanted: DataFrame, words: int, key: str, text: str, code: bool = False) -> DataFrame:
    """_id, _set for the documents of `wanted` (_id): 64-bit hashes, or with `code` their 24-bit codes.

    A Bloom filter of fixed size keeps almost all other texts from being shingled, and all texts from being shuffled.
    """
    bit = F.pmod(F.xxhash64("_id"), F.lit(FILTER_BITS))
    words_of = wanted.groupBy(F.shiftright(bit, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("m"))
    marks = np.zeros(FILTER_BITS // 32, np.uint32)
    for w, m in words_of.collect():  # at most one row for each word of the filter
        marks[w] = m
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_v")).filter("_id is not null")

    def run(batches):
        marks = shared.value
        for b in batches:
            bits = b.column(1).to_numpy()
            b = b.filter(pa.array((marks[bits >> 5] >> (bits & 31).astype(np.uint32) & 1).astype(bool)))
            sets = [shingle_set(t, words) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codes(x) if code else x.tobytes() for x in sets], pa.binary())], names=["_id", "_set"])

    found = rows.select("_id", bit.alias("_bit"), "_v").mapInArrow(run, "_id long, _set binary")
    return cut(found.join(wanted, "_id", "left_semi"))


def codes(shingles: np.ndarray) -> bytes:
    """The upper 24 bits of each hash, three bytes each."""
    return (shingles >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def decoded(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(packed, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, least: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= least * union.

    Only texts of candidates are shingled again.  Pairs are dealt out by (b, block of its members): the set of b comes
    first in each block and stays in memory while the members stream past.
    """
    n = max(2, partitions(docs.sparkSession))
    wanted = pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct()
    sets = shingles_of(docs, wanted, words, key, text)
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_blocks"))
    # few pivots have more than a block, so that pairs need not meet by pivot to learn it
    members = pairs.join(blocks.filter("_blocks > 1"), "b", "left")
    members = members.withColumn("_block", F.coalesce(F.pmod(F.xxhash64("a"), F.col("_blocks")), F.lit(0)).cast("int"))
    members = members.join(sets.withColumnRenamed("_id", "a"), "a").select("b", "_block", "a", "_set")
    heads = blocks.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).join(sets.withColumnRenamed("_id", "b"), "b")
    heads = heads.select("b", "_block", F.lit(None).cast("long").alias("a"), "_set")

    def test(batches):
        at, own = None, []
        for batch in batches:
            left, right, part = [], [], batch.to_pydict()
            for b, block, a, s in zip(part["b"], part["_block"], part["a"], part["_set"], strict=True):
                if (b, block) != at:
                    at, own = (b, block), []
                values = np.frombuffer(s, np.uint64)
                if a is None:
                    own.append(values)
                    continue
                for o in own:
                    if 100 * min(len(o), len(values)) < least * max(len(o), len(values)):
                        continue
                    found = np.searchsorted(o, values)
                    common = int((o[np.minimum(found, len(o) - 1)] == values).sum())
                    if 100 * common >= least * (len(o) + len(values) - common):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    dealt = heads.unionByName(members).repartition(n, "b", "_block").sortWithinPartitions("b", "_block", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(test, "a long, b long")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree on at least AGREE of the coordinates."""
    own = classes.select("doc_id", "sketch")
    rows = pairs.join(own.toDF("a", "_a"), "a").join(own.toDF("b", "_b"), "b").select("a", "b", "_a", "_b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIZE) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE * SIZE))

    return rows.mapInArrow(run, "a long, b long").distinct()


def meeting(held: list[tuple], least: int, spanning: bool) -> set[tuple[int, int]]:
    """Likely pairs of different components among rows of (block, doc_id, component, codes); between the blocks where
    there are two, else within the block.  spanning: one pair for two components."""
    own, ids, comps = (np.array([r[k] for r in held]) for k in range(3))
    sets = [decoded(r[3]) for r in held]
    sizes = np.array([len(x) for x in sets])
    flat, starts = np.concatenate(sets), np.cumsum(np.r_[0, sizes[:-1]])
    two = len(np.unique(own)) > 1
    kinds, counts = np.unique(comps, return_counts=True)
    joined = {int(c): int(c) for c in kinds}
    table, out = np.zeros(1 << 24, bool), set()

    def root(c):
        while joined[c] != c:
            c = joined[c]
        return c

    for k in np.flatnonzero(comps != kinds[counts.argmax()]):  # every pair that counts has one outside the largest
        fits = (comps != comps[k]) & (100 * np.minimum(sizes, sizes[k]) >= least * np.maximum(sizes, sizes[k]))
        if two:
            fits &= own != own[k]
        if not fits.any():
            continue
        table[sets[k]] = True
        common = np.add.reduceat(table[flat], starts, dtype=np.int64)
        table[sets[k]] = False
        for j in np.flatnonzero(fits & (100 * common >= least * (sizes + sizes[k] - common))):
            x, y = root(int(comps[k])), root(int(comps[j]))
            if x != y or not spanning:
                out.add((int(max(ids[k], ids[j])), int(min(ids[k], ids[j]))))
                joined[max(x, y)] = min(x, y)
    return out


def alike(held: list[tuple]) -> list[int]:
    """The rows of (block, doc_id, component, sketch) that some row of another component, and of the other block where
    there are two, agrees with on at least AGREE of the coordinates."""
    own, comps = (np.array([r[k] for r in held]) for k in (0, 2))
    sketch = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), SIZE)
    two = len(np.unique(own)) > 1
    kinds, counts = np.unique(comps, return_counts=True)
    found = np.zeros(len(held), bool)
    for k in np.flatnonzero(comps != kinds[counts.argmax()]):  # every pair that counts has one outside the largest
        fits = comps != comps[k]
        if two:
            fits &= own != own[k]
        near = np.flatnonzero(fits)
        near = near[(sketch[near] == sketch[k]).sum(1) >= AGREE * SIZE]
        if len(near):
            found[near] = found[k] = True
    return np.flatnonzero(found).tolist()


def by_pair(rows: DataFrame, what: str, then, kind: str) -> DataFrame:
    """`then` over the rows (_own, doc_id, component, what) of each bucket and pair of blocks (key, _p, _q), one at a time."""
    n = max(2, partitions(rows.sparkSession))

    def run(batches):
        at, held = None, []
        for batch in batches:
            part = batch.to_pydict()
            for r in zip(part["key"], part["_p"], part["_q"], part["_own"], part["doc_id"], part["component"], part[what], strict=True):
                if r[:3] != at:
                    if held:
                        yield then(at, held)
                    at, held = r[:3], []
                held.append(r[3:])
        if held:
            yield then(at, held)

    rows = rows.select("key", "_p", "_q", "_own", "doc_id", "component", what)
    return rows.repartition(n, "key", "_p", "_q").sortWithinPartitions("key", "_p", "_q").mapInArrow(run, kind)


def across(members: DataFrame, classes: DataFrame, docs: DataFrame, words: int, least: int, key: str, text: str, spanning: bool) -> DataFrame:
    """Likely pairs (a, b) of different components within the same bucket.  members: key, doc_id, component.

    Sketches meet first; only the members that some other one resembles are shingled again and meet with their codes.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("_n"), F.min("component").alias("_low"), F.max("component").alias("_high"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("_who"))
    # a bucket of two has been tested by its pivot; of buckets with the same members one is enough
    mixed = sizes.filter("_n > 2 and _low <> _high").groupBy("_n", "_who").agg(F.min("key").alias("key"))
    mixed = mixed.select("key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    rows = members.join(mixed, "key").join(classes.select("doc_id", "sketch"), "doc_id")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    rows = rows.select("key", "doc_id", "component", "sketch", "_own", other)
    rows = rows.select("key", F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q"), "_own", "doc_id", "component", "sketch")

    def resembling(at, held):
        kept = [held[k] for k in alike(held)]
        whole = [[v] * len(kept) for v in at]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*whole, *([r[k] for r in kept] for k in range(3))], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["key", "_p", "_q", "_own", "doc_id", "component"])

    kept = cut(by_pair(rows, "sketch", resembling, "key long, _p int, _q int, _own int, doc_id long, component long"))
    sets = shingles_of(docs, kept.select(F.col("doc_id").alias("_id")).distinct(), words, key, text, code=True)
    kept = kept.join(sets.withColumnRenamed("_id", "doc_id"), "doc_id")
    return by_pair(kept, "_set", lambda at, held: pairs_batch(meeting(held, least, spanning)), "a long, b long").distinct()


def pairs_batch(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(df: DataFrame, words: int = 5, least: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of `df`."""
    spark = df.sparkSession
    small_batches(spark)
    n = max(2, partitions(spark))
    docs = cut(sketched(df, words, key, text))
    linkable = docs.filter("digest is not null and doc_id is not null")
    owners = linkable.groupBy("digest").agg(F.min("doc_id").alias("owner"))
    classes = cut(docs.join(owners, "digest").filter("doc_id = owner").select("doc_id", "keys", "sketch"))
    bands = classes.select("doc_id", F.explode("keys").alias("key"))
    # the member whose identifier, xor the key, is least
    pivots = bands.groupBy("key").agg(F.count("*").alias("_n"), F.min(F.col("doc_id").bitwiseXOR(F.col("key"))).alias("_p"))
    pivots = pivots.filter("_n > 1").select("key", F.col("_p").bitwiseXOR(F.col("key")).alias("pivot"))
    shared = cut(bands.join(pivots, "key"))
    stars = shared.filter("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()  # a pivot is always the head
    links = cut(confirmed(cut(likely(stars, classes)), df, words, least, key, text))
    label = components(links)
    for spanning in (True, False):
        now = cut(label)
        members = shared.join(now.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        members = members.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        tried = cut(across(members, classes, df, words, least, key, text, spanning))
        if tried.isEmpty():
            break
        more = cut(confirmed(tried, df, words, least, key, text))
        links = links.unionByName(more)
        label = components(links)
        if tried.count() == more.count():  # nothing stood in for a pair that failed
            break
    owned = owners.join(label.withColumnRenamed("node", "owner"), "owner", "left")
    owned = owned.select("digest", F.coalesce("component", "owner").alias("_least"))
    out = docs.select("doc_id", "n_shingles", "digest").join(owned, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(df: DataFrame, words: int = 5, least: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays, with all its columns: that with the least identifier."""
    kept = near_duplicates(df, words, least, key, text).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return df.join(kept, df[key].eqNullSafe(kept["_kept_id"]), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: words of A-Z lowered text, five to a shingle, 0.75."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
), n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
two AS (SELECT a AS i, b AS j FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS i, doc_id AS j FROM n UNION SELECT r.i, two.j FROM r JOIN two ON r.j = two.i)
SELECT n.doc_id, n.n AS n_shingles, m AS component_id, n.doc_id = m AS kept FROM n JOIN (SELECT i, min(j) AS m FROM r GROUP BY 1) c ON c.i = n.doc_id
"""
