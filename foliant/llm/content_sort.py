"""Exact deduplication by content sort.

Normalised texts (A-Z lowered, nothing else) are range-partitioned by sampled splitters and sorted externally, so that
equal texts become neighbours; each row is then compared in full with the one before it.  The splitters' key is the
first bytes, the SHA-256 of all bytes and the document's identifier: it is short whatever the texts (so the sample that
the driver sees is bounded by the number of partitions), keeps equal texts adjacent, and lets a group of copies of any
size be cut between tasks.  A group that spans partitions is joined again through the first and last run of each
partition, which are compared in full as well; these are two rows a partition.

Edge cases: a null text counts as empty, and all empty texts are equal; rows that repeat an identifier count each;
null identifiers sort first and stay only where a group has no other; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, table, text_or_empty

#: Bytes of the text in the splitters' key.
HEAD = 32


def normalised(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (binary, A-Z lowered), head, digest."""
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            low = pc.cast(pc.ascii_lower(b.column(1)), pa.binary())
            digests = pa.array([hashlib.sha256(x.as_buffer()).digest() for x in low], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), low, pc.binary_slice(low, 0, HEAD), digests], names=["doc_id", "text", "head", "digest"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("_v"))
    return rows.mapInArrow(run, "doc_id long, text binary, head binary, digest binary")


def runs(ordered: DataFrame) -> DataFrame:
    """One row per document of a sorted frame, and the texts of each partition's outer runs.

    doc_id, digest, pid, side (0 first run of the partition, 1 last run of several, null inner), size, low, high of the
    run within the partition, edge (the text, on one row of an outer run).
    """

    def run(batches):
        from pyspark import TaskContext

        pid, first, held, last = TaskContext.get().partitionId(), True, [], None

        def close(side):
            ids = np.concatenate(held)
            n, real = len(ids), ids[ids != NO_ID]
            low, high = (int(real.min()), int(real.max())) if len(real) else (None, None)
            digest = hashlib.sha256(last).digest()
            for at in range(0, n, 10_000):
                own = ids[at : at + 10_000]
                m = len(own)
                edge = [None] * m
                if side is not None and at == 0:
                    edge[0] = last
                fill = lambda x, kind, m=m: pa.array([x] * m, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64(), mask=own == NO_ID), fill(digest, pa.binary()), fill(pid, pa.int64()), fill(side, pa.int32()), fill(n, pa.int64()), fill(low, pa.int64()), fill(high, pa.int64()), pa.array(edge, pa.binary())],
                    names=["doc_id", "digest", "pid", "side", "size", "low", "high", "edge"],
                )

        for b in batches:
            ids = pc.fill_null(b.column(0), NO_ID).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_pylist()
            at = 0
            for k, text in enumerate(texts):
                if text == last:  # the full comparison of neighbours
                    continue
                if k > at:
                    held.append(ids[at:k])
                if held:
                    yield from close(0 if first else None)
                    first = False
                held, last, at = [], text, k
            if len(texts) > at:
                held.append(ids[at:])
        if held:
            yield from close(0 if first else 1)

    return ordered.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, pid long, side int, size long, low long, high long, edge binary")


#: Stands for a null identifier inside a task.
NO_ID = -(1 << 63)


def joined_edges(found: DataFrame) -> DataFrame:
    """pid, side → size, low, high of the whole group of each outer run: two rows a partition, compared in full."""
    edges = found.filter("edge is not null").select("pid", "side", "size", "low", "high", "edge")
    light = edges.select("pid", "side", "size", "low", "high")
    in_order = Window.orderBy("pid", "side")  # two light rows a partition
    light = light.withColumn("before_pid", F.lag("pid").over(in_order)).withColumn("before_side", F.lag("side").over(in_order))
    before = edges.select(F.col("pid").alias("before_pid"), F.col("side").alias("before_side"), F.col("edge").alias("before_edge"))
    same = (
        light.filter("side = 0")
        .join(edges.filter("side = 0").select("pid", "edge"), "pid")
        .join(before, ["before_pid", "before_side"])
        .filter(F.col("edge") == F.col("before_edge"))
        .select("pid", F.lit(0).alias("side"), F.lit(1).alias("goes_on"))
    )
    chain = light.join(same, ["pid", "side"], "left")
    group = F.sum(F.when(F.col("goes_on").isNull(), 1).otherwise(0)).over(in_order)
    chain = chain.withColumn("chain", group)
    whole = Window.partitionBy("chain")
    return chain.select("pid", "side", *(f.over(whole).alias(n) for n, f in (("all_size", F.sum("size")), ("all_low", F.min("low")), ("all_high", F.max("high")))))


def exact_groups(df: DataFrame, keep: str = "smallest", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document.

    keep: "smallest" or "largest" identifier of each group of equal texts.  Where an identifier repeats within a group,
    each of its rows counts as kept.
    """
    spark = df.sparkSession
    rows = normalised(df, key, text)
    n = max(2, partitions(spark))
    ordered = rows.repartitionByRange(n, "head", "digest", F.col("doc_id")).sortWithinPartitions("head", "digest", "text", "doc_id")
    found = cut(runs(ordered))
    edges = joined_edges(found)  # two rows a partition: bounded by the partition count
    out = found.drop("edge").join(F.broadcast(edges), ["pid", "side"], "left")
    kept = "high" if keep == "largest" else "low"
    keep_id = F.coalesce(F.col(f"all_{kept}"), F.col(kept))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, keep: str = "smallest", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stay, all their columns.

    A row is told by its identifier and its text, so that an identifier that other texts have too brings no copy back.
    """
    kept = exact_groups(df, keep, key, text).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).distinct()
    digest = F.sha2(F.translate(text_or_empty(text), ascii_uppercase, ascii_lowercase), 256)
    return df.join(kept, df[key].cast("long").eqNullSafe(kept["_kept_id"]) & (digest == kept["_kept_sha"]), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: of equal texts the row with the largest doc_id stays."""
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
