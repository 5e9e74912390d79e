"""Best-fit packing with several permitted sequence lengths.

Items of equal length are interchangeable, so the packing is worked out on the histogram of lengths: at most as many
entries as the largest permitted length, whatever the corpus.  Lengths go in descending order; each count of items goes
into the open bins with the least room that still holds it, as many into each as it takes; bins that share their whole
history stay one entry.
Where none holds it, bins open, of the permitted length that costs least for a token of what will fill it: each length
is filled with this item and the largest ones still to come, shrunk to that, and priced.  At the end each bin shrinks to
the least permitted length that holds its contents.  The same is tried with one opening length for all bins, for each
permitted one (a longer item opens the least length that holds it), and the trial of least total cost is taken.  Items then find their bin by their rank among items of their length; ranks come
from a range partition on (length, identifier) and per-partition counts, so a length that a third of the corpus has is
spread over tasks.

Items longer than the largest permitted length are cut into parts: full ones, and the rest.

Edge cases: items of length 0 or null take no room and get no bin (bin_id null); ties within a length go by identifier
and part; rows that repeat an identifier are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, table

#: Permitted sequence lengths of the query, in byte-level tokens.
CAPACITIES = (2048, 4096, 8192, 16384)
#: Rows up to which the plan of bins is broadcast (some 50 bytes each); beyond, it is joined by its length.
PLAN_ROWS = 200_000


def sequence_cost(capacity: int) -> float:
    """A sequence's cost: a fixed part, its tokens, and attention."""
    return 256 + capacity + capacity * capacity / 65536


class Packing:
    """Bins for a histogram.  plan: (length, first rank, rank after the last, first bin, offset within the bin)."""

    def __init__(self, histogram: dict[int, int], capacities: tuple[int, ...], opening: int | None = None, cost=sequence_cost):
        self.capacities = sorted(capacities)
        self.plan: list[tuple[int, int, int, int, int]] = []
        rooms: list[int] = []  # sorted; those with open bins
        open_bins: dict[int, list[tuple[int, int, int]]] = {}  # room → (first bin, bins, used)
        bins = 0
        sizes = sorted(histogram)

        def filled(capacity, length, left):
            """What a bin of this capacity would hold in the end, opened now."""
            taken = min(left, capacity // length)
            room, k = capacity - taken * length, bisect_left(sizes, length)
            while room and (k := bisect_right(sizes, room, 0, k) - 1) >= 0:
                room -= min(histogram[sizes[k]], room // sizes[k]) * sizes[k]
            return capacity - room

        def opened(length, left):
            fits = [c for c in self.capacities if c >= length]
            if opening is not None:
                return max(opening, fits[0])
            held = [(filled(c, length, left), c) for c in fits]
            return min(held, key=lambda h: (cost(next(c for c in fits if c >= h[0])) / h[0], h[1]))[1]

        def put(room, entry):
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append(entry)

        for length in sorted(histogram, reverse=True):
            rank, left = 0, histogram[length]
            while left:
                k = bisect_left(rooms, length)
                if k < len(rooms):
                    room = rooms[k]
                    first, n, used = open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room], rooms[k]
                else:
                    room, first, n, used = opened(length, left), bins, 0, 0
                # a bin with the least room keeps it until it can take no more
                each = room // length
                if not n:
                    n = -(-left // each)
                    bins += n
                for items in (each, left % each):
                    m = min(n, left // each) if items == each else min(n, int(0 < left < each))
                    if not m or not items:
                        continue
                    for j in range(items):
                        self.plan.append((length, rank, rank + m, first, used + j * length))
                        rank += m
                    put(room - items * length, (first, m, used + items * length))
                    first, n, left = first + m, n - m, left - m * items
                if n:
                    put(room, (first, n, used))
        #: (first bin, bins, used, capacity after shrinking)
        self.bins = [(first, n, used, next(c for c in self.capacities if c >= used)) for entries in open_bins.values() for first, n, used in entries]
        self.cost = sum(n * cost(c) for _, n, _, c in self.bins)

    def fine(self) -> list[tuple]:
        """The plan with the final contents and size of its bins: runs of bins cut where these differ."""
        ends = sorted(self.bins)
        firsts, rows = [b[0] for b in ends], []
        for length, lo, hi, first, start in self.plan:
            k, at, end = bisect_left(firsts, first + 1) - 1, first, first + hi - lo
            while at < end:
                b_first, n, used, capacity = ends[k]
                stop = min(b_first + n, end)
                rows.append((length, lo + at - first, lo + stop - first, at, start, used, capacity))
                at, k = stop, k + 1
        return rows


#: The columns of `Packing.fine`.
PLAN = "plan_length long, first_rank long, end_rank long, first_bin long, bin_start long, bin_used long, bin_capacity long"


def best_packing(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost=sequence_cost) -> Packing:
    return min((Packing(histogram, capacities, c, cost) for c in (None, *sorted(capacities))), key=lambda p: p.cost)


def ranked(items: DataFrame, n: int) -> DataFrame:
    """doc_id, part, n_parts, length, pid, rank within length and partition; checkpointed."""

    def run(batches):
        from pyspark import TaskContext

        pid, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            lengths = b.column(3).to_numpy()
            if not len(lengths):
                continue
            start = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]])
            rank = np.arange(len(lengths)) - np.repeat(start, np.diff(np.r_[start, len(lengths)]))
            if lengths[0] == last:
                rank[: start[1] if len(start) > 1 else None] += seen
            last, seen = lengths[-1], rank[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(lengths), pid), pa.int64()), pa.array(rank.astype(np.int64))], names=[*b.schema.names, "pid", "rank"])

    ordered = items.repartitionByRange(n, "length", "doc_id", "part").sortWithinPartitions("length", "doc_id", "part")
    return cut(ordered.select("doc_id", "part", "n_parts", "length").mapInArrow(run, "doc_id long, part long, n_parts long, length long, pid long, rank long"))


def pack(df: DataFrame, length, capacities: tuple[int, ...] = CAPACITIES, key: str = "doc_id") -> DataFrame:
    """doc_id, part, n_parts, length, bin_id, bin_start, bin_used, bin_capacity: one row for each part of each row.

    `length`: a column with the length of each row.
    """
    spark = df.sparkSession
    small_batches(spark)
    most = max(capacities)
    whole = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("_n"))
    parts = whole.withColumn("n_parts", F.greatest(F.lit(1), F.ceil(F.col("_n") / most)).cast("long"))
    items = parts.select("doc_id", "_n", "n_parts", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_parts"))).alias("part"))
    items = items.select("doc_id", "part", "n_parts", F.least(F.lit(most).cast("long"), F.col("_n") - (F.col("part") - 1) * most).alias("length"))
    found = ranked(items, max(2, partitions(spark)))
    # a row for each length and partition that holds it: partitions hold ranges, so there are hardly more than lengths
    counts = found.groupBy("length", "pid").agg(F.count("*").alias("n"))
    counts = cut(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect() if r.length > 0}
    packing = best_packing(histogram, capacities)
    fine = packing.fine()
    plan = spark.createDataFrame(fine, PLAN)
    if len(fine) <= PLAN_ROWS:
        plan = F.broadcast(plan)
    rows = found.join(F.broadcast(counts.select("length", "pid", "before")), ["length", "pid"]).withColumn("_rank", F.col("rank") + F.col("before"))
    on = (F.col("length") == F.col("plan_length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank"))
    out = rows.join(plan, on, "left")
    bin_id = F.col("first_bin") + F.col("_rank") - F.col("first_rank")
    return out.select("doc_id", "part", "n_parts", "length", bin_id.alias("bin_id"), "bin_start", "bin_used", "bin_capacity")


def byte_tokens(text: str = "text"):
    """Tokens of a text for a byte-level vocabulary: its UTF-8 bytes and an end; none for an empty or null text."""
    n = F.coalesce(F.octet_length(F.col(text)), F.lit(0))
    return F.when(n > 0, n + 1).otherwise(0)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents, packed by their byte-level tokens."""
    return pack(table(spark, sf_dir, "documents"), byte_tokens())
