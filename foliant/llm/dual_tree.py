"""Hard negatives by a dual-tree search: one tree over the anchors, one over all rows.

Both trees are k-d trees.  Their upper part is cut from a bounded sample and deals rows into nodes; a node's rows are
packed into blocks, and each block carries the lower part of the tree over its own rows.  A pair of nodes has an interval
that holds every inner product between them (from the two boxes, and from centres and radii).  A pair whose interval cannot
reach what the best-placed anchor of the group still asks for is dropped for the whole group at once; what is left goes
down to pairs of leaves, which are scored exactly in integers.

The search runs twice, each time in two rounds: the node of the highest possible product first, then all others that can
still beat what that gave.  The first search asks for the best rows of the anchor's own label.  The second asks, for each of
these positives, for the best rows of other labels inside a band below its score.  A pair of blocks is one row of a join on
the block's unique key, so no key is hot: a node with many rows, copies of one vector say, is just more blocks.

The sample (SAMPLE rows, by hash) places the cuts only; every row is indexed and the result is exact.

Edge cases: rows with a null label or vector, or with a null or non-finite component, take no part; shorter vectors count
as filled up with zeros; rows with the anchor's own vec_id are not its positives; a null vec_id is never an anchor and comes
after all others in ties; rows that repeat in full each count; anchors that repeat each get their rows; anchors without a
positive, and positives without a negative in the band, give no rows; no rows give none; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut, small_batches, table

#: Rows that the cuts of the upper trees are chosen from.
SAMPLE = 4096
#: Rows in a block of candidates and of anchors, about; rows in a leaf of each; nodes of an upper tree at most.
ROWS, ANCHORS, LEAF, GROUP, NODES = 4096, 512, 64, 32, 256
#: A score below all others, and the vec_id that stands for null.
NONE, NULL_ID = -(2**62), 2**63 - 1
BLOCK = "node int, chunk int, n bigint, width int, body binary, low array<double>, high array<double>"
HITS = "a_node int, a_chunk int, row int, band int, anchor_id bigint, score bigint, vec_id bigint"


class Tree:
    """A k-d tree over the rows of a block.  Rows lie in the order of its leaves and a node's halves are equal, so its
    shape follows from the number of rows."""

    def __init__(self, ids, labels, x, leaf: int):
        import numpy as np

        self.ids, self.labels, self.x, self.leaf = ids, labels, x, leaf
        spans, self.kids, k = [(0, len(ids))], [], 0
        while k < len(spans):
            a, b = spans[k]
            if b - a > leaf:
                mid = (a + b) // 2
                self.kids.append((len(spans), len(spans) + 1))
                spans += [(a, mid), (mid, b)]
            else:
                self.kids.append((-1, -1))
            k += 1
        self.spans, self.kids = np.array(spans), np.array(self.kids)
        self.is_leaf = self.kids[:, 0] < 0

    def bound(self) -> Tree:
        """Boxes, centres, radii and labels of all nodes."""
        import numpy as np

        f = self.x.astype(float)
        self.low, self.high = (np.array([g(f[a:b], 0) for a, b in self.spans]) for g in (np.min, np.max))
        self.mid = (self.low + self.high) / 2
        self.far = np.array([math.sqrt(((f[a:b] - m) ** 2).sum(1).max()) for (a, b), m in zip(self.spans, self.mid, strict=True)])
        self.size = np.sqrt((self.mid**2).sum(1))
        self.first, self.last = (np.array([g(self.labels[a:b]) for a, b in self.spans]) for g in (np.min, np.max))
        return self

    def pack(self) -> bytes:
        return self.ids.tobytes() + self.labels.tobytes() + self.x.tobytes()

    @staticmethod
    def of(body: bytes, n: int, width: int, leaf: int) -> Tree:
        import numpy as np

        head = np.frombuffer(body, np.int64, 2 * n)
        rest = len(body) - 16 * n
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[rest // (n * width)] if width else np.int16
        return Tree(head[:n], head[n:], np.frombuffer(body, kind, n * width, 16 * n).reshape(n, width), leaf)

    @staticmethod
    def grow(ids, labels, x, leaf: int) -> Tree:
        """Rows put in order: each node is halved along its widest side."""
        import numpy as np

        order, todo = np.arange(len(ids)), [(0, len(ids))]
        while todo:
            a, b = todo.pop()
            if b - a > leaf and x.shape[1]:
                own = x[order[a:b]]
                side = int(np.argmax(own.max(0) - own.min(0)))
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, side], mid)]
                todo += [(a, a + mid), (a + mid, b)]
        return Tree(ids[order], labels[order], np.ascontiguousarray(x[order]), leaf)


def interval(a, i, c, j):
    """Bounds of all inner products between the nodes i of one tree and j of the other."""
    import numpy as np

    four = [u[i] * v[j] for u in (a.low, a.high) for v in (c.low, c.high)]
    low, high = np.minimum.reduce(four).sum(1), np.maximum.reduce(four).sum(1)
    mid = (a.mid[i] * c.mid[j]).sum(1)
    reach = a.size[i] * c.far[j] + c.size[j] * a.far[i] + a.far[i] * c.far[j]
    low, high = np.maximum(low, mid - reach), np.minimum(high, mid + reach)
    slack = 1e-9 * (np.abs(mid) + reach) + 0.5  # rounding of the bounds themselves
    return low - slack, high + slack


def surviving(a, c, least, most, same: bool):
    """Pairs of leaves that may hold what is asked for, with their upper bounds.  least, most: by node of a."""
    import numpy as np

    i, j, done = np.zeros(1, int), np.zeros(1, int), []
    while len(i):
        low, high = interval(a, i, c, j)
        ok = (high >= least[i]) & (low <= most[i])
        if same:
            ok &= (a.first[i] <= c.last[j]) & (c.first[j] <= a.last[i])
        else:
            ok &= (a.first[i] != a.last[i]) | (c.first[j] != c.last[j]) | (a.first[i] != c.first[j])
        i, j, high = i[ok], j[ok], high[ok]
        ends = a.is_leaf[i] & c.is_leaf[j]
        done.append((i[ends], j[ends], high[ends]))
        i, j = i[~ends], j[~ends]
        ki = np.where(a.is_leaf[i][:, None], np.stack([i, np.full(len(i), -1)], 1), a.kids[i])
        kj = np.where(c.is_leaf[j][:, None], np.stack([j, np.full(len(j), -1)], 1), c.kids[j])
        i, j = np.repeat(ki, 2, 1).ravel(), np.tile(kj, (1, 2)).ravel()
        both = (i >= 0) & (j >= 0)
        i, j = i[both], j[both]
    return [np.concatenate(x) for x in zip(*done, strict=True)] if done else [np.zeros(0, int)] * 3


def by_node(a, values, worst):
    """The least or largest of the anchors' values in each node."""
    import numpy as np

    return np.array([worst(values[p:q]) for p, q in a.spans], float)


def search(a, c, low, high, kth, same: bool, k: int):
    """row, band, score, id: for each anchor and band the k best rows of c with low <= score <= high that are not below
    kth.  low, high, kth: integers, anchors x bands."""
    import numpy as np

    need = np.maximum(low, kth)
    i, j, top = surviving(a, c, by_node(a, need, np.min), by_node(a, high, np.max), same)
    n, bands = low.shape
    best, who = np.full((n, bands, k), NONE), np.full((n, bands, k), NULL_ID)
    wide = float(np.abs(a.x.astype(float)).max(initial=0)) * float(np.abs(c.x.astype(float)).max(initial=0)) * max(1, a.x.shape[1])
    kind = np.float64 if wide < 2**52 else np.int64  # exact either way
    xa, xc = a.x.astype(kind), c.x.astype(kind)
    for at in np.argsort(-top, kind="stable"):
        (p, q), (r, s) = a.spans[i[at]], c.spans[j[at]]
        if top[at] < need[p:q].min():
            continue
        scores = (xa[p:q] @ xc[r:s].T).astype(np.int64)
        own = a.labels[p:q, None] == c.labels[None, r:s]
        own = own & (a.ids[p:q, None] != c.ids[None, r:s]) if same else ~own
        hit = own[:, None, :] & (scores[:, None, :] >= need[p:q, :, None]) & (scores[:, None, :] <= high[p:q, :, None])
        rows, cols = np.flatnonzero(hit.any((1, 2))), np.flatnonzero(hit.any((0, 1)))
        if not len(rows):
            continue
        new = np.where(hit[np.ix_(rows, range(bands), cols)], scores[np.ix_(rows, cols)][:, None, :], NONE)
        all_scores = np.concatenate([best[p + rows], new], 2)
        all_ids = np.concatenate([who[p + rows], np.broadcast_to(c.ids[r:s][cols], new.shape)], 2)
        order = np.lexsort((all_ids, -all_scores), axis=2)[:, :, :k]
        best[p + rows], who[p + rows] = np.take_along_axis(all_scores, order, 2), np.take_along_axis(all_ids, order, 2)
        need[p + rows] = np.maximum(need[p + rows], best[p + rows][:, :, k - 1])
    row, band, place = np.nonzero(best > NONE)
    return row, band, best[row, band, place], who[row, band, place]


def eligible(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q: the rows that take part, with integer components."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & x.isNotNull()).filter(F.coalesce(whole, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long")).alias("q"))


def placing(sample: list, nodes: int) -> Column:
    """The node of a row: nested comparisons cut from the sample, the fullest node first, at its widest spread."""
    import numpy as np

    width = max((len(q) for q in sample), default=0)
    x = np.zeros((len(sample), width))
    for row, q in zip(x, sample, strict=True):
        row[: len(q)] = q

    def split(rows, share: int, number: int):
        if share < 2 or len(rows) < 2 or not width:
            return F.lit(number)
        own = x[rows]
        side = int(own.var(0).argmax())
        cut_at = float(np.median(own[:, side]))
        right = own[:, side] > cut_at
        if not right.any():  # over half are equal there and nothing is above
            cut_at = float(np.nextafter(own[:, side].max(), -np.inf))
            right = own[:, side] > cut_at
            if right.all():
                return F.lit(number)
        value = F.coalesce(F.try_element_at("q", F.lit(side + 1)), F.lit(0))
        return F.when(value > cut_at, split(rows[right], share // 2, number + share // 2)).otherwise(split(rows[~right], share // 2, number))

    return split(np.arange(len(sample)), nodes, 0)


def blocks(rows: DataFrame, node: Column, rows_each: int, leaf: int, width: int) -> DataFrame:
    """BLOCK: rows dealt to nodes and blocks, each packed with its tree, written once."""
    placed = rows.withColumn("node", node.cast("int"))
    sizes = {r.node: r["count"] for r in placed.groupBy("node").count().collect()}  # at most NODES rows
    parts = F.create_map(*[F.lit(v) for k, n in (sizes or {0: 0}).items() for v in (k, max(1, math.ceil(n / rows_each)))])
    # dealt by place in the scan: equal rows go to different blocks as well
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(parts, F.col("node"))).cast("int"))
    schema = arrow_schema(BLOCK)

    def pack(t):
        import numpy as np
        import pyarrow as pa

        n = t.num_rows
        ids = np.array([NULL_ID if v is None else v for v in t["vec_id"].to_pylist()], np.int64)
        q = t["q"].combine_chunks()
        flat, sizes = q.flatten().to_numpy(zero_copy_only=False), q.value_lengths().to_numpy(zero_copy_only=False)
        x = np.zeros((n, width), np.int64)
        x[np.arange(width)[None, :] < sizes[:, None]] = flat
        most = int(np.abs(x).max(initial=0))
        x = x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)
        tree = Tree.grow(ids, t["label"].to_numpy(), x, leaf)
        low, high = (g(x, axis=0).astype(float).tolist() if width else [] for g in (np.min, np.max))
        own = {"node": t["node"][0].as_py(), "chunk": t["chunk"][0].as_py(), "n": n, "width": width, "body": tree.pack(), "low": low, "high": high}
        return pa.Table.from_pylist([own], schema)

    return cut(placed.groupBy("node", "chunk").applyInArrow(pack, BLOCK))


class Boxes:
    """The roots of the candidates' nodes: bounds only, at most NODES of them."""

    def __init__(self, low, high):
        import numpy as np

        self.low, self.high = low, high
        self.mid = (low + high) / 2
        self.far = np.sqrt((((high - low) / 2) ** 2).sum(1))
        self.size = np.sqrt((self.mid**2).sum(1))


def roots(cands: DataFrame, width: int) -> tuple[Boxes, dict[int, int]]:
    """Each node's box, and its number of blocks."""
    import numpy as np

    chunks = {r.node: r["count"] for r in cands.groupBy("node").count().collect()}
    nodes = max(chunks, default=-1) + 1
    low, high = np.full((nodes, width), np.inf), np.full((nodes, width), -np.inf)
    sides = cands.select("node", F.posexplode(F.arrays_zip("low", "high")).alias("side", "b"))
    for r in sides.groupBy("node", "side").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high")).toLocalIterator():  # NODES x width
        low[r.node, r.side], high[r.node, r.side] = r.low, r.high
    low[[k for k in range(nodes) if k not in chunks]] = high[[k for k in range(nodes) if k not in chunks]] = 0
    return Boxes(low, high), chunks


def asked(anchors: DataFrame, bands: DataFrame | None) -> DataFrame:
    """Anchor blocks with what their anchors ask for: an array of (row, band, low, high, kth)."""
    if bands is None:
        return anchors.withColumn("asks", F.lit(None).cast("array<struct<row:int,band:int,low:bigint,high:bigint,kth:bigint>>"))
    own = bands.groupBy(F.col("a_node").alias("node"), F.col("a_chunk").alias("chunk")).agg(F.collect_list(F.struct("row", "band", "low", "high", "kth")).alias("asks"))
    return anchors.join(own, ["node", "chunk"])


def grids(r: dict, n: int, bands: int):
    """The asks of a block as three arrays, anchors x bands.  Without asks: everything, from the start."""
    import numpy as np

    if r["asks"] is None:
        return np.full((n, bands), NONE), np.full((n, bands), -NONE), np.full((n, bands), NONE)
    low, high, kth = np.full((n, bands), -NONE), np.full((n, bands), NONE), np.full((n, bands), NONE)
    for x in r["asks"]:
        low[x["row"], x["band"]], high[x["row"], x["band"]], kth[x["row"], x["band"]] = x["low"], x["high"], x["kth"]
    return low, high, kth


def round_of(anchors: DataFrame, cands: DataFrame, boxes: Boxes, chunks: dict[int, int], first: bool, same: bool, bands: int, k: int) -> DataFrame:
    """HITS of one round: the node of the highest bound (first), or all others that can hold what is asked for."""
    import numpy as np

    known = np.array(sorted(chunks), int)
    kind = "a_node int, a_chunk int, a_n bigint, a_body binary, asks array<struct<row:int,band:int,low:bigint,high:bigint,kth:bigint>>, node int, chunk int"
    sent, given = arrow_schema(kind), arrow_schema(HITS)

    def choose(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                a = Tree.of(r["body"], r["n"], r["width"], GROUP).bound()
                low, high, kth = grids(r, r["n"], bands)
                i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(a.is_leaf), known, indexing="ij"))
                least, most = interval(a, i, boxes, j)
                home = known[most.reshape(-1, len(known)).max(0).argmax()]
                need, top = by_node(a, np.maximum(low, kth), np.min), by_node(a, high, np.max)
                wanted = [home] if first else sorted(set(j[(most >= need[i]) & (least <= top[i])].tolist()) - {home})
                own = {"a_node": r["node"], "a_chunk": r["chunk"], "a_n": r["n"], "a_body": r["body"], "asks": r["asks"]}
                for node in wanted:
                    for chunk in range(chunks[int(node)]):
                        yield pa.RecordBatch.from_pylist([own | {"node": int(node), "chunk": chunk}], sent)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                a = Tree.of(r["a_body"], r["a_n"], r["width"], GROUP).bound()
                c = Tree.of(r["body"], r["n"], r["width"], LEAF).bound()
                row, band, scores, ids = search(a, c, *grids(r, r["a_n"], bands), same, k)
                m = len(row)
                anchor = a.ids[row]
                columns = [np.full(m, r["a_node"], np.int32), np.full(m, r["a_chunk"], np.int32), row.astype(np.int32), band.astype(np.int32), anchor, scores, ids]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=given)

    pairs = anchors.mapInArrow(choose, kind).join(cands.select("node", "chunk", "n", "width", "body"), ["node", "chunk"])
    return pairs.mapInArrow(score, HITS)


ANCHOR = ["a_node", "a_chunk", "row"]


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each anchor and band, with their rank from 1."""
    best = Window.partitionBy(*ANCHOR, "band").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def best_hits(anchors: DataFrame, bands: DataFrame | None, cands: DataFrame, boxes: Boxes, chunks: dict, same: bool, width: int, k: int) -> DataFrame:
    """Both rounds of a search.  bands: what is asked for (ANCHOR, band, low, high); None asks for the best of all."""
    one = cut(ranked(round_of(asked(anchors, None if bands is None else bands.withColumn("kth", F.lit(NONE))), cands, boxes, chunks, True, same, width, k), k))
    kth = one.groupBy(*ANCHOR, "band").agg(F.when(F.count("*") == k, F.min("score")).otherwise(NONE).alias("kth"))
    if bands is None:  # anchors that the first round gave nothing still ask for everything
        every = anchors.select(F.col("node").alias("a_node"), F.col("chunk").alias("a_chunk"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("row"))
        bands = every.select(*ANCHOR, F.lit(0).alias("band"), F.lit(NONE).alias("low"), F.lit(-NONE).alias("high"))
    left = bands.join(kth, [*ANCHOR, "band"], "left").withColumn("kth", F.coalesce("kth", F.lit(NONE)))
    two = round_of(asked(anchors, left), cands, boxes, chunks, False, same, width, k)
    return cut(ranked(one.drop("rank").unionByName(two), k))


OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """OUT: for each anchor and each of its best positives, the best rows of other labels that score low to high per cent of
    the positive's score.  vectors: vec_id, label, embedding."""
    spark = vectors.sparkSession
    small_batches(spark, 16)
    rows = eligible(vectors)
    total = rows.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors"), F.max(F.size("q")).alias("width")).first()
    if not total.anchors:
        return spark.createDataFrame([], OUT)
    one_in = math.ceil(total.n / SAMPLE)  # by hash; the limit holds where equal rows share one
    sample = [r.q for r in rows.filter(F.pmod(F.xxhash64("vec_id", "q"), F.lit(one_in)) == 0).select("q").limit(SAMPLE).collect()]
    nodes = lambda n, each: min(NODES, 2 ** math.ceil(math.log2(max(1, n / each))))
    cands = blocks(rows, placing(sample, nodes(total.n, ROWS)), ROWS, LEAF, total.width)
    anchors = blocks(rows.filter(is_anchor), placing(sample, nodes(total.anchors, ANCHORS)), ANCHORS, GROUP, total.width)
    boxes, chunks = roots(cands, total.width)
    own = best_hits(anchors, None, cands, boxes, chunks, True, 1, positives).withColumn("band", F.col("rank") - 1)
    score = F.col("score")
    bands = own.select(*ANCHOR, "band", F.ceil(F.expr(f"CAST(score AS DECIMAL(38,0)) * {low} / 100")).cast("long").alias("low"), F.floor(F.expr(f"CAST(score AS DECIMAL(38,0)) * {high} / 100")).cast("long").alias("high")).filter("low <= high")
    other = best_hits(anchors, bands, cands, boxes, chunks, False, positives, negatives)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    kept = own.select(*ANCHOR, "band", real("vec_id").alias("positive_id"), score.alias("positive_score"))
    out = other.select(*ANCHOR, "band", "anchor_id", "rank", real("vec_id").alias("negative_id"), score.alias("negative_score"))
    return out.join(kept, [*ANCHOR, "band"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir):
    """op11: labels moved where vec_id is divisible by 7; anchors are the rows whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
