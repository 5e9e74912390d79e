"""Repair of conversations by weighted finite-state composition.

Three machines are composed: an acceptor of the rows as they stand, a transducer of edits (Keep, Rerole, Delete, Insert) and
an acceptor of the role initials `(s?(ua)+)?`.  The composition is never built: its states are pairs of a place between two
rows and a state of the grammar, and only those that a path reaches are made, place by place, which is their topological
order.  Weights are pairs (cost, labels) under their lexicographic order; the labels are the edits' initials, so among the
cheapest paths the ASCII-least one stays.  (Of two paths into one state with equal cost, neither's labels can begin with
the other's: the rest would be insertions, which cost something.  So the order stays as it is when both go on alike.)

A long conversation is composed in pieces: rows are dealt by ranges of (conversation, turn, role, digest), each task reduces
its stretch of a conversation to the best weights from each grammar state to each other, and these few rows meet by
conversation.  Equal rows are counted before they are dealt, and a text moves once, to where the repaired conversation is
put together as a stream: the memory of a task is the labels of one conversation, a byte a row, whatever its texts.

Edge cases: null roles and texts are one space; a null conv_id is a conversation of its own; null turns come first; rows of
one turn stand in the order of role, then of the SHA-256 of role and text, so that equal rows are adjacent; a role without
the initial s, u or a can be re-roled or deleted only; a conversation without rows has the empty repair; no rows give no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, partitions, small_batches, table

#: The acceptor of role initials: state, initial, next state; the states that may end.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
#: Costs of the edits, and of a cut-off row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: White space of the contract, as Spark's trim takes it.
SPACE = " \t\n\x0b\x0c\r"
#: Steps after which what all paths have in common is put aside.
ASIDE = 64
ORDER = ["has_turn", "turn", "role", "digest"]


class Paths:
    """The best paths from one grammar state to each state that they reach, over the rows read so far."""

    def __init__(self, start: int = 0):
        self.best: dict[int, tuple[int, str]] = {start: (0, "")}
        self.common: list[str] = []
        self.steps = 0
        self._insert()

    def _better(self, best: dict, state: int | None, cost: int, labels: str) -> bool:
        if state is None or state in best and best[state] <= (cost, labels):
            return False
        best[state] = (cost, labels)
        return True

    def _insert(self) -> None:
        """Arcs that read no row.  A path repeats no state, so as many rounds as there are states settle them."""
        for _ in GRAMMAR:
            for state, (cost, labels) in list(self.best.items()):
                for x in ROLES:
                    self._better(self.best, GRAMMAR[state].get(x), cost + INSERT, labels + "I")

    def read(self, initial: str, must_go: bool, cut_off: bool) -> None:
        new: dict[int, tuple[int, str]] = {}
        stays = CUT_OFF if cut_off else 0
        for state, (cost, labels) in self.best.items():
            self._better(new, state, cost + DELETE, labels + "D")
            if not must_go:
                self._better(new, GRAMMAR[state].get(initial), cost + stays, labels + "K")
                for x in ROLES:
                    self._better(new, GRAMMAR[state].get(x), cost + stays + REROLE, labels + "R")
        self.best = new
        self._insert()
        self._aside()

    def go_on(self, piece: list[dict]) -> None:
        """Another stretch's best weights: rows of from, to, cost, labels."""
        new: dict[int, tuple[int, str]] = {}
        for p in piece:
            if p["from"] in self.best:
                cost, labels = self.best[p["from"]]
                self._better(new, p["to"], cost + p["cost"], labels + p["labels"])
        self.best = new
        self.steps = ASIDE
        self._aside()

    def _aside(self) -> None:
        self.steps += 1
        if self.steps >= ASIDE:
            self.steps = 0
            if same := os.path.commonprefix([labels for _, labels in self.best.values()]):
                self.common.append(same)
                self.best = {k: (c, labels[len(same) :]) for k, (c, labels) in self.best.items()}

    def rows(self, start: int) -> list[dict]:
        head = "".join(self.common)
        return [{"from": start, "to": k, "cost": c, "labels": head + labels} for k, (c, labels) in self.best.items()]

    def cheapest(self) -> tuple[int, str]:
        cost, labels = min(self.best[k] for k in FINAL if k in self.best)
        return cost, "".join(self.common) + labels


PIECE = "array<struct<from:int,to:int,cost:bigint,labels:string>>"
COUNTS = ["blank", "duplicate", "truncated"]


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, has_turn, turn, role, text, digest, blank, truncated: nulls replaced, rows marked."""
    space = F.lit(" ")
    t = turns.select("conv_id", F.col("turn").isNotNull().cast("int").alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    end = F.rtrim("text", F.lit(SPACE))
    t = t.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return t.withColumn("blank", end == "").withColumn("truncated", (end != "") & ~F.right(end, F.lit(1)).isin(".", "!", "?"))


def _pieces(kind: str):
    schema = arrow_schema(kind)

    def run(batches):
        """Sorted rows in, a row for each conversation's stretch out.  Only the first stretch of a task can begin inside a
        conversation, so only there all states of the grammar are tried as starts."""
        import pyarrow as pa

        now, first, own, out = (), True, None, []

        def end():
            own["ways"] = [row for q, p in zip(own.pop("starts"), own.pop("paths"), strict=True) for row in p.rows(q)]
            out.append(own)

        for batch in batches:
            for r in batch.to_pylist():
                if now != (r["conv_id"],):
                    if own is not None:
                        end()
                        first = False
                    now = (r["conv_id"],)
                    starts = list(GRAMMAR) if first else [0]
                    own = {k: r[k] for k in ["conv_id", *ORDER]} | dict.fromkeys(COUNTS, 0) | {"starts": starts, "paths": [Paths(q) for q in starts]}
                again = r["n"] - 1
                own["blank"] += r["n"] if r["blank"] else 0
                own["duplicate"] += 0 if r["blank"] else again if r["is_first"] else r["n"]
                own["truncated"] += r["truncated"] and r["is_first"]
                for k in range(r["n"]):
                    for p in own["paths"]:
                        p.read(r["role"][:1], r["blank"] or not r["is_first"] or k > 0, r["truncated"])
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if own is not None:
            end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def pieces(rows: DataFrame) -> DataFrame:
    """conv_id, ORDER of its first row, COUNTS, ways: the stretches of each conversation, reduced to their best weights."""
    kinds = cut(rows.groupBy("conv_id", *ORDER, "blank", "truncated").agg(F.count("*").alias("n")))
    first = kinds.groupBy("conv_id", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("at")).select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), F.col("at.has_turn").alias("_h"), F.col("at.turn").alias("_t"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")) & (F.col("has_turn") == F.col("_h")) & (F.col("turn") == F.col("_t"))
    known = kinds.join(first, same, "left").select("conv_id", *ORDER, "blank", "truncated", "n", F.col("_d").isNotNull().alias("is_first"))
    dealt = known.repartitionByRange(partitions(rows.sparkSession), "conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, has_turn int, turn bigint, role string, digest string, blank bigint, duplicate bigint, truncated bigint, ways {PIECE}"
    return dealt.mapInArrow(_pieces(kind), kind)


def _streams(kind: str, turns_out: bool):
    schema = arrow_schema(kind)

    def run(batches):
        """By conversation: its pieces, then its rows.  Gives one row a conversation, or its repaired turns."""
        import pyarrow as pa

        out: list[dict] = []

        class Conversation:
            def __init__(self, conv_id):
                self.id, self.paths, self.labels, self.at, self.state = conv_id, Paths(), None, 0, 0
                self.counts, self.last, self.illegal = dict.fromkeys(COUNTS, 0), None, 0
                self.least = self.most = None
                self.turns, self.place, self.hash = 0, 0, hashlib.sha256()

            def put(self, role: str, text: str, label: str) -> None:
                if turns_out:
                    out.append({"conv_id": self.id, "place": self.place, "role": role, "text": text, "edit": label})
                else:
                    self.hash.update(f"{'\n' if self.place else ''}{role}:{text}".encode())
                self.state = GRAMMAR[self.state][role[:1]]
                self.place += 1

            def follow(self) -> None:
                if self.labels is None:
                    self.cost, self.labels = self.paths.cheapest()

            def inserted(self) -> None:
                while self.at < len(self.labels) and self.labels[self.at] == "I":
                    self.at += 1
                    self.put(ROLES["a" if self.state == 2 else "u"], "", "Insert")

            def row(self, r: dict) -> None:
                self.follow()
                if r["has_turn"]:
                    self.turns += self.most != r["turn"]
                    self.least, self.most = r["turn"] if self.least is None else self.least, r["turn"]
                if self.last is not None:
                    self.illegal += self.last + r["role"][:1] not in ("su", "ua", "au")
                self.last = r["role"][:1]
                self.inserted()
                label = self.labels[self.at]
                self.at += 1
                if label == "K":
                    self.put(r["role"], r["text"], "Keep")
                elif label == "R":
                    self.put(ROLES["a" if self.state == 2 else "u"], r["text"], "Rerole")

            def end(self) -> None:
                self.follow()
                self.inserted()
                if not turns_out:
                    gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
                    out.append({"conv_id": self.id, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.cost, "audit": self.labels, "repaired_sha256": self.hash.hexdigest()})

        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now.id != r["conv_id"]:
                    if now is not None:
                        now.end()
                    now = Conversation(r["conv_id"])
                if r["kind"] == 1:
                    now.paths.go_on(r["ways"])
                    for k in COUNTS:
                        now.counts[k] += r[k]
                elif r["kind"] == 2:
                    now.row(r)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if now is not None:
            now.end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


AUDIT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "place bigint, role string, text string, edit string"


def repair(turns: DataFrame, ids: DataFrame | None = None, turns_out: bool = False) -> DataFrame:
    """Conversations (conv_id, turn, role, text) repaired by the cheapest edits.

    With turns_out, conv_id, place, role, text, edit: a row for each repaired turn.  Without, conv_id and AUDIT: one row for
    each conversation, those of `ids` without any turn included.
    """
    small_batches(turns.sparkSession)
    rows = marked(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    found = pieces(rows).withColumn("kind", F.lit(1))
    every = found.unionByName(rows.select("conv_id", *ORDER, "text").withColumn("kind", F.lit(2)), allowMissingColumns=True)
    if ids is not None:
        every = every.unionByName(ids.select(F.col("conv_id").cast(kind)).withColumn("kind", F.lit(0)), allowMissingColumns=True)
    dealt = every.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    out = f"conv_id {kind}, {TURNS if turns_out else AUDIT}"
    return dealt.mapInArrow(_streams(out, turns_out), out)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after the damage that crc32 of `conv_id:turn` deals out: dropped, emptied, unended, repeated, re-roled."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("_fate")).filter("_fate <> 0")
    rows = rows.withColumn("text", F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again")).drop("_again")


def query(spark, sf_dir):
    """op12: every conversation, damaged and repaired."""
    turns = table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns.select("conv_id").distinct())
