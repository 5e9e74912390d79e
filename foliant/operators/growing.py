"""JSON that is still being written: the first whole element of a list, the opening of a lesson, figures that can be drawn.

Chunks have stream_id, seq (from 0) and chunk.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FirstElement:
    """An automaton over the characters of an object: says the first whole element of one of its lists, and its finished
    texts so far, as soon as the element closes.  Its state is small and can be kept between chunks: what it holds is
    depth, the piece of a key or value that is being read, finished texts, and the element so far."""

    def __init__(self, name: str = "concepts", state: str = ""):
        self.name = name
        self.depth, self.quoted, self.slash, self.key, self.word, self.after, self.fields, self.element, self.done = json.loads(state) if state else (0, False, False, None, "", "key", {}, None, False)

    def state(self) -> str:
        return json.dumps([self.depth, self.quoted, self.slash, self.key, self.word, self.after, self.fields, self.element, self.done])

    def feed(self, chunk: str) -> str | None:
        """The element, once; None before and after."""
        for c in chunk:
            if self.done:
                return None
            if self.element is not None:
                self.element += c
            if self.quoted:
                if self.slash:
                    self.slash = False
                elif c == "\\":
                    self.slash = True
                elif c == '"':
                    self.quoted = False
                    if self.depth == 1:
                        self._text()
                    continue
                if self.depth == 1:
                    self.word += c
                continue
            if c == '"':
                self.quoted = True
                if self.depth == 1:
                    self.word = ""
            elif c in "{[":
                inside = self.depth == 2 and self.key == self.name and self.after == "list"
                if c == "[" and self.depth == 1 and self.after == "value":
                    self.after = "list" if self.key == self.name else "other"
                elif self.depth == 1:
                    self.after = "other"
                if c == "{" and inside and self.element is None:
                    self.element = c
                self.depth += 1
            elif c in "}]":
                self.depth -= 1
                if self.element is not None and self.depth == 2:
                    self.done = True
                    return self._valid()
            elif self.depth == 1 and c == ":":
                self.after = "value"
            elif self.depth == 1 and c == ",":
                self.after = "key"
        return None

    def _text(self) -> None:
        try:
            text = json.loads(f'"{self.word}"')
        except ValueError:
            text = None
        if self.after == "key":
            self.key = text
        elif self.after == "value" and text is not None:
            self.fields[self.key] = text
            self.after = "other"

    def _valid(self) -> str | None:
        try:
            return self.element if isinstance(json.loads(self.element), dict) else None
        except ValueError:
            return None


FOUND = "stream_id bigint, at bigint, language string, concept string"


def first_concepts(chunks: DataFrame, name: str = "concepts") -> DataFrame:
    """stream_id, at, language, concept: the first whole element of each stream's list and the chunk that closed it.  The
    chunks of a stream go through one automaton in order; nothing but its state is held."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scan = object(), FirstElement(name)
        for b in batches:
            out = []
            for stream, seq, chunk in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if stream != now:
                    now, scan = stream, FirstElement(name)
                found = scan.feed(chunk or "")
                if found is not None:
                    out.append((stream, seq, scan.fields.get("language"), found))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["stream_id", "at", "language", "concept"])

    rows = chunks.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "chunk")
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, FOUND)


def opening(lesson: Column) -> Column:
    """A lesson (JSON) with what comes before its cards alone: hook, prediction, explore; cards and quiz are held back, as
    those that come later would be spliced around them.  Null for what is no object."""
    v = F.try_parse_json(lesson)
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant").alias(name)
    empty = lambda name: F.parse_json(F.lit("[]")).alias(name)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(F.struct(part("hook"), part("prediction"), part("explore"), empty("cards"), empty("quiz"))))


def worth_showing(lesson: Column) -> Column:
    """Whether there is more to open with than a hook: a prediction or something to explore beside it."""
    v = F.try_parse_json(lesson)
    has = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) != "VOID", F.lit(False))
    return has("hook") & (has("prediction") | has("explore"))


#: What a figure must have to be drawn: for each type its lists, with the least number of elements and what each must have
#: ("" for a text, a name for a field); a type that is not here cannot be drawn.
FIGURES: dict[str, list[tuple[str, int, tuple[tuple[str, str], ...]]]] = {
    "flow": [("steps", 2, (("", "string"),))],
    "bar": [("bars", 1, (("label", "string"), ("value", "double")))],
    "timeline": [("events", 2, (("label", "string"), ("year", "double")))],
    "gematria": [("words", 1, (("word", "string"),))],
}
MOST_PARTS = 6


def drawable(spec: Column) -> Column:
    """Whether a figure (a variant) can be drawn: by the rules of its type, and a group by those of its parts, of which none
    is a group.  Never an error: what has another form than it should cannot be drawn."""
    kind = F.try_variant_get(spec, "$.type", "string")

    def single(v: Column) -> Column:
        own = F.try_variant_get(v, "$.type", "string")
        out = F.lit(False)
        for name, lists in FIGURES.items():
            fits = F.lit(True)
            for field, least, parts in lists:
                items = F.try_variant_get(v, f"$.{field}", "array<variant>")
                fits = fits & F.coalesce((F.size(items) >= least) & F.forall(items, _whole(parts)), F.lit(False))
            out = F.when(own == name, fits).otherwise(out)
        return F.coalesce(out, F.lit(False))

    parts = F.try_variant_get(spec, "$.items", "array<variant>")
    group = F.coalesce(F.size(parts).between(1, MOST_PARTS) & F.forall(parts, single), F.lit(False))
    return F.coalesce(F.when(kind == "group", group).otherwise(single(spec)), F.lit(False))


def _whole(parts: tuple[tuple[str, str], ...]):
    """Whether an element has all its parts, of their types."""
    return lambda x: _all(F.try_variant_get(x, f"$.{f}" if f else "$", t).isNotNull() for f, t in parts)


def _all(tests: Iterable[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def visuals(rows: DataFrame, key: str, spec: str) -> DataFrame:
    """key, type: figures that can be drawn; a slider also needs a range and an output that can be worked out."""
    v = F.try_parse_json(spec)
    kinds = rows.select(key, spec, v.alias("_v"), F.try_variant_get(v, "$.type", "string").alias("type"))
    plain = kinds.filter((F.col("type") != "slider") & drawable(F.col("_v"))).select(key, "type")
    return plain.unionByName(sliders(kinds.filter("type = 'slider'"), key, spec).select(key, F.lit("slider").alias("type")))


def slider(text: str | None) -> dict | None:
    """A slider with a range, its value inside it, and those of its outputs that can be worked out; None without any."""
    from .mathx import evaluate

    try:
        spec = json.loads(text or "")
        low, high = float(spec["min"]), float(spec["max"])
        if not low < high:
            return None
        fixed = {k: float(x) for k, x in (spec.get("constants") or {}).items()}
        name, value = str(spec.get("variable") or "x"), min(max(float(spec.get("value", low)), low), high)
        outputs = [o for o in spec["outputs"] if evaluate(o.get("expr"), fixed | {name: value}) is not None]
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return {"variable": name, "min": low, "max": high, "value": value, "constants": fixed, "outputs": outputs} if outputs else None


def sliders(rows: DataFrame, key: str, spec: str) -> DataFrame:
    """key, slider (JSON): in Arrow batches, as formulas are a grammar."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            found = [(k, s) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (s := slider(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], b.schema.field(0).type), pa.array([json.dumps(s) for _, s in found], pa.string())], names=[key, "slider"])

    return rows.select(key, spec).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, slider string")

