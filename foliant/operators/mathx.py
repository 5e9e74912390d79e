"""Numbers that learners type, letter values, expressions, and computed templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structure import LETTERS, lookup

# fixed values: final letters in the large reckoning
FINALS = {"ך": 500, "ם": 600, "ן": 700, "ף": 800, "ץ": 900}
ORDER = "אבגדהוזחטיכלמנסעפצקרשת"


def learner_number(s: Column) -> Column:
    """Integers, decimals with point or comma, thousands, fractions; null for the rest and for a division by 0."""
    t = F.regexp_replace(F.translate(s, "−–", "--"), "[\"'\\s]", "")
    whole = F.when(t.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), F.regexp_replace(t, ",", "")).when(t.rlike(r"^-?[0-9]*[.,]?[0-9]+$"), F.regexp_replace(t, ",", "."))
    top, low = F.regexp_extract(t, r"^(-?[0-9]+)/([0-9]+)$", 1), F.regexp_extract(t, r"^(-?[0-9]+)/([0-9]+)$", 2)
    ratio = F.when(top != "", F.try_divide(top.cast("double"), low.cast("double")))
    return F.coalesce(whole.cast("double"), ratio)


def letter_sum(word: Column, reckoning: str = "standard") -> Column:
    """The value of a word's letters: standard, large (finals 500 to 900), ordinal, small (one digit)."""
    place = {c: k + 1 for k, c in enumerate(ORDER)} | {f: ORDER.index(b) + 1 for f, b in zip("ךםןףץ", "כמנפצ", strict=True)}
    values = {"standard": LETTERS, "large": LETTERS | FINALS, "ordinal": place, "small": {c: int(str(v).rstrip("0")) for c, v in LETTERS.items()}}[reckoning]
    return F.aggregate(F.split(word, ""), F.lit(0), lambda a, c: a + F.coalesce(lookup(values)[c], F.lit(0))).cast("long")


def summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, median, span and population deviation by group."""
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.groupBy(group).agg(F.count(value).alias("n"), r(F.avg(value), "mean"), r(F.median(value), "median"), r(F.max(value) - F.min(value), "span"), r(F.stddev_pop(value), "deviation"))


def truth_table(spark, variables: int) -> DataFrame:
    """row and its variables v1, v2, ..., counting up from all false."""
    rows = spark.range(1 << variables).withColumnRenamed("id", "row")
    return rows.select("row", *((F.shiftright("row", variables - k).bitwiseAND(F.lit(1)) == 1).alias(f"v{k}") for k in range(1, variables + 1)))


FUNCTIONS = {"sqrt": math.sqrt, "abs": abs, "sin": math.sin, "cos": math.cos, "tan": math.tan, "exp": math.exp, "ln": math.log, "log": math.log10, "floor": math.floor, "ceil": math.ceil}
CONSTANTS = {"pi": math.pi, "e": math.e}
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z_]\w*)|(.))")


class Parser:
    """Numbers, + - * / % ^ (to the right), signs, brackets, named values and functions; nothing else."""

    def __init__(self, text: str, values: dict[str, float]):
        self.items = [m.groups() for m in TOKEN.finditer(text.strip())]
        self.at, self.values = 0, values

    def peek(self):
        return self.items[self.at][2] if self.at < len(self.items) else None

    def take(self):
        self.at += 1
        return self.items[self.at - 1]

    def whole(self) -> float:
        out = self.sums()
        if self.at < len(self.items):
            raise ValueError("more than an expression")
        return out

    def sums(self):
        out = self.products()
        while self.peek() in ("+", "-"):
            out = out + self.products() if self.take()[2] == "+" else out - self.products()
        return out

    def products(self):
        out = self.signed()
        while self.peek() in ("*", "/", "%"):
            op, right = self.take()[2], self.signed()
            out = out * right if op == "*" else out / right if op == "/" else math.fmod(out, right)
        return out

    def signed(self):
        if self.peek() in ("+", "-"):
            return self.signed() if self.take()[2] == "+" else -self.signed()
        out = self.atom()
        if self.peek() == "^":
            self.take()
            return out ** self.signed()
        return out

    def atom(self):
        number, name, sign = self.take()
        if number:
            return float(number)
        if name:
            if name in FUNCTIONS and self.peek() == "(":
                return FUNCTIONS[name](self.atom())
            return {**CONSTANTS, **self.values}[name]
        if sign == "(":
            out = self.sums()
            if self.take()[2] != ")":
                raise ValueError("an open bracket")
            return out
        raise ValueError("no value")


def evaluate(text: str | None, values: dict[str, float] | None = None) -> float | None:
    """The value of an expression; None for anything that is none, has unknown names or no finite value."""
    try:
        out = Parser(text or "", values or {}).whole()
        return float(out) if isinstance(out, (int, float)) and math.isfinite(out) else None
    except (ValueError, KeyError, IndexError, ZeroDivisionError, OverflowError, RecursionError, TypeError):
        return None


def expression_values(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, value: in Arrow batches, as a grammar is no built-in; nothing is ever run as code."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([evaluate(t) for t in b.column(1).to_pylist()], pa.float64())], names=[key, "value"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, value double")


WORDS = {"and": "&", "or": "|", "not": "!", "xor": "^", "→": ">", "->": ">", "iff": "=", "<->": "=", "∧": "&", "∨": "|", "¬": "!", "&&": "&", "||": "|"}


def evaluate_bool(text: str, values: dict[str, bool]) -> bool | None:
    """not, and, xor, or, implies (to the right), iff, from tight to loose; None for anything else."""
    items = [WORDS.get(w.lower(), w) for w in re.findall(r"<->|->|&&|\|\||[A-Za-z]\w*|\S", text)]
    at = 0

    def level(k):
        nonlocal at
        if k == 5:
            if at >= len(items):
                raise ValueError
            item, at = items[at], at + 1
            if item == "!":
                return not level(5)
            if item == "(":
                out = level(0)
                if at >= len(items) or items[at] != ")":
                    raise ValueError
                at += 1
                return out
            return values[item]
        left = level(k + 1)
        while at < len(items) and items[at] == "=>|^&"[k]:
            at += 1
            right = level(k) if k == 1 else level(k + 1)
            left = [left == right, (not left) or right, left or right, left != right, left and right][k]
        return left

    try:
        out = level(0)
        return out if at == len(items) else None
    except (KeyError, ValueError, IndexError, RecursionError):
        return None


def compound(principal: Column, percent: Column, years: Column) -> Column:
    return F.round(principal * F.pow(1 + percent / 100, years), 6)


def quadratic(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """The real roots, smaller first; null without one.  A root of zero has no sign."""
    d = b * b - 4 * a * c
    root = F.when((d >= 0) & (a != 0), F.sqrt(d))
    one, other = (-b - root) / (2 * a), (-b + root) / (2 * a)
    return F.round(F.least(one, other), 6) + F.lit(0.0), F.round(F.greatest(one, other), 6) + F.lit(0.0)


def polygon_angle(sides: Column) -> Column:
    """The inner angle of a regular polygon of 3 to 12 sides."""
    n = F.greatest(F.lit(3), F.least(F.lit(12), sides))
    return F.round((n - 2) * 180.0 / n, 6)


def punnett(crosses: DataFrame) -> DataFrame:
    """id, genotype, n: the four offspring of two one-gene parents, large letters first."""
    cells = F.flatten(F.transform(F.split("mother", ""), lambda x: F.transform(F.split("father", ""), lambda y: F.array_join(F.array_sort(F.array(x, y)), ""))))
    return crosses.select("id", F.explode(cells).alias("genotype")).groupBy("id", "genotype").agg(F.count("*").alias("n"))


def search_trace(rows: DataFrame) -> DataFrame:
    """id, probes: the places that a binary search for `target` in 0 .. size - 1 looks at."""
    kind = "struct<lo:bigint,hi:bigint,seen:array<bigint>>"
    start = F.struct(F.lit(0).alias("lo"), (F.col("size") - 1).alias("hi"), F.array().alias("seen")).cast(kind)

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2)
        over = s["lo"] > s["hi"]
        found = F.struct((mid + F.when(mid == F.col("target"), F.col("size")).otherwise(1)).alias("lo"), s["hi"].alias("hi"), F.concat(s["seen"], F.array(mid)).alias("seen"))
        left = F.struct(s["lo"].alias("lo"), (mid - 1).alias("hi"), F.concat(s["seen"], F.array(mid)).alias("seen"))
        return F.when(over, s).when(mid <= F.col("target"), found.cast(kind)).otherwise(left.cast(kind))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.col("size").cast("double") + 1)).cast("int") + 1)
    return rows.select("id", F.array_join(F.aggregate(steps, start, step)["seen"].cast("array<string>"), ",").alias("probes"))
