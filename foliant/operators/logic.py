"""Boolean expressions over rows: compiled once to postfix, worked out for all rows of a truth table at a time.

A table of n names has 2^n rows, which count up from all false.  The values of a name in all rows are one mask of 2^n bits,
so an operator is one operation on masks; the result's bits are the rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: words and signs of the operators
SIGNS = {
    "not": "not", "¬": "not", "!": "not", "~": "not", "and": "and", "∧": "and", "&&": "and", "&": "and", "xor": "xor", "⊕": "xor", "or": "or", "∨": "or", "||": "or", "|": "or",
    "→": "implies", "->": "implies", "=>": "implies", "implies": "implies", "↔": "iff", "<->": "iff", "<=>": "iff", "iff": "iff", "(": "(", ")": ")",
}
#: From loose to tight; implication binds to the right.
TIGHTNESS = {"iff": 0, "implies": 1, "or": 2, "xor": 3, "and": 4, "not": 5}
ITEM = re.compile(r"<->|<=>|->|=>|&&|\|\||[A-Za-z]\w*|\S")
#: Names of an expression at most: its table has 2^n rows.
MOST_NAMES = 6


def postfix(text: str | None) -> list[str] | None:
    """Names and operators in the order in which a stack works them out; None for what is no expression."""
    out: list[str] = []
    held: list[str] = []
    value_next = True
    for word in ITEM.findall(text or ""):
        sign = SIGNS.get(word.lower())
        if sign == "not" or sign == "(":
            if not value_next:
                return None
            held.append(sign)
        elif sign == ")":
            if value_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif sign:
            if value_next:
                return None
            while held and held[-1] != "(" and (TIGHTNESS[held[-1]] > TIGHTNESS[sign] or held[-1] == sign != "implies"):
                out.append(held.pop())
            held.append(sign)
            value_next = True
        elif not re.fullmatch(r"[A-Za-z]\w*", word) or not value_next:
            return None
        else:
            out.append("$" + word)
            value_next = False
    if value_next or "(" in held:
        return None
    return out + held[::-1]


def masks(names: list[str]) -> dict[str, int]:
    """Each name's values in all rows as bits, row 0 the lowest; the first name changes slowest."""
    n = len(names)
    return {name: sum(1 << row for row in range(2**n) if row >> (n - 1 - k) & 1) for k, name in enumerate(names)}


def worked_out(code: list[str], names: list[str]) -> int:
    """The bits of the rows in which the compiled expression holds."""
    every, values, stack = (1 << 2 ** len(names)) - 1, masks(names), []
    for item in code:
        if item[0] == "$":
            stack.append(values[item[1:]])
        elif item == "not":
            stack.append(every ^ stack.pop())
        else:
            b, a = stack.pop(), stack.pop()
            stack.append({"and": a & b, "or": a | b, "xor": a ^ b, "implies": every ^ a | b, "iff": every ^ a ^ b}[item])
    return stack[0]


TABLE = "names array<string>, rows array<boolean>"


def truth_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, names, rows: each expression's names in alphabetical order and its value in all rows of their table; both are
    null for what is no expression or has over MOST_NAMES names.  In Arrow batches, as a grammar is no built-in; a batch
    compiles each different text once."""
    import pyarrow as pa

    def table(t: str | None):
        code = postfix(t)
        names = sorted({c[1:] for c in code if c[0] == "$"}) if code else []
        if not code or len(names) > MOST_NAMES:
            return None, None
        bits = worked_out(code, names)
        return names, [bool(bits >> row & 1) for row in range(2 ** len(names))]

    def run(batches):
        for b in batches:
            known: dict = {}
            found = [known[t] if t in known else known.setdefault(t, table(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.bool_()))], names=[key, "names", "rows"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {TABLE}")


def table_rows(tables: DataFrame, key: str) -> DataFrame:
    """key, row, values, holds: a row for each row of the tables; `values` are the names' values as a string of 0 and 1."""
    rows = tables.filter("rows IS NOT NULL").select(key, F.size("names").alias("_n"), F.posexplode("rows").alias("row", "holds"))
    bits = F.lpad(F.bin(F.col("row").cast("long")), F.col("_n"), F.lit("0"))
    return rows.select(key, F.col("row").cast("long").alias("row"), bits.alias("values"), "holds")


def kinds(tables: DataFrame, key: str) -> DataFrame:
    """key, kind: always, never, or the number of rows in which an expression holds."""
    held = F.size(F.filter("rows", lambda r: r))
    return tables.filter("rows IS NOT NULL").select(key, F.when(held == F.size("rows"), "always").when(held == 0, "never").otherwise(held.cast("string")).alias("kind"))
