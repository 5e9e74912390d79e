"""Boolean expressions by masks against a tree evaluator and against Python's own operators."""

import itertools
import random
import re

from foliant.operators import logic, mathx


def test_against_the_evaluator_of_single_rows():
    rng = random.Random(7)

    def make(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice("pqrs")
        k = rng.randrange(7)
        return f"not {make(depth - 1)}" if k == 0 else f"({make(depth - 1)})" if k == 1 else f"{make(depth - 1)} {rng.choice(('and', 'or', 'xor', '->', 'iff', '&&', '||'))} {make(depth - 1)}"

    for _ in range(400):
        text = make(4)
        code = logic.postfix(text)
        names = sorted({c[1:] for c in code if c[0] == "$"})
        bits = logic.worked_out(code, names)
        for row, values in enumerate(itertools.product((False, True), repeat=len(names))):
            assert bool(bits >> row & 1) == mathx.evaluate_bool(text, dict(zip(names, values))), text


def test_what_is_no_expression():
    for text in (None, "", "p q", "p and", "and p", "(p", "p)", "()", "p not q", "p @ q", "3", "p nand q", "not", "p -> -> q"):
        assert logic.postfix(text) is None, text
    assert logic.postfix("p → q → r") == ["$p", "$q", "$r", "implies", "implies"] and logic.postfix("¬p ∧ q") == ["$p", "not", "$q", "and"]


def test_tables(spark):
    rows = [(1, "p and q"), (2, "p or not p"), (3, "p & ~p"), (4, "a b"), (5, None), (6, " or ".join("abcdefg"))]
    tables = logic.truth_tables(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = {r.id: r for r in tables.collect()}
    assert got[1].names == ["p", "q"] and got[1].rows == [False, False, False, True] and all(got[k].rows is None for k in (4, 5, 6))
    assert {r.id: r.kind for r in logic.kinds(tables, "id").collect()} == {1: "1", 2: "always", 3: "never"}
    assert [(r.row, r.values, r.holds) for r in logic.table_rows(tables, "id").filter("id = 1").orderBy("row").collect()] == [(0, "00", False), (1, "01", False), (2, "10", False), (3, "11", True)]
    assert re.fullmatch("[01]+", logic.table_rows(tables, "id").first()["values"])
