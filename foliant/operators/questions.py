"""Questions as a model writes them (JSON), made whole or dropped; numbers as templates take and show them.

Everything is read through variants, so that a value of another form than it should have is a missing one, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .growing import drawable

#: The shapes that a question can point into, with their sides, and the parts that a target can name.
SIDES = {"triangle": 3, "right-triangle": 3, "square": 4, "rectangle": 4, "parallelogram": 4, "trapezoid": 4, "pentagon": 5, "hexagon": 6}
PARTS = ("side", "vertex", "angle")
LEAST_OPTIONS = 2


def number(v: Column, path: str) -> Column:
    """The number at `path`; texts are none."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(~F.schema_of_variant(part).isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(part, "$", "double"))


def text(v: Column, path: str) -> Column:
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(part, "$", "string"))


def reasons(v: Column, options: Column) -> Column:
    """A reason for each option: missing ones empty, further ones dropped, and none from what is no list."""
    given = F.coalesce(F.try_variant_get(v, "$.whyWrong", "array<string>"), F.array().cast("array<string>"))
    said = F.transform(given, lambda x: F.coalesce(x, F.lit("")))
    return F.slice(F.concat(said, F.array_repeat(F.lit(""), F.size(options))), F.lit(1), F.size(options))


def target_is_there(v: Column) -> Column:
    """Whether a target such as side:2 names a part of the shape that the question shows."""
    aim = text(v, "$.target")
    sides = F.create_map(*(F.lit(x) for pair in SIDES.items() for x in pair))[F.coalesce(text(v, "$.visual.shape"), F.lit(""))]
    at = F.regexp_extract(aim, rf"^({'|'.join(PARTS)}):([0-9]{{1,2}})$", 2)
    return F.coalesce((text(v, "$.visual.type") == "shape") & (at != "") & (at.try_cast("int") < sides), F.lit(False))


KIND = "struct<type:string,text:string,options:array<string>,correct:int,why:array<string>,answer:double,tolerance:double,unit:string,target:string,visual:string>"


def question(json: Column) -> Column:
    """A question of KIND, or null where it cannot be asked.

    Without a type it is a choice.  A choice has two options or more, and its right one among them (the first, if none is
    named); a numeric question has a number, and a tolerance without its sign; a hotspot's target is a part of its shape.
    Any may carry a figure; one that cannot be drawn is dropped and the question stays.
    """
    v = F.try_parse_json(json)
    kind = F.coalesce(text(v, "$.type"), F.lit("choice"))
    options = F.filter(F.coalesce(F.try_variant_get(v, "$.options", "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    correct = F.coalesce(number(v, "$.correct").cast("int"), F.lit(0))
    figure = F.try_variant_get(v, "$.visual", "variant")
    shown = F.when((text(v, "$.visual.type") == "shape") & F.coalesce(text(v, "$.visual.shape"), F.lit("")).isin(*SIDES) | drawable(figure), F.to_json(figure))
    none = {"options": F.lit(None), "correct": F.lit(None), "why": F.lit(None), "answer": F.lit(None), "tolerance": F.lit(None), "unit": F.lit(None), "target": F.lit(None)}

    def made(**own):
        return F.struct(kind.alias("type"), F.trim(text(v, "$.text")).alias("text"), *(own.get(k, c).alias(k) for k, c in none.items()), shown.alias("visual")).cast(KIND)

    asked = F.coalesce(F.trim(text(v, "$.text")) != "", F.lit(False))
    return (
        F.when(~asked, None).when((kind == "choice") & (F.size(options) >= LEAST_OPTIONS) & correct.between(0, F.size(options) - 1), made(options=options, correct=correct, why=reasons(v, options)))
        .when((kind == "numeric") & number(v, "$.answer").isNotNull(), made(answer=number(v, "$.answer"), tolerance=F.abs(F.coalesce(number(v, "$.tolerance"), F.lit(0.0))), unit=F.coalesce(text(v, "$.unit"), F.lit(""))))
        .when((kind == "hotspot") & target_is_there(v), made(target=text(v, "$.target")))
    )


def graded(questions: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """key, good: answers (key, answer) to questions (key, q): the right option by its number, a number within the
    tolerance, the named part."""
    from .mathx import learner_number

    q, a = F.col("q"), F.trim("answer")
    near = F.abs(learner_number(a) - q["answer"]) <= q["tolerance"]
    good = F.when(q["type"] == "choice", a.try_cast("int") == q["correct"]).when(q["type"] == "numeric", near).when(q["type"] == "hotspot", a == q["target"])
    return questions.filter(q.isNotNull()).join(answers, key).select(key, F.coalesce(good, F.lit(False)).alias("good"))


def shown_number(x: Column) -> Column:
    """A number as a reader sees it: to six places, without the zeros behind."""
    plain = F.round(x.cast("double"), 6).cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(plain, r"\.?0+$", ""), "^-0$", "0")


def template_number(v: Column, path: str, default: float, least: float, most: float) -> Column:
    """The number that a template takes: what was given, within its bounds, else the default."""
    given = F.coalesce(number(v, path), text(v, path).try_cast("double"))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.when(~F.isnan(given), given), F.lit(default))))


def template_list(v: Column, path: str, most: int) -> Column:
    """The numbers of a list, at most so many; what is none is left out, and nothing is taken from what is no list."""
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    numbers = F.transform(items, lambda x: F.coalesce(number(x, "$"), text(x, "$").try_cast("double")))
    return F.slice(F.filter(numbers, lambda x: x.isNotNull() & ~F.isnan(x)), 1, most)
