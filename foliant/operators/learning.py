"""Progress, spaced repetition, due lists and totals of learners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality(accuracy: Column) -> Column:
    """5 from 90, 4 from 75, 3 from 60, 2 from 40, else 1."""
    return F.when(accuracy >= 90, 5).when(accuracy >= 75, 4).when(accuracy >= 60, 3).when(accuracy >= 40, 2).otherwise(1)


def schedule(reviews: DataFrame, keys: list[str], ease: float = 2.5) -> DataFrame:
    """keys, ease, interval (days), reps after all reviews (seq, accuracy), in order.

    From quality 3 on: one more repetition, after 1 day, 6 days, then the last interval times the ease so far, rounded;
    the ease moves by 0.1 - (5 - q)(0.08 + 0.02 (5 - q)), not below 1.3.  Below 3: no repetitions, 1 day, same ease.
    """
    kind = "struct<ease:double,gap:bigint,reps:bigint>"
    start = F.struct(F.lit(ease).alias("ease"), F.lit(0).alias("gap"), F.lit(0).alias("reps")).cast(kind)

    def step(s, r):
        q = quality(r["accuracy"])
        gap = F.when(s["reps"] == 0, 1).when(s["reps"] == 1, 6).otherwise(F.floor(s["gap"] * s["ease"] + 0.5))
        moved = F.greatest(F.lit(1.3), s["ease"] + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
        good = F.struct(moved.alias("ease"), gap.cast("long").alias("gap"), (s["reps"] + 1).alias("reps"))
        bad = F.struct(s["ease"].alias("ease"), F.lit(1).cast("long").alias("gap"), F.lit(0).cast("long").alias("reps"))
        return F.when(q >= 3, good.cast(kind)).otherwise(bad.cast(kind))

    state = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "accuracy"))), start, step)
    return reviews.groupBy(*keys).agg(state.alias("s")).select(*keys, F.round("s.ease", 6).alias("ease"), F.col("s.gap").alias("interval"), F.col("s.reps").alias("reps"))


def due(progress: DataFrame, now: Column) -> DataFrame:
    """Completed lessons that are there and due; without a schedule nothing is due."""
    return progress.filter(F.col("completed") & F.col("has_lesson") & (F.col("due_at") <= now))


def practice(progress: DataFrame) -> DataFrame:
    return progress.filter("completed")


def warm_up(progress: DataFrame, index: int, now: Column) -> DataFrame:
    """user_id and the earlier completed lesson that is most overdue; one without a schedule is due now."""
    rows = progress.filter(F.col("completed") & F.col("has_lesson") & (F.col("idx") < index))
    return rows.groupBy("user_id").agg(F.min_by("idx", F.struct(F.coalesce("due_at", now), "idx")).alias("idx"))


def nudged(due_at: Column, now: Column) -> Column:
    """A due date not later than a day from now."""
    return F.least(due_at, now + F.expr("INTERVAL 1 DAY"))


def calibration(progress: DataFrame) -> DataFrame:
    """user_id and a note: harder above a mean of 90, slower below 60, for two completed lessons or more."""
    rows = progress.filter("completed").groupBy("user_id").agg(F.avg("accuracy").alias("mean"), F.count("*").alias("n")).filter("n >= 2")
    return rows.select("user_id", F.when(F.col("mean") > 90, "harder").when(F.col("mean") < 60, "slower").otherwise("none").alias("note"))


def course_progress(progress: DataFrame) -> DataFrame:
    """user_id, pct: completed lessons of all, in whole percent."""
    return progress.groupBy("user_id").agg(F.round(F.coalesce(F.try_divide(100.0 * F.count_if("completed"), F.count("*").cast("double")), F.lit(0.0))).cast("long").alias("pct"))


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    """1 a million tokens read, 5 a million written."""
    return F.round(tokens_in / 1e6 + 5 * tokens_out / 1e6, 6)


def interleaved(cards: DataFrame, quizzes: DataFrame) -> DataFrame:
    """lesson, place, kind, n: cards with quiz questions after the first ones: min(cards - 1, half of the questions)."""
    counts = cards.groupBy("lesson").agg(F.count("*").alias("c")).join(quizzes.groupBy("lesson").agg(F.count("*").alias("q")), "lesson", "left").fillna(0, ["q"])
    moved = counts.select("lesson", F.when((F.col("c") > 1) & (F.col("q") > 1), F.least(F.col("c") - 1, F.floor(F.col("q") / 2))).otherwise(0).cast("long").alias("moved"))
    a = cards.select("lesson", F.lit("card").alias("kind"), "n", (2.0 * F.col("n")).alias("key"))
    b = quizzes.join(moved, "lesson").select("lesson", F.lit("quiz").alias("kind"), "n", F.when(F.col("n") < F.col("moved"), 2.0 * F.col("n") + 1).otherwise(1e9 + F.col("n")).alias("key"))
    from pyspark.sql import Window

    return a.unionByName(b).withColumn("place", F.row_number().over(Window.partitionBy("lesson").orderBy("key")).cast("long")).select("lesson", "place", "kind", "n")


def streaks(rows: DataFrame) -> DataFrame:
    """user_id, streak: of the newest row; of several, the highest."""
    return rows.groupBy("user_id").agg(F.max_by("streak", F.struct("seen", "streak")).alias("streak"))
