"""Quiz grading, mastery and activity.

The latest attempt of a quiz is an aggregate (``max_by``), not a window: it combines before the
shuffle, so a quiz with a third of all attempts costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.numbers import round_half_even
from quire.functions.text import strip
from quire.operators.ranking import running_totals

REVIEW_FIRST = "优先复习"
KEEP_GOING = "保持"


def grade(answers: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Choice and blank answers by trimmed, case-free equality; short ones wait for self-grading."""
    known = quizzes.select("quiz_id", "q_type", "answer")
    short = ~F.col("q_type").isin("choice", "blank")
    equal = F.upper(strip(F.col("user_answer"))) == F.upper(strip(F.col("answer")))
    return answers.join(known, "quiz_id").select(
        "attempt_id", "quiz_id",
        F.when(short, 0).otherwise(equal.cast("int")).cast("bigint").alias("is_correct"),
        short.cast("bigint").alias("is_self_graded"),
    )


def running_correct_rate(attempts: DataFrame) -> DataFrame:
    """Share of correct attempts of the quiz after each attempt, summed hour by hour."""
    totals = running_totals(
        attempts, "quiz_id", F.date_trunc("hour", F.col("answered_at")), ["answered_at", "attempt_id"],
        {"correct": F.col("is_correct"), "total": F.lit(1)},
    )
    return totals.select("attempt_id", "quiz_id", round_half_even(F.col("correct") / F.col("total"), 2).alias("correct_rate"))


def latest_attempts(attempts: DataFrame) -> DataFrame:
    order = F.struct("answered_at", "attempt_id")
    return attempts.groupBy("quiz_id").agg(
        F.max_by("is_correct", order).alias("is_correct"), F.max("answered_at").alias("answered_at"),
        F.max_by("attempt_id", order).alias("attempt_id"),
    )


def page_of(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of an ordered listing."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def listing(quizzes: DataFrame, books: DataFrame, chapters: DataFrame, page: int, size: int) -> DataFrame:
    """One page of quizzes with titles, parsed options and the total count."""
    total = quizzes.agg(F.count("*").alias("n")).select("n").scalar()
    return (
        page_of(quizzes, ["quiz_id"], page, size)
        .join(books.select("book_id", F.col("title").alias("book_title")), "book_id", "left")
        .join(chapters.select("chapter_id", F.col("title").alias("chapter_title")), "chapter_id", "left")
        .select(
            "quiz_id", "q_type", "question", F.from_json("options_json", "array<string>").alias("options"),
            F.coalesce("book_title", F.lit("")).alias("book_title"), "chapter_title", total.alias("total"),
        )
    )


def quiz_filter(quizzes: DataFrame, book_id=None, chapter_id=None, q_type=None) -> DataFrame:
    for name, value in (("book_id", book_id), ("chapter_id", chapter_id), ("q_type", q_type)):
        if value is not None:
            quizzes = quizzes.filter(F.col(name) == value)
    return quizzes


def wrong_quizzes(quizzes: DataFrame, attempts: DataFrame) -> DataFrame:
    """Quizzes whose latest attempt is wrong."""
    wrong = latest_attempts(attempts).filter("is_correct = 0").select("quiz_id")
    return quizzes.join(wrong, "quiz_id", "left_semi")


def chapter_wrong_rates(quizzes: DataFrame, attempts: DataFrame) -> DataFrame:
    latest = latest_attempts(attempts)
    return (
        latest.join(quizzes.select("quiz_id", "chapter_id"), "quiz_id")
        .groupBy("chapter_id")
        .agg(round_half_even(F.avg(1 - F.col("is_correct")), 3).alias("wrong_rate"))
    )


def chapter_mastery(chapters: DataFrame, quizzes: DataFrame, attempts: DataFrame) -> DataFrame:
    """1 − wrong rate for chapters with quizzes (also without attempts), 0 for others."""
    counts = quizzes.groupBy("chapter_id").agg(F.count("*").alias("quizzes"))
    rate = F.coalesce("wrong_rate", F.lit(0.0))
    return (
        chapters.join(counts, "chapter_id", "left")
        .join(chapter_wrong_rates(quizzes, attempts), "chapter_id", "left")
        .select(
            "book_id", "chapter_id", "title", "order_index",
            F.coalesce("quizzes", F.lit(0)).alias("quizzes"),
            rate.alias("wrong_rate"),
            F.when(F.col("quizzes").isNotNull(), round_half_even(1 - rate, 3)).otherwise(F.lit(0.0)).alias("mastery"),
        )
    )


def study_streak(attempts: DataFrame, as_of: Column) -> DataFrame:
    """Consecutive days with attempts that end on ``as_of``; 0 without attempts on that day.

    The window runs over distinct calendar days.
    """
    days = attempts.select(F.to_date("answered_at").alias("d")).filter(F.col("d") <= as_of).distinct()
    rank = F.row_number().over(Window.orderBy(F.desc("d")))
    return days.withColumn("rank", rank).agg(
        F.count_if(F.datediff(as_of, F.col("d")) == F.col("rank") - 1).alias("streak_days")
    )


def overview(books: DataFrame, chapters: DataFrame, quizzes: DataFrame, attempts: DataFrame, as_of: Column) -> DataFrame:
    """Counts, mastery weighted by quiz counts and the current streak, as one row."""
    mastery = chapter_mastery(chapters, quizzes, attempts)
    weighted = F.sum(F.col("mastery") * F.col("quizzes")) / F.sum("quizzes")
    return mastery.agg(round_half_even(F.coalesce(weighted, F.lit(0.0)), 3).alias("avg_mastery")).select(
        books.agg(F.count("*").alias("n")).scalar().alias("book_count"),
        quizzes.agg(F.count("*").alias("n")).scalar().alias("quiz_count"),
        attempts.agg(F.count("*").alias("n")).scalar().alias("attempts_total"),
        "avg_mastery",
        study_streak(attempts, as_of).scalar().alias("streak_days"),
    )


def activity_calendar(attempts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Attempts per day for ``days`` days up to ``as_of``, zero-filled."""
    spark = attempts.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(as_of, days), as_of)).alias("date"))
    counted = attempts.groupBy(F.to_date("answered_at").alias("date")).agg(F.count("*").alias("attempts"))
    return calendar.join(counted, "date", "left").select("date", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def weakness_ranking(mastery: DataFrame, books: DataFrame, limit: int = 10) -> DataFrame:
    """The chapters with quizzes and the lowest mastery."""
    return (
        mastery.filter("quizzes > 0 or wrong_rate <> 0")
        .orderBy("mastery", "chapter_id")
        .limit(limit)
        .join(books.select("book_id", F.col("title").alias("book_title")), "book_id", "left")
        .select(
            "book_id", F.coalesce("book_title", F.lit("")).alias("book_title"), "chapter_id",
            F.col("title").alias("chapter_title"), "mastery",
            F.when(F.col("mastery") < 0.5, REVIEW_FIRST).otherwise(KEEP_GOING).alias("suggest"),
        )
    )


def import_quizzes(incoming: DataFrame, chapters: DataFrame) -> DataFrame:
    """Incoming quizzes with the book of their chapter; without a known chapter they are rejected."""
    known = chapters.select("chapter_id", F.col("book_id").alias("its_book"))
    return incoming.drop("book_id").join(known, "chapter_id", "left").withColumnRenamed("its_book", "book_id").withColumn(
        "accepted", F.col("book_id").isNotNull()
    )


def quiz_context(chapters: DataFrame, chunks: DataFrame, summaries: DataFrame, limit: int = 4000) -> DataFrame:
    """Material for writing quizzes: the first four chunks, shortened when there is a summary.

    ``summaries(chapter_id, summary)``.
    """
    rank = F.row_number().over(Window.partitionBy("chapter_id").orderBy("chunk_index"))
    first = chunks.filter("chapter_id is not null").withColumn("rank", rank).filter(F.col("rank") <= 4)
    pairs = F.sort_array(F.collect_list(F.struct("rank", F.substring("content", 1, 600).alias("t"))))
    raw = first.groupBy("chapter_id").agg(
        F.substring(F.array_join(F.transform(pairs, lambda p: p["t"]), "\n\n"), 1, limit).alias("raw")
    )
    text = F.coalesce("raw", F.lit(""))
    with_summary = F.concat(
        F.lit("【章节总结】\n"), F.substring("summary", 1, 2000), F.lit("\n\n【原文片段】\n"), F.substring(text, 1, 2000)
    )
    return chapters.join(raw, "chapter_id", "left").join(summaries, "chapter_id", "left").select(
        "chapter_id", F.when(F.coalesce("summary", F.lit("")) != "", with_summary).otherwise(text).alias("context")
    )
