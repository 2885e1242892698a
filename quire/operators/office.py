"""Paragraph streams of word-processor files: heading levels and page segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import patterns as P
from quire.functions.text import strip
from quire.functions.titles import clean_office_heading, style_level


def segment_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Mark headings and number the page each paragraph belongs to.

    ``paragraphs(book_id, idx, style, text)``. A heading is a styled paragraph, a chapter or section
    line of at most 45 characters, or a ``一、`` line of 2 to 40 characters. The first occurrence of
    a heading text opens a page; later ones are plain text.
    """
    body = paragraphs.withColumn("text", strip(F.col("text"))).filter("text <> ''")
    text = F.col("text")
    number = F.regexp_extract(text, f"第[{P.SPACE}]*([{P.NUM}]+)", 1)
    styled = style_level(F.col("style"))
    chapter = text.rlike(P.CHAPTER) & (F.length(text) <= 45)
    section = text.rlike(P.SECTION) & (F.length(text) <= 45)
    listed = text.rlike("^[一二三四五六七八九十]+、") & F.length(text).between(2, 40)
    kind = (
        F.when(styled.isNotNull(), "styled").when(chapter, "chapter").when(section, "section").when(listed, "listed")
    )
    title = (
        F.when(F.col("kind") == "chapter",
               F.concat(F.lit("第"), number, F.lit("章 "), clean_office_heading(F.regexp_extract(text, P.CHAPTER, 2))))
        .when(F.col("kind") == "section",
              F.concat(F.lit("第"), number, F.lit("节 "), clean_office_heading(F.regexp_extract(text, P.SECTION, 2))))
        .when(F.col("kind").isNotNull(), text)
    )
    ordered = Window.partitionBy("book_id").orderBy("idx")
    marked = body.withColumn("styled", styled).withColumn("kind", kind).withColumn("heading", title)
    # A styled heading says whether it opened a chapter, a chapter line always does.
    opens = F.when(F.col("kind") == "styled", F.col("styled") == 1).when(F.col("kind") == "chapter", F.lit(True))
    after_chapter = F.coalesce(
        F.last(opens, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)
    )
    level = (
        F.when(F.col("kind") == "styled", F.col("styled"))
        .when(F.col("kind") == "chapter", 1)
        .when(F.col("kind") == "section", 2)
        .when(F.col("kind") == "listed", F.when(after_chapter, 2).otherwise(1))
    )
    first = F.row_number().over(Window.partitionBy("book_id", "heading").orderBy("idx")) == 1
    flagged = marked.withColumn("level", level).withColumn("opens", F.col("heading").isNotNull() & first)
    # Text before the first heading is a page of its own.
    leading = F.first(~F.col("opens")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    running = F.sum(F.col("opens").cast("bigint")).over(ordered)
    return flagged.withColumn("page", running + leading.cast("bigint")).withColumn(
        "toc_page", F.when(F.col("opens"), running)
    ).select(
        "book_id", "idx", "page", "text",
        F.when(F.col("opens"), F.col("level")).cast("bigint").alias("level"),
        F.when(F.col("opens"), clean_office_heading(F.col("heading"))).alias("title"),
        "toc_page",
    )


def office_toc(segmented: DataFrame) -> DataFrame:
    """Headings of the segmented paragraphs; fewer than two are none."""
    found = segmented.filter("title is not null")
    n = F.count("*").over(Window.partitionBy("book_id"))
    return found.withColumn("n", n).filter("n >= 2").select(
        "book_id", F.col("idx").alias("seq"), "title", "level", F.col("toc_page").alias("page")
    )


def office_pages(segmented: DataFrame) -> DataFrame:
    """Page texts, paragraphs joined by blank lines."""
    pairs = F.sort_array(F.collect_list(F.struct("idx", "text")))
    return segmented.groupBy("book_id", "page").agg(
        F.array_join(F.transform(pairs, lambda p: p["text"]), "\n\n").alias("text")
    )
