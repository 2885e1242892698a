"""Layout analysis over positioned text blocks.

Input ``blocks(book_id, page, block_no, text, size, flags, y0, y1, page_height)``. Every aggregate
combines before its shuffle; the tables joined back hold a few rows per book, and whether they are
broadcast is left to the planner's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import strip


def body_font_size(spans: DataFrame, books: DataFrame) -> DataFrame:
    """Most frequent font size of each book; the smaller one wins a tie."""
    sizes = (
        spans.filter("size > 0")
        .groupBy("book_id", F.round("size", 1).alias("size"))
        .agg(F.count("*").alias("n"))
        .groupBy("book_id")
        .agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body_size"))
    )
    return books.select("book_id").join(sizes, "book_id", "left").select(
        "book_id", F.coalesce("body_size", F.lit(P.DEFAULT_BODY_SIZE)).alias("body_size")
    )


def _at_top() -> Column:
    return F.col("y0") < F.col("page_height") * P.HEADER_SHARE


def _at_bottom() -> Column:
    return F.col("y1") > F.col("page_height") * (1 - P.FOOTER_SHARE)


def classify_blocks(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Role of each block on its own page: header, footer, formula, title or body."""
    chars = F.length("text")
    symbols = chars - F.length(F.translate("text", P.MATH_CHARS, ""))
    bold = F.col("flags").bitwiseAND(16) > 0
    title = (F.col("size") >= F.col("body_size") * P.TITLE_RATIO) | (
        bold & (chars <= P.BOLD_TITLE_CHARS) & (F.col("size") >= F.col("body_size") * P.BOLD_TITLE_RATIO)
    )
    role = (
        F.when(_at_top(), "header")
        .when(_at_bottom(), "footer")
        .when(symbols / F.greatest(chars, F.lit(1)) > P.FORMULA_SHARE, "formula")
        .when(title, "title")
        .otherwise("body")
    )
    return blocks.join(sizes, "book_id").withColumn("role", role)


def running_lines(blocks: DataFrame) -> DataFrame:
    """Texts that recur on at least three pages of a book, nearly always at one edge."""
    counted = (
        blocks.filter(F.length("text") <= 60)
        .groupBy("book_id", "text", "page")
        .agg(
            F.count("*").alias("n"),
            F.sum(_at_top().cast("long")).alias("top"),
            F.sum(_at_bottom().cast("long")).alias("bottom"),
        )
        .groupBy("book_id", "text")
        .agg(
            F.count("*").alias("n_pages"),
            F.sum("n").alias("n"),
            F.sum("top").alias("top"),
            F.sum("bottom").alias("bottom"),
        )
        .filter("n_pages >= 3")
    )
    role = F.when(F.col("top") >= 0.8 * F.col("n"), "header").when(F.col("bottom") >= 0.8 * F.col("n"), "footer")
    return counted.select("book_id", "text", "n_pages", role.alias("running_role")).filter("running_role is not null")


def final_roles(classified: DataFrame, running: DataFrame) -> DataFrame:
    """Roles after the running headers and footers have overruled the per-page ones."""
    return (
        classified.join(running.select("book_id", "text", "running_role"), ["book_id", "text"], "left")
        .withColumn("role", F.coalesce("running_role", "role"))
        .drop("running_role")
    )


def title_lines(roles: DataFrame) -> DataFrame:
    return roles.filter("role = 'title'").select("book_id", "text").distinct()


def clean_page_text(roles: DataFrame) -> DataFrame:
    """Page text without header and footer blocks; one group is one page."""
    kept = roles.filter("role not in ('header', 'footer')")
    return kept.groupBy("book_id", "page").agg(
        strip(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]), "\n"
            )
        ).alias("text")
    )


def layout_statistics(sizes: DataFrame, running: DataFrame) -> DataFrame:
    counts = running.groupBy("book_id").agg(
        F.count_if(F.col("running_role") == "header").alias("header_count"),
        F.count_if(F.col("running_role") == "footer").alias("footer_count"),
    )
    return sizes.join(counts, "book_id", "left").select(
        "book_id",
        "body_size",
        F.coalesce("header_count", F.lit(0)).alias("header_count"),
        F.coalesce("footer_count", F.lit(0)).alias("footer_count"),
    )
