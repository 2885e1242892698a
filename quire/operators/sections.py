"""Section texts, Markdown assembly and structured documents from chapter trees.

Groups here are one section, one chapter or one book; a book is bounded by the size check of its
source file (see ``sources.files``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import strip
from quire.functions.titles import downgrade_headings

NO_TEXT = "（该章无正文内容）"


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, glue: str, name: str = "text") -> DataFrame:
    """Join the texts of a group in order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["t"]), glue).alias(name))


def section_texts(chunks: DataFrame, toc: DataFrame) -> DataFrame:
    """Text of each heading: the chunks from its page up to the next heading.

    The last heading of a page wins; a chunk already contained in the section is not repeated.
    The headings are looked up by an ordered pass over the pages of the book.
    """
    heads = toc.groupBy("book_id", "page").agg(F.max_by("title", F.struct("level", "seq")).alias("title"))
    marks = heads.select("book_id", "page", F.lit(-1).cast("bigint").alias("chunk_index"), "title",
                         F.lit(None).cast("string").alias("content"))
    rows = marks.unionByName(
        chunks.select("book_id", F.coalesce("page_start", F.lit(1)).alias("page"), "chunk_index",
                      F.lit(None).cast("string").alias("title"), "content")
    )
    ordered = Window.partitionBy("book_id").orderBy("page", "chunk_index")
    # A heading takes effect on its own page, so it is placed before the chunks of that page.
    owned = rows.withColumn(
        "title", F.last("title", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ).filter("content is not null and title is not null")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"])

    def add(acc, piece):
        bare = strip(piece)
        return F.when((bare != "") & ~F.contains(acc, bare), strip(F.concat(acc, F.lit("\n\n"), piece))).otherwise(acc)

    return owned.groupBy("book_id", "title").agg(F.aggregate(pieces, F.lit(""), add).alias("text"))


def markdown_books(books: DataFrame, toc: DataFrame, summaries: DataFrame, sections: DataFrame) -> DataFrame:
    """Markdown of each book: title, outline, then each heading with its summary and text.

    ``toc`` is in page order, which is also the order of a walk through the heading tree.
    """
    items = (
        toc.join(summaries, ["book_id", "title"], "left")
        .join(sections.withColumnRenamed("text", "body"), ["book_id", "title"], "left")
    )
    chapter = F.col("level") == 1
    has_summary = chapter & F.col("summary").isNotNull() & (F.col("summary") != "") & (F.col("summary") != NO_TEXT)
    lines = F.concat_ws(
        "\n",
        F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.col("level") + 2).cast("int")), F.lit(" "), F.col("title")),
        F.lit(""),
        F.when(
            has_summary,
            F.concat_ws(
                "\n", F.lit("<details>"), F.lit("<summary>💡 AI 精读总结（点击展开/收起）</summary>"), F.lit(""),
                downgrade_headings(F.col("summary")), F.lit(""), F.lit("</details>"), F.lit(""), F.lit("---"), F.lit(""),
            ),
        ),
        F.when(
            F.coalesce(F.col("body"), F.lit("")) != "",
            F.concat_ws("\n", F.when(chapter, F.lit("### 📄 章节原文\n")), F.col("body"), F.lit("")),
        ),
    )
    outline = F.concat(F.repeat(F.lit("  "), (F.col("level") - 1).cast("int")), F.lit("- "), F.col("title"))
    parts = items.select("book_id", "seq", outline.alias("outline"), lines.alias("lines"))
    grouped = parts.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("seq", "outline", "lines"))).alias("a"))
    head = F.concat(
        F.lit("# 《"), F.col("title"), F.lit("》\n\n> 由标题目录、精读总结与正文生成\n\n## 📑 目录\n")
    )
    return books.join(grouped, "book_id").select(
        "book_id",
        F.concat(
            head,
            F.array_join(F.transform("a", lambda x: x["outline"]), "\n"),
            F.lit("\n\n"),
            F.array_join(F.transform("a", lambda x: x["lines"]), "\n"),
        ).alias("markdown"),
    )


def structured_document(chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chapters with the text of their own chunks, joined by blank lines."""
    texts = ordered_text(chunks.filter("chapter_id is not null"), ["chapter_id"], "chunk_index", "content", "\n\n")
    return chapters.join(texts, "chapter_id", "left").select(
        "book_id", "chapter_id", "parent_id", "title", "level", "order_index", F.coalesce("text", F.lit("")).alias("text")
    )
