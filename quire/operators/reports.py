"""Listings, digests, change detection and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.mastery import page_of
from quire.operators.sections import ordered_text


def library_listing(
    books: DataFrame, quizzes: DataFrame, chapters: DataFrame, deep: DataFrame, tasks: DataFrame, page: int, size: int
) -> DataFrame:
    """One page of books, newest first, with counts, analysis status and running imports.

    The page is cut first; the other tables are reduced to its books before they are counted.
    """
    total = books.agg(F.count("*").alias("n")).scalar()
    shown = page_of(books, [F.desc("created_at"), F.desc("book_id")], page, size)
    ids = shown.select("book_id")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.join(ids, "book_id", "left_semi").groupBy("book_id").agg(F.count("*").alias(name))

    running = tasks.filter(F.col("status").isin("pending", "running")).groupBy("book_id").agg(
        F.max_by("message", "task_id").alias("task_message")
    )
    return (
        shown.join(counted(quizzes, "quiz_count"), "book_id", "left")
        .join(counted(chapters, "chapter_count"), "book_id", "left")
        .join(deep.filter("status <> 'none'").select("book_id", F.col("status").alias("deep_status")), "book_id", "left")
        .join(running, "book_id", "left")
        .select(
            "book_id", "title", "file_type", "category", "total_pages",
            F.coalesce("quiz_count", F.lit(0)).alias("quiz_count"), F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"),
            F.coalesce("deep_status", F.lit("none")).alias("deep_status"), "task_message", total.alias("total"),
        )
    )


def book_digest(books: DataFrame, chapters: DataFrame, chunks: DataFrame, analysis: DataFrame, deep: DataFrame) -> DataFrame:
    """Chapters with a content flag, keywords, definitions, theorems and the analysis flag."""
    filled = chunks.select("chapter_id").distinct().withColumn("filled", F.lit(True))
    listed = chapters.join(filled, "chapter_id", "left").groupBy("book_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("order_index", "title", F.coalesce("filled", F.lit(False)).alias("has_content")))),
            lambda c: F.struct(c["title"].alias("title"), c["has_content"].alias("has_content")),
        ).alias("chapters")
    )
    ready = deep.filter("status = 'done' and markdown <> ''").select("book_id", F.lit(True).alias("has_deep"))
    return (
        books.join(listed, "book_id", "left")
        .join(analysis, "book_id", "left")
        .join(ready, "book_id", "left")
        .select(
            "book_id", "title", "category", "file_type", "total_pages", "chapters",
            F.slice("keywords", 1, 30).alias("keywords"), F.slice("definitions", 1, 15).alias("definitions"),
            F.slice("theorems", 1, 15).alias("theorems"), F.coalesce("has_deep", F.lit(False)).alias("has_deep_analysis"),
        )
    )


def picked_books(requests: DataFrame, books: int = 8) -> DataFrame:
    """``requests(request_id, book_id)``: the first books of each request, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("book_id"))
    return requests.withColumn("rank", rank).filter(F.col("rank") <= books)


def combined_digest(picked: DataFrame, digests: DataFrame, deep: DataFrame, per_book: int = 4000, limit: int = 25000) -> DataFrame:
    """The books of ``picked_books`` as one text per request. Digests of other books are not needed."""
    joined = picked.join(digests, "book_id").join(
        deep.filter("status = 'done' and markdown <> ''").select("book_id", "markdown"), "book_id", "left"
    )
    head = F.concat(F.lit("【文献《"), F.col("title"), F.lit("》】"))
    definitions = F.transform(
        F.slice("definitions", 1, 8), lambda d: F.concat(d["term"], F.lit("="), F.substring(d["definition"], 1, 60))
    )
    line = F.concat(
        head, F.lit("分类:"), F.coalesce("category", F.lit("")), F.lit(" 章节:"),
        F.array_join(F.transform(F.slice("chapters", 1, 30), lambda c: c["title"]), "、"),
        F.lit("\n关键词:"), F.array_join(F.slice("keywords", 1, 20), "、"),
        F.lit("\n定义:"), F.array_join(definitions, "; "),
    )
    part = F.when(
        F.col("markdown").isNotNull(), F.concat(head, F.lit("\n"), F.substring("markdown", 1, per_book))
    ).otherwise(line)
    parts = joined.select("request_id", "rank", part.alias("part"))
    return ordered_text(parts, ["request_id"], "rank", "part", "\n\n").withColumn("text", F.substring("text", 1, limit))


def chapter_summaries(chapters: DataFrame, deep: DataFrame) -> DataFrame:
    """Cached summary of the n-th level-1 chapter of each analysed book."""
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("order_index"))
    top = chapters.filter("level = 1").withColumn("n", n.cast("bigint"))
    cached = deep.filter("status = 'done'").select("book_id", F.explode("summaries").alias("s")).select(
        "book_id", "s.title", "s.summary"
    )
    return top.join(cached, ["book_id", "title"]).select("book_id", "n", "chapter_id", "title", "summary")


def changed_chapters(chapters: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """``stored(chapter_id, hash, summary)`` against the text as it is now.

    ``reuse`` when the text is unchanged and summarized, ``redo`` when not, ``empty`` without text,
    ``gone`` when the chapter no longer exists.
    """
    texts = ordered_text(chunks.filter("chapter_id is not null"), ["chapter_id"], "chunk_index", "content", "\n")
    now = chapters.select("chapter_id", F.lit(True).alias("exists")).join(
        texts.select("chapter_id", F.md5("text").alias("now_hash")), "chapter_id", "left"
    )
    status = (
        F.when(F.col("exists").isNull(), "gone")
        .when(F.col("now_hash").isNull(), "empty")
        .when((F.col("now_hash") == F.col("hash")) & F.col("summary").isNotNull(), "reuse")
        .otherwise("redo")
    )
    return now.join(stored, "chapter_id", "full").select("chapter_id", F.col("now_hash").alias("hash"), status.alias("action"))


def tag_usage(tags: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy("tag_id").agg(F.count("*").alias("book_count"))
    return tags.join(counts, "tag_id", "left").select(
        "tag_id", "name", F.coalesce("book_count", F.lit(0)).alias("book_count")
    ).orderBy("name")


def chat_history(logs: DataFrame, page: int, size: int, book_id: int | None = None) -> DataFrame:
    """One page of chats, newest first, with their sources parsed."""
    if book_id is not None:
        logs = logs.filter(F.col("book_id") == book_id)
    total = logs.agg(F.count("*").alias("n")).scalar()
    source = "array<struct<chunk_id:bigint,book_id:bigint,page:bigint,page_start:bigint,page_end:bigint,book_title:string,chapter_title:string,snippet:string>>"
    return page_of(logs, [F.desc("created_at"), F.desc("chat_id")], page, size).select(
        "chat_id", "question", "answer",
        F.coalesce(F.from_json("sources_json", source), F.array().cast(source)).alias("sources"), total.alias("total"),
    )


def by_page(items: DataFrame, id_column: str) -> DataFrame:
    """Notes or annotations ordered by book, page and id."""
    return items.orderBy("book_id", "page", id_column)


def recent(items: DataFrame, time_column: str, id_column: str, limit: int = 20) -> DataFrame:
    return items.orderBy(F.desc(time_column), F.desc(id_column)).limit(limit)


def dialogue_context(turns: DataFrame, contexts: DataFrame, last: int = 8, block: int = 1024, limit: int = 8000) -> DataFrame:
    """The ``last`` messages before each turn, and the source text of the dialogue cut to ``limit``.

    Turns are numbered without gaps inside ``turns(conv_id, turn, role, text)``. A dialogue is cut
    into blocks of turns, and the last turns of each block are copied to the next one, so that a
    dialogue of any length is many small windows.
    """
    own = F.floor(F.col("turn") / block)
    placed = turns.select("conv_id", "turn", "role", "text", own.alias("block"), F.lit(True).alias("own"))
    halo = turns.filter(F.col("turn") % block >= block - last).select(
        "conv_id", "turn", "role", "text", (own + 1).alias("block"), F.lit(False).alias("own")
    )
    before = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(-last, -1)
    history = F.collect_list(F.struct("role", "text")).over(before)
    windowed = placed.unionByName(halo).withColumn("history", history).filter("own")
    return windowed.join(contexts, "conv_id", "left").select(
        "conv_id", "turn", "history", F.substring(F.coalesce("context", F.lit("")), 1, limit).alias("context")
    )


def chapter_material(
    chunks: DataFrame, max_chunks: int | None = None, chunk_chars: int | None = None, limit: int = 12000
) -> DataFrame:
    """Ordered chunk text of each chapter, cut to ``limit`` characters."""
    rows = chunks.filter("chapter_id is not null")
    if max_chunks is not None:
        rank = F.row_number().over(Window.partitionBy("chapter_id").orderBy("chunk_index"))
        rows = rows.withColumn("rank", rank).filter(F.col("rank") <= max_chunks)
    if chunk_chars is not None:
        rows = rows.withColumn("content", F.substring("content", 1, chunk_chars))
    return ordered_text(rows, ["chapter_id"], "chunk_index", "content", "\n").withColumn("text", F.substring("text", 1, limit))


def annotation_export(annotations: DataFrame, books: DataFrame) -> DataFrame:
    """Markdown of the annotations: one part per page, and a part for page 0 with the heading.

    Parts ordered by page and joined by line breaks are the document of a book; they stay separate,
    so that no book is put together in one task.
    """
    flat = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" "))
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    lines = F.concat_ws(
        "\n",
        F.lit(""),
        F.when(said("text"), F.concat(F.lit("> "), flat("text"))),
        F.when(said("note"), F.concat(F.lit("- 📝 "), flat("note"))),
    )
    body = ordered_text(annotations.withColumn("lines", lines), ["book_id", "page"], "annotation_id", "lines", "\n")
    pages = body.select(
        "book_id", "page", F.concat(F.lit("## 第 "), F.col("page"), F.lit(" 页\n"), F.col("text"), F.lit("\n")).alias("markdown")
    )
    heads = books.join(annotations.select("book_id").distinct(), "book_id", "left_semi").select(
        "book_id", F.lit(0).cast("bigint").alias("page"),
        F.concat(F.lit("# 标注导出（"), F.col("title"), F.lit("）\n")).alias("markdown"),
    )
    return pages.unionByName(heads)
