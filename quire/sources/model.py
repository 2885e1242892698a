"""Model tables (books, pages, blocks, chunks, quizzes, attempts, ...) from the stored tables.

The stored text has no Han script, no page furniture and no headings, so some tables are dressed
with headings, running headers and page numbers by rules that plain SQL can repeat. All rules are
narrow: one document row gives the rows of one book, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import let

LINES_PER_PAGE = 3
CHUNKS_PER_CHAPTER = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus. An input with fewer splits than cores is spread out before the text work.

    A large corpus has far more splits than cores and is read as it lies.
    """
    df = table(spark, folder, "documents")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _lines() -> Column:
    return F.split("text", "\n")


def _page_count(lines_per_page: int = LINES_PER_PAGE) -> Column:
    return F.ceil(F.size(_lines()) / lines_per_page)


def books(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        F.col("doc_id").alias("book_id"),
        F.concat(F.lit("Book "), F.col("doc_id")).alias("title"),
        F.col("source").alias("file_type"),
        F.col("lang").alias("category"),
        F.lit("ready").alias("status"),
        _page_count().cast("bigint").alias("total_pages"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        F.col("doc_id").alias("book_id"), F.posexplode(_lines()).alias("n", "line")
    )


def page_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """One row per book with its page texts in order; a book is cut into lines once, not once per page."""
    pages = lambda lines: F.transform(
        F.sequence(F.lit(0), (F.ceil(F.size(lines) / LINES_PER_PAGE) - 1).cast("int")),
        lambda i: F.array_join(F.slice(lines, i * LINES_PER_PAGE + 1, LINES_PER_PAGE), "\n"),
    )
    return documents(spark, folder).select(F.col("doc_id").alias("book_id"), let(_lines(), pages).alias("pages"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return page_arrays(spark, folder).select(
        "book_id", F.posexplode("pages").alias("i", "text")
    ).select("book_id", (F.col("i") + 1).cast("bigint").alias("page"), "text")


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page text with the defects the cleaning steps repair."""
    dressed = F.concat_ws(
        "\n",
        F.concat(F.lit("  Reader Vol "), F.col("book_id")),
        F.split("text", "\n")[0],
        F.col("text"),
        F.lit(""),
        F.lit(""),
        F.lit("日日日日 ok"),
        F.lit("func-"),
        F.lit("tion x"),
        F.lit("第3章 标题"),
        F.lit("中文断行"),
        F.lit("继续。。。"),
        F.concat(F.lit("- "), F.col("page"), F.lit(" -")),
    )
    return pages(spark, folder).select("book_id", "page", dressed.alias("text"))


def _first_word(line: Column) -> Column:
    return F.regexp_extract(line, "^[^ ]+", 0)


def heading_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One line per page; four pages of five open with a chapter or section heading."""
    n = F.col("n")
    chapter = (F.floor(n / 4) + 1).cast("string")
    name = F.concat(_first_word(F.col("line")), F.lit(" topic  "), (n + 1).cast("string"))
    head = (
        F.when(n % 4 == 0, F.concat(F.lit("第 "), chapter, F.lit(" 章 "), name))
        .when(n % 4 == 1, F.concat(chapter, F.lit(".1 "), name))
        .when(n % 4 == 2, F.concat(F.lit("第"), chapter, F.lit("节 | "), name))
        .otherwise(F.concat(chapter, F.lit(".2.2 "), name))
    )
    leader = F.when((F.col("book_id") + n) % 9 == 4, F.lit("Contents ..... 1\n")).otherwise("")
    dropped = (F.col("book_id") + n) % 5 == 3
    return lines(spark, folder).select(
        "book_id",
        (n + 1).cast("bigint").alias("page"),
        F.when(dropped, F.col("line"))
        .otherwise(F.concat(leader, F.lit("\n "), head, F.lit("\n"), F.col("line")))
        .alias("text"),
    )


def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Positioned text blocks with a running header and footer on every page."""
    n, line = F.col("n"), F.col("line")
    seventh = (F.floor(n / 7) + 1).cast("string")
    body = lines(spark, folder).select(
        "book_id",
        (F.floor(n / LINES_PER_PAGE) + 1).cast("bigint").alias("page"),
        (n % LINES_PER_PAGE + 1).cast("bigint").alias("block_no"),
        F.when(n % 11 == 10, F.lit("∑∫≤≥ x = y"))
        .when(n % 7 == 0, F.concat(F.lit("第"), seventh, F.lit("章 "), _first_word(line)))
        .when(n % 7 == 3, F.concat(seventh, F.lit(".1 "), _first_word(line)))
        .when(n % 14 == 5, F.concat(seventh, F.lit(".1.1 "), _first_word(line)))
        .otherwise(line)
        .alias("text"),
        F.when(n % 7 == 0, F.lit(16.0))
        .when(n % 14 == 5, F.lit(14.0))
        .when(n % 7 == 3, F.lit(12.62))
        .when(n % 5 == 4, F.lit(11.96))
        .when(n % 13 == 12, F.lit(10.02))
        .otherwise(F.lit(12.04))
        .alias("size"),
        F.when(n % 7 == 3, 16).otherwise(0).cast("bigint").alias("flags"),
        F.when(n % 17 == 16, F.lit(30.0)).otherwise(n % LINES_PER_PAGE * 100 + 200.0).alias("y0"),
        F.when(n % 17 == 16, F.lit(50.0)).otherwise(n % LINES_PER_PAGE * 100 + 240.0).alias("y1"),
    )
    each_page = documents(spark, folder).select(
        F.col("doc_id").alias("book_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), _page_count())).alias("page")
    )

    def furniture(block_no: int, text: Column, y0: float) -> DataFrame:
        return each_page.select(
            "book_id", "page", F.lit(block_no).cast("bigint").alias("block_no"), text.alias("text"),
            F.lit(9.0).alias("size"), F.lit(0).cast("bigint").alias("flags"),
            F.lit(y0).alias("y0"), F.lit(y0 + 10).alias("y1"),
        )

    header = furniture(0, F.concat(F.lit("Reader Vol "), F.col("book_id")), 10.0)
    footer = furniture(99, F.lit("All rights reserved"), 780.0)
    return body.unionByName(header).unionByName(footer).withColumn("page_height", F.lit(800.0))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One chunk per page; four chunks per chapter; some first chunks belong to no chapter."""
    index = (F.col("page") - 1).cast("bigint")
    return pages(spark, folder).select(
        (F.col("book_id") * 100000 + index).alias("chunk_id"),
        "book_id",
        F.when(~((F.col("book_id") % 10 == 9) & (index == 0)),
               F.col("book_id") * 1000 + F.floor(index / CHUNKS_PER_CHAPTER)).alias("chapter_id"),
        index.alias("chunk_index"),
        F.col("page").alias("page_start"),
        F.col("page").alias("page_end"),
        F.col("text").alias("content"),
        F.length("text").cast("bigint").alias("word_count"),
    )


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of ``chunks``: every third one is a level-1 chapter, the others are its children."""
    total = _page_count().cast("bigint")
    base = documents(spark, folder).select(
        F.col("doc_id").alias("book_id"),
        total.alias("total"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((total - 1) / CHUNKS_PER_CHAPTER))).alias("k"),
    )
    k = F.col("k")
    return base.select(
        (F.col("book_id") * 1000 + k).alias("chapter_id"),
        "book_id",
        F.when(k % 3 != 0, F.col("book_id") * 1000 + k - k % 3).alias("parent_id"),
        F.concat(F.lit("Chapter "), (k + 1).cast("string")).alias("title"),
        F.when(k % 3 == 0, 1).otherwise(2).cast("bigint").alias("level"),
        k.alias("order_index"),
        (k * CHUNKS_PER_CHAPTER + 1).alias("start_page"),
        F.least(k * CHUNKS_PER_CHAPTER + CHUNKS_PER_CHAPTER, F.col("total")).alias("end_page"),
    )


def queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def quizzes(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("p_partkey") % 3
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("quiz_id"),
        (F.col("p_size") % 5).cast("bigint").alias("book_id"),
        F.col("p_size").cast("bigint").alias("chapter_id"),
        F.when(kind == 0, "choice").when(kind == 1, "blank").otherwise("short").alias("q_type"),
        F.col("p_name").alias("question"),
        F.to_json(F.array("p_name", "p_type")).alias("options_json"),
        F.col("p_brand").alias("answer"),
    )


def quiz_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of the quizzes, with 15 chapters from ``nation`` that have no quiz."""
    used = table(spark, folder, "part").select(F.col("p_size").cast("bigint").alias("chapter_id"))
    spare = table(spark, folder, "nation").select((F.col("n_nationkey") + 41).cast("bigint").alias("chapter_id"))
    both = used.union(spare).distinct()
    return both.select(
        "chapter_id",
        (F.col("chapter_id") % 5).alias("book_id"),
        F.concat(F.lit("Chapter "), F.col("chapter_id")).alias("title"),
        F.col("chapter_id").alias("order_index"),
    )


def quiz_books(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").cast("bigint").alias("book_id"), F.col("r_name").alias("title")
    )


def _quiz_of_event() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint") * 20 + F.col("user_id") % 20


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return attempts_from_events(table(spark, folder, "events"))


def attempts_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("attempt_id"),
        _quiz_of_event().alias("quiz_id"),
        F.concat(F.lit(" brand#"), F.col("user_id") % 25, F.lit(" ")).alias("user_answer"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).cast("bigint").alias("is_correct"),
        F.col("ts").cast("timestamp").alias("answered_at"),
    )


def knowledge_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """A tree over the parts: node ``i`` hangs below node ``floor(i / 4)``; 0 to 3 are roots."""
    key = F.col("p_partkey")
    third = F.col("p_size") % 3
    return table(spark, folder, "part").select(
        key.alias("node_id"),
        F.when(key >= 4, F.floor(key / 4)).alias("parent_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("note"),
        (F.col("p_size") % 5).cast("bigint").alias("book_id"),
        F.when(key % 2 == 0, F.col("p_size").cast("bigint")).alias("chapter_id"),
        F.when(third == 0, "unknown").when(third == 1, "fuzzy").otherwise("known").alias("mastery"),
        (key % 4).alias("order_index"),
    )


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations on the quiz books, one per order."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("annotation_id"),
        (F.col("o_custkey") % 5).alias("book_id"),
        (key % 40 + 1).alias("page"),
        F.when(key % 7 != 0, F.concat(F.lit("quote "), F.col("o_orderpriority"), F.lit("\nline "), key)).alias("text"),
        F.when(key % 3 == 0, F.concat(F.lit("note\n"), F.col("o_orderstatus"))).alias("note"),
        F.when(key % 4 == 0, F.col("o_custkey")).alias("knowledge_node_id"),
    )


def chat_logs(spark: SparkSession, folder: str) -> DataFrame:
    """A user turn and the assistant turn right after it."""
    talk = table(spark, folder, "conversations")
    asked = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = talk.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("chat_id"),
        (F.col("conv_id") % 5).alias("book_id"),
        "question",
        F.concat(
            F.col("answer"), F.lit(" [资料"), F.col("turn") + 1, F.lit("][资料"), F.col("conv_id") % 4, F.lit("]")
        ).alias("answer"),
        (F.col("turn") % 4 + 1).alias("n_sources"),
        (F.col("conv_id") * 60 + F.col("turn")).alias("created_at"),
    )
