"""Knowledge-tree jobs beside pure tree walks (those are in ``tree``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators.ranking import global_row_number
from quire.operators.sections import ordered_text


def chapter_skeleton(books: DataFrame, chapters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that mirror the chapter tree of each book below a new root.

    New ids continue after the largest node id, in book and chapter order.
    """
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("top")).scalar()
    none = F.lit(None).cast("bigint")
    roots = books.select(
        "book_id", none.alias("chapter_id"), none.alias("parent_chapter"),
        F.concat(F.lit("《"), F.col("title"), F.lit("》章节骨架")).alias("title"), F.lit(0).cast("bigint").alias("order_index"),
    )
    known = chapters.select("book_id", F.col("chapter_id").alias("parent_chapter"))
    placed = chapters.select(
        "book_id", "chapter_id", F.col("parent_id").alias("parent_chapter"), "title", "order_index"
    ).join(known, ["book_id", "parent_chapter"], "left").select(
        "book_id", "chapter_id", "parent_chapter", "title", "order_index"
    )
    made = global_row_number(
        roots.unionByName(placed).withColumn("is_chapter", F.col("chapter_id").isNotNull()),
        ["book_id", "is_chapter", "order_index", "chapter_id"], "rn",
    ).withColumn("node_id", F.col("rn") + top)
    above = made.select("book_id", F.coalesce("chapter_id", F.lit(-1)).alias("above"), F.col("node_id").alias("parent_id"))
    return (
        made.withColumn("above", F.when(F.col("is_chapter"), F.coalesce("parent_chapter", F.lit(-1))))
        .join(above, ["book_id", "above"], "left")
        .select("node_id", "parent_id", "book_id", "chapter_id", "title", "order_index")
    )


def node_sources(nodes: DataFrame, chapters: DataFrame, chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Text of the chapter linked to each node; empty when there is none.

    The text of a chapter is put together once, however many nodes link to it.
    """
    linked = chapters.join(nodes.select("chapter_id").distinct(), "chapter_id", "left_semi")
    texts = ordered_text(
        chunks.join(linked.select("chapter_id"), "chapter_id", "left_semi"), ["chapter_id"], "chunk_index", "content", "\n\n"
    )
    source = (
        linked.select("chapter_id", "book_id", F.col("title").alias("chapter_title"), "start_page", "end_page")
        .join(books.select("book_id", F.col("title").alias("book_title")), "book_id", "left")
        .join(texts, "chapter_id", "left")
    )
    # Nodes without a chapter have nothing to meet and stay out of the join.
    titled = nodes.select("node_id", F.col("title").alias("node_title"), "chapter_id")
    joined = titled.filter("chapter_id IS NOT NULL").join(source, "chapter_id", "left")
    return joined.unionByName(titled.filter("chapter_id IS NULL"), allowMissingColumns=True).select(
        "node_id", "node_title", "book_id", "book_title", "chapter_title",
        F.col("start_page").alias("page_start"), F.col("end_page").alias("page_end"), F.coalesce("text", F.lit("")).alias("text"),
    )


def node_annotations(annotations: DataFrame, books: DataFrame) -> DataFrame:
    """Annotations linked to a node with the title of their book, ordered by node, book and page."""
    return (
        annotations.filter("knowledge_node_id is not null")
        .join(books.select("book_id", F.col("title").alias("book_title")), "book_id", "left")
        .select(
            F.col("knowledge_node_id").alias("node_id"), "annotation_id", "book_id",
            F.coalesce("book_title", F.lit("")).alias("book_title"), "page",
            F.coalesce("text", F.lit("")).alias("text"), F.coalesce("note", F.lit("")).alias("note"),
        )
        .orderBy("node_id", "book_id", "page", "annotation_id")
    )


def mastery_counts(nodes: DataFrame) -> DataFrame:
    level = F.coalesce("mastery", F.lit("unknown"))
    return nodes.agg(
        F.count("*").alias("total"),
        *[F.count_if(level == name).alias(name) for name in ("known", "fuzzy", "unknown")],
    )


def flatten_json_trees(trees: DataFrame, max_children: int = 12, max_depth: int = 3) -> DataFrame:
    """``trees(tree_id, json)``: one row per titled node down to ``max_depth``.

    A node without a title is left out with everything below it; ``order_index`` is its place in the
    list it came from, and ``path`` the places from the top.
    """
    shape = "title:string"
    for _ in range(max_depth):
        shape = f"title:string,children:array<struct<{shape}>>"
    level = trees.select(
        "tree_id", F.from_json("json", f"array<struct<{shape}>>").alias("items"), F.lit("").alias("above")
    )
    found = []
    for depth in range(max_depth + 1):
        rows = level.select(
            "tree_id", "above", F.posexplode(F.slice("items", 1, max_children)).alias("order_index", "item")
        ).withColumn("title", strip(F.col("item.title"))).filter("title <> ''")
        path = F.concat("above", F.lit("/"), F.col("order_index").cast("string"))
        found.append(
            rows.select("tree_id", path.alias("path"), F.lit(depth).cast("bigint").alias("depth"), "title",
                        F.col("order_index").cast("bigint").alias("order_index"))
        )
        if depth < max_depth:
            level = rows.select("tree_id", F.col("item.children").alias("items"), path.alias("above"))
    return reduce(DataFrame.unionByName, found)


def annotations_to_nodes(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """New note nodes for annotations that have text but no node, with the link back."""
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("top")).scalar()
    seed = strip(F.coalesce(F.when(F.col("note") != "", F.col("note")), F.col("text"), F.lit("")))
    loose = annotations.filter("knowledge_node_id is null").select("annotation_id", "book_id", seed.alias("seed")).filter("seed <> ''")
    return global_row_number(loose, ["annotation_id"], "rn").select(
        (F.col("rn") + top).alias("node_id"), "annotation_id", "book_id",
        F.substring("seed", 1, 40).alias("title"), F.lit("note").alias("node_type"), F.substring("seed", 1, 500).alias("note"),
    )
