"""Tables of contents: heading detection, de-duplication, ordering, checking, chapter trees.

The scans read one page row at a time; only the headings they find (a few per book) are shuffled.
Windows are partitioned by book and run over headings, never over text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import patterns as P
from quire.functions.text import let, strip
from quire.functions.titles import (
    chapter_number,
    clean_heading,
    clean_outline_title,
    outline_key,
)

WHOLE_BOOK = "全书"


def _top_lines(text: Column, n: int) -> Column:
    """First ``n`` non-blank lines, cut before the first dotted-leader line."""
    top = F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda l: l != ""), 1, n)
    return let(
        top,
        lambda found: let(
            F.array_position(F.transform(found, lambda l: l.rlike(P.DOT_LEADER)), F.lit(True)),
            lambda stop: F.when(stop > 0, F.slice(found, 1, (stop - 1).cast("int"))).otherwise(found),
        ),
    )


def _heading(found: Column, title: Column, level: int) -> Column:
    return F.when(found, F.struct(title.alias("title"), F.lit(level).cast("bigint").alias("level")))


def _first_heading(pages: DataFrame, n: int, parse) -> DataFrame:
    hits = F.filter(F.transform(_top_lines(F.col("text"), n), parse), lambda h: h.isNotNull())
    return (
        pages.select("book_id", "page", F.get(hits, F.lit(0)).alias("h"))
        .filter("h is not null")
        .select("book_id", "page", "h.level", "h.title")
    )


def _first_per_key(found: DataFrame, key: Column, min_hits: int) -> DataFrame:
    """First heading per key, for books with at least ``min_hits`` headings before that."""
    keyed = found.groupBy("book_id", key.alias("key")).agg(
        F.count("*").alias("n"), F.min(F.struct("page", "level", "title")).alias("h")
    )
    total = F.sum("n").over(Window.partitionBy("book_id"))
    return (
        keyed.withColumn("total", total)
        .filter(F.col("total") >= min_hits)
        .select("book_id", "h.page", "h.level", "h.title")
    )


def detect_headings(pages: DataFrame, min_hits: int = 3) -> DataFrame:
    """Two-level headings from the first three lines of each page."""

    def parse(line: Column) -> Column:
        number = F.regexp_extract(line, f"第[{P.SPACE}]*([{P.NUM}]+)", 1)
        chapter = F.concat(F.lit("第"), number, F.lit("章"), clean_heading(F.regexp_extract(line, P.CHAPTER, 2)))
        section = F.concat(F.lit("第"), number, F.lit("节"), clean_heading(F.regexp_extract(line, P.SECTION, 2)))
        return F.coalesce(
            _heading(line.rlike(P.CHAPTER), chapter, 1), _heading(line.rlike(P.SECTION), section, 2)
        )

    found = _first_heading(pages, 3, parse)
    prefix = F.regexp_extract("title", f"^(第[{P.NUM}]+[章篇编部])", 1)
    return _first_per_key(found, F.when(prefix != "", prefix).otherwise(F.col("title")), min_hits)


def detect_outline(pages: DataFrame, min_hits: int = 2) -> DataFrame:
    """Three-level headings (第N章, n.m or 第N节, n.m.k) from the first four lines of each page."""

    def parse(line: Column) -> Column:
        def titled(pattern: str, group: int) -> tuple[Column, Column]:
            title = clean_outline_title(F.regexp_extract(line, pattern, group))
            return title, line.rlike(pattern) & (F.length(title) <= 28)

        def joined(*parts: Column | str) -> Column:
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        number = F.regexp_extract(line, f"第[{P.SPACE}]*([{P.NUM}]+)", 1)
        sub, is_sub = titled(P.DOTTED_3, 2)
        chapter, is_chapter = titled(P.CHAPTER, 2)
        section, is_section = titled(P.PLAIN_SECTION, 2)
        dotted, is_dotted = titled(P.DOTTED_2, 2)
        return F.coalesce(
            _heading(is_sub, joined(F.regexp_extract(line, P.DOTTED_3, 1), " ", sub), 3),
            _heading(is_chapter, joined("第", number, "章 ", chapter), 1),
            _heading(is_section, joined("第", number, "节 ", section), 2),
            _heading(is_dotted, joined(F.regexp_extract(line, P.DOTTED_2, 1), " ", dotted), 2),
        )

    found = _first_heading(pages, 4, parse)
    return _first_per_key(found, outline_key(F.col("title"), F.col("level")), min_hits)


def headings_from_layout(roles: DataFrame, min_hits: int = 3) -> DataFrame:
    """Headings from title blocks of at most 50 characters, levels by numbering pattern."""
    title = strip(F.col("text"))
    found = (
        roles.filter("role = 'title'")
        .select("book_id", "page", "block_no", title.alias("title"))
        .filter((F.col("title") != "") & (F.length("title") <= 50))
    )
    level = (
        F.when(F.col("title").rlike(f"第[{P.SPACE}]*[{P.NUM}]+[{P.SPACE}]*[章篇编部]"), 1)
        .when(F.col("title").rlike(f"第[{P.SPACE}]*[{P.NUM}]+[{P.SPACE}]*节"), 2)
        .when(F.col("title").rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}"), 3)
        .otherwise(2)
        .cast("bigint")
    )
    key = F.regexp_replace("title", rf"[{P.SPACE}，。、|｜.．:：—-]+", "")
    keyed = (
        found.withColumn("level", level)
        .groupBy("book_id", key.alias("key"))
        .agg(F.count("*").alias("n"), F.min(F.struct("page", "block_no", "level", "title")).alias("h"))
    )
    total = F.sum("n").over(Window.partitionBy("book_id"))
    return (
        keyed.withColumn("total", total)
        .filter(F.col("total") >= min_hits)
        .select("book_id", "h.page", "h.block_no", "h.level", "h.title")
    )


def deduplicate(toc: DataFrame) -> DataFrame:
    """One item per title key: the shortest cleaned title, at the place of the first occurrence.

    ``toc(book_id, seq, title, level, page)``; the result is renumbered per book.
    """
    cleaned = toc.withColumn("title", clean_outline_title(F.col("title"))).filter("title <> ''")
    order = F.struct("page", "level", "seq")
    kept = cleaned.groupBy("book_id", outline_key(F.col("title"), F.col("level")).alias("key")).agg(
        F.min(order).alias("place"),
        F.min_by(
            F.struct("title", "level", "page"), F.struct(F.length("title").alias("n"), order.alias("o"))
        ).alias("item"),
    )
    seq = F.row_number().over(Window.partitionBy("book_id").orderBy("place")) - 1
    return kept.select("book_id", seq.cast("bigint").alias("seq"), "item.title", "item.level", "item.page")


def order_outline(toc: DataFrame) -> DataFrame:
    """Chapters by number, each followed by its numbered sections and its unnumbered ones.

    A numbered section without a chapter of that number has no place in the outline. An unnumbered
    one belongs to the last chapter that starts on or before its page, found by one ordered pass.
    """
    number = chapter_number(F.col("title"))
    items = toc.withColumn("number", F.when((F.col("level") == 1) & (number != 0), number))
    by_rank = Window.partitionBy("book_id").orderBy(F.coalesce("number", F.lit(999)), "page", "seq")
    chapters = items.filter("level = 1").withColumn("rank", F.row_number().over(by_rank))
    rest = items.filter("level <> 1").withColumn(
        "lead", F.regexp_extract("title", "^([0-9]{1,2})", 1)
    )
    numbered = rest.filter("lead <> ''").withColumn("number", F.col("lead").cast("bigint"))
    placed = numbered.join(chapters.select("book_id", "number", "rank"), ["book_id", "number"])
    loose = rest.filter("lead = ''")

    marks = chapters.select(
        "book_id", "page", F.lit(0).alias("loose"), "rank", *[F.lit(None).cast(t).alias(c) for c, t in
        (("seq", "bigint"), ("title", "string"), ("level", "bigint"))],
    )
    union = marks.unionByName(
        loose.select("book_id", "page", F.lit(1).alias("loose"), F.lit(None).cast("int").alias("rank"),
                     "seq", "title", "level")
    )
    ordered = Window.partitionBy("book_id").orderBy("page", "loose", "rank", "seq")
    owned = union.withColumn("owner", F.last("rank", ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, 0)
    )).filter("loose = 1")

    def shape(df: DataFrame, rank: Column, kind: int) -> DataFrame:
        return df.select("book_id", rank.alias("rank"), F.lit(kind).alias("kind"), "seq", "title", "level", "page")

    every = (
        shape(chapters, F.col("rank"), 0)
        .unionByName(shape(placed, F.col("rank"), 1))
        .unionByName(shape(owned, F.coalesce("owner", F.lit(2147483647)), 2))
    )
    position = F.row_number().over(Window.partitionBy("book_id").orderBy("rank", "kind", "page", "seq"))
    return every.select("book_id", position.cast("bigint").alias("position"), "title", "level", "page")


def check_outline(toc: DataFrame, limit: int = 30) -> DataFrame:
    """First ``limit`` missing chapter, section and subsection numbers of each book, with counts.

    Gaps are read off neighbouring numbers, so a stray huge number cannot blow up a sequence.
    """
    dotted = F.transform(F.split(F.regexp_extract("title", r"^[0-9]{1,2}(\.[0-9]{1,2}){1,2}", 0), r"\."),
                         lambda x: x.try_cast("bigint"))
    number = F.regexp_extract("title", f"^第([{P.NUM}]+)章", 1)
    level, parts = F.col("level"), F.col("parts")
    numbered = toc.withColumn("parts", dotted).select(
        "book_id",
        "level",
        F.when((level == 1) & (number != ""), F.lit(""))
        .when((level == 2) & (F.size("parts") >= 2), F.element_at(parts, 1).cast("string"))
        .when((level == 3) & (F.size("parts") == 3),
              F.concat_ws(".", F.element_at(parts, 1).cast("string"), F.element_at(parts, 2).cast("string")))
        .alias("parent"),
        F.when(level == 1, chapter_number(F.concat(F.lit("第"), number, F.lit("章"))))
        .when(level == 2, F.get(parts, F.lit(1)))
        .otherwise(F.get(parts, F.lit(2)))
        .alias("n"),
    )
    present = numbered.filter("parent is not null and n >= 1").distinct()
    before = F.coalesce(
        F.lag("n").over(Window.partitionBy("book_id", "level", "parent").orderBy("n")), F.lit(0)
    )
    missing = (
        present.withColumn("before", before)
        .filter("n > before + 1")
        .withColumn("missing", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("n") - 1, F.col("before") + limit))))
    )
    major = F.coalesce(F.split("parent", r"\.")[0].try_cast("bigint"), F.lit(0))
    minor = F.coalesce(F.try_element_at(F.split("parent", r"\."), F.lit(2)).cast("bigint"), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("level", major, minor, "missing"))
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("missing_chapter", "missing_section", "missing_subsection")]),
        F.col("level").cast("int"),
    )
    ref = F.when(F.col("level") == 1, F.concat(F.lit("第"), F.col("missing"), F.lit("章"))).otherwise(
        F.concat("parent", F.lit("."), F.col("missing"))
    )
    return (
        missing.withColumn("rank", rank)
        .filter(F.col("rank") <= limit)
        .select("book_id", kind.alias("type"), ref.alias("ref"), "level")
    )


def outline_counts(toc: DataFrame) -> DataFrame:
    return toc.groupBy("book_id").agg(
        *[F.count_if(F.col("level") == k).alias(n) for k, n in ((1, "chapters"), (2, "sections"), (3, "subsections"))]
    )


def build_chapters(toc: DataFrame, books: DataFrame) -> DataFrame:
    """Chapter tree of every book.

    ``toc(book_id, seq, title, level, page)`` and ``books(book_id, total_pages)``. The parent is the
    nearest earlier item with a smaller level; a chapter ends before its next sibling. There are as
    many levels as the deepest book has.
    """
    depth = toc.groupBy("book_id").agg((F.max("level") - F.min("level") + 1).alias("n")).agg(F.max("n")).first()[0]
    max_level = max(int(depth or 1), 2)
    per_book = Window.partitionBy("book_id")
    ordered = per_book.orderBy("seq")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    levelled = toc.select(
        "book_id",
        (F.row_number().over(ordered) - 1).cast("bigint").alias("order_index"),
        "title",
        (F.col("level") - F.min("level").over(per_book) + 1).cast("bigint").alias("level"),
        F.col("page").alias("start_page"),
        "seq",
    )
    last_at = [
        F.last(F.when(F.col("level") == k, F.col("order_index")), ignorenulls=True).over(before)
        for k in range(1, max_level)
    ]
    parent = reduce(
        lambda acc, k: F.when(F.col("level") == k, F.greatest(*last_at[: k - 1]) if k > 2 else last_at[0]).otherwise(acc),
        range(2, max_level + 1),
        F.lit(None).cast("bigint"),
    )
    tree = levelled.withColumn("parent_index", parent)
    following = F.lead("start_page").over(Window.partitionBy("book_id", "parent_index").orderBy("order_index"))
    joined = (
        books.select("book_id", "total_pages")
        .join(tree.withColumn("following", following), "book_id", "left")
    )
    end = F.greatest("start_page", F.coalesce(F.col("following") - 1, F.col("total_pages")))
    whole = F.greatest("total_pages", F.lit(1).cast("bigint"))
    untitled = F.col("order_index").isNull()
    return joined.select(
        "book_id",
        F.coalesce("order_index", F.lit(0).cast("bigint")).alias("order_index"),
        "parent_index",
        F.when(untitled, WHOLE_BOOK).otherwise(F.col("title")).alias("title"),
        F.coalesce("level", F.lit(1).cast("bigint")).alias("level"),
        F.coalesce("start_page", F.lit(1).cast("bigint")).alias("start_page"),
        F.when(untitled, whole).otherwise(end).alias("end_page"),
    )


def page_intervals(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapter page ranges plus ranges without a chapter where no chapter covers the pages."""
    ordered = Window.partitionBy("book_id").orderBy("start_page", "order_index")
    cursor = F.greatest(
        F.lit(1).cast("bigint"),
        F.coalesce(
            F.max(F.col("end_page") + 1).over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(1).cast("bigint"),
        ),
    )
    marked = chapters.withColumn("cursor", cursor)
    gap_id = F.lit(None).cast("bigint").alias("chapter_index")
    own = marked.select("book_id", F.col("order_index").alias("chapter_index"), "start_page", "end_page")
    before = marked.filter("cursor < start_page").select(
        "book_id", gap_id, F.col("cursor").alias("start_page"), (F.col("start_page") - 1).alias("end_page")
    )
    reached = chapters.groupBy("book_id").agg(F.max("end_page").alias("reached"))
    tail = (
        books.select("book_id", "total_pages")
        .join(reached, "book_id", "left")
        .withColumn("from", F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.col("reached") + 1, F.lit(1).cast("bigint"))))
        .filter("`from` <= total_pages")
        .select("book_id", gap_id, F.col("from").alias("start_page"), F.col("total_pages").alias("end_page"))
    )
    return own.unionByName(before).unionByName(tail)


def choose_source(*sources: DataFrame) -> DataFrame:
    """The first source, in the order given, that has headings for a book."""
    tagged = [
        df.select("book_id", F.lit(i).cast("bigint").alias("priority"), "page", "level", "title")
        for i, df in enumerate(sources)
    ]
    union = reduce(DataFrame.unionByName, tagged)
    best = F.min("priority").over(Window.partitionBy("book_id"))
    return union.withColumn("best", best).filter("priority = best").drop("best")


def assign_pages(pages: DataFrame, intervals: DataFrame) -> DataFrame:
    """Every page of every interval, by an equi join on the exploded interval.

    A page below a chapter and its section appears for both.
    """
    spread = intervals.select(
        "book_id", "chapter_index", "start_page", "end_page",
        F.explode(F.sequence("start_page", "end_page")).alias("page"),
    )
    return pages.join(spread, ["book_id", "page"])


def nested_order(chapters: DataFrame) -> DataFrame:
    """Numbered ``seq`` by (page, level), the order in which headings appear on the pages."""
    seq = F.row_number().over(Window.partitionBy("book_id").orderBy("page", "level", "title")) - 1
    return chapters.withColumn("seq", seq.cast("bigint"))
