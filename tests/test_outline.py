"""Headings, outlines, chapter trees and layout on hand-made books."""

from quire.operators import layout, office, toc


def pages(spark, *texts, book=1):
    return spark.createDataFrame(
        [(book, i, t) for i, t in enumerate(texts, 1)], "book_id bigint, page bigint, text string"
    )


def toc_rows(spark, items):
    return spark.createDataFrame(
        [(1, i, *item) for i, item in enumerate(items)], "book_id bigint, seq bigint, title string, level bigint, page bigint"
    )


def test_chapter_headings(spark, rows):
    book = pages(spark, "封面", *[f"第{n}章 公共管理导论 {n}\n正文" for n in range(1, 5)])
    found = rows(toc.detect_headings(book), "page", "level", "title")
    assert len(found) == 4 and found[0] == (2, 1, "第1章公共管理导论")


def test_too_few_headings(spark):
    assert toc.detect_headings(pages(spark, "第1章 导论\n正文", "正文")).isEmpty()


def test_two_levels(spark, rows):
    book = pages(spark, "第1章 导论", "第1节 概念", "第2节 方法", "第2章 理论")
    assert {r[0] for r in rows(toc.detect_headings(book), "level")} == {1, 2}


def test_contents_page_is_no_heading(spark):
    lines = "目录\n第1章 导论......1\n第2章 理论......9"
    assert toc.detect_headings(pages(spark, lines, lines, lines)).isEmpty()


def test_three_levels(spark, rows):
    book = pages(spark, "第一章 导论", "1.1 概念", "1.1.2 细节", "第2节 方法", "1.1 概念")
    found = rows(toc.detect_outline(book), "page", "level", "title")
    assert found == [(1, 1, "第一章 导论"), (2, 2, "1.1 概念"), (3, 3, "1.1.2 细节"), (4, 2, "第2节 方法")]


def test_chapter_tree(spark, rows):
    items = toc_rows(spark, [("第一章", 1, 1), ("1.1 节", 2, 2), ("1.2 节", 2, 5), ("第二章", 1, 10)])
    books = spark.createDataFrame([(1, 20), (2, 100)], "book_id bigint, total_pages bigint")
    tree = rows(toc.build_chapters(items, books), "book_id", "order_index", "parent_index", "start_page", "end_page")
    assert tree == [
        (1, 0, None, 1, 9), (1, 1, 0, 2, 4), (1, 2, 0, 5, 20), (1, 3, None, 10, 20), (2, 0, None, 1, 100),
    ]


def test_intervals_cover_all_pages(spark, rows):
    chapters = spark.createDataFrame(
        [(1, 0, 3, 5), (1, 1, 4, 4), (1, 2, 8, 9)], "book_id bigint, order_index bigint, start_page bigint, end_page bigint"
    )
    books = spark.createDataFrame([(1, 12)], "book_id bigint, total_pages bigint")
    found = rows(toc.page_intervals(chapters, books), "chapter_index", "start_page", "end_page")
    assert found == sorted([(None, 1, 2), (0, 3, 5), (1, 4, 4), (None, 6, 7), (2, 8, 9), (None, 10, 12)], key=repr)


def test_order_outline(spark):
    items = toc_rows(
        spark,
        [("第3章 丙", 1, 30), ("第一章 甲", 1, 2), ("1.1 甲一", 2, 3), ("第1节 散", 2, 4), ("第1节 早", 2, 1), ("3.1 丙一", 2, 31), ("第十二章 末", 1, 40)],
    )
    ordered = [r.title for r in toc.order_outline(items).orderBy("position").collect()]
    assert ordered == ["第一章 甲", "1.1 甲一", "第1节 散", "第3章 丙", "3.1 丙一", "第十二章 末", "第1节 早"]


def test_check_outline(spark, rows):
    items = toc_rows(
        spark, [("第1章 a", 1, 1), ("第3章 b", 1, 5), ("1.1 x", 2, 1), ("1.3 y", 2, 2), ("2.1.2 z", 3, 3), ("第99999999章 c", 1, 9)]
    )
    found = rows(toc.check_outline(items), "type", "ref")
    assert ("missing_chapter", "第2章") in found and len(found) == 30
    small = toc_rows(spark, [("第1章 a", 1, 1), ("第3章 b", 1, 5), ("1.1 x", 2, 1), ("1.3 y", 2, 2), ("2.1.2 z", 3, 3)])
    assert rows(toc.check_outline(small), "type", "ref") == [
        ("missing_chapter", "第2章"), ("missing_section", "1.2"), ("missing_subsection", "2.1.1"),
    ]


def test_deduplicate_keeps_the_cleanest(spark, rows):
    items = toc_rows(spark, [("1.1 概念 （续）", 2, 3), ("1.1 概 念", 2, 5), ("第一章 甲", 1, 1)])
    assert rows(toc.deduplicate(items), "seq", "title", "page") == [(0, "第一章甲", 1), (1, "1.1 概念", 3)]


def test_layout_roles(spark, rows):
    blocks = []
    for page in range(1, 5):
        blocks.append((1, page, 0, "教材", 9.0, 0, 10.0, 20.0))
        blocks.append((1, page, 1, f"正文 {page}", 12.0, 0, 200.0, 220.0))
        blocks.append((1, page, 2, f"其他 {page}", 10.5, 0, 230.0, 250.0))
    blocks += [(1, 1, 3, "粗体标题", 11.1, 16, 300.0, 320.0), (1, 1, 4, "∑x≥y", 10.5, 0, 400.0, 420.0), (1, 2, 5, "大字", 14.0, 0, 400.0, 420.0)]
    df = spark.createDataFrame(
        [(*b, 800.0) for b in blocks],
        "book_id bigint, page bigint, block_no bigint, text string, size double, flags bigint, y0 double, y1 double, page_height double",
    )
    books = spark.createDataFrame([(1,), (2,)], "book_id bigint")
    sizes = layout.body_font_size(df.filter("size > 9"), books)
    assert rows(sizes) == [(1, 10.5), (2, 12.0)]
    running = layout.running_lines(df)
    assert rows(running, "text", "running_role") == [("教材", "header")]
    roles = layout.final_roles(layout.classify_blocks(df, sizes), running)
    named = dict(rows(roles.filter("page = 1"), "text", "role"))
    assert named["粗体标题"] == "title" and named["∑x≥y"] == "formula" and named["教材"] == "header"
    assert rows(layout.title_lines(roles), "text") == sorted([("大字",), ("粗体标题",)], key=repr)


def test_paragraph_segmentation(spark, rows):
    items = [("Normal", "前言文字"), ("Heading 1", "甲"), ("Normal", "一、要点"), ("Normal", "正文"), ("Normal", "第2章 乙 12"), ("Normal", "甲")]
    df = spark.createDataFrame(
        [(1, i, s, t) for i, (s, t) in enumerate(items)], "book_id bigint, idx bigint, style string, text string"
    )
    made = office.segment_paragraphs(df)
    assert rows(office.office_toc(made), "seq", "title", "level", "page") == [
        (1, "甲", 1, 1), (2, "一、要点", 2, 2), (4, "第2章乙", 1, 3),
    ]
    assert [p for p, in rows(made.groupBy("page").count(), "page")] == [1, 2, 3, 4]
