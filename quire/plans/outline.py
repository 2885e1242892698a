"""Registered queries: tables of contents, chapter trees and section texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import titles as T
from quire.operators import office, sections, toc, tree
from quire.plans import cleaning
from quire.plans import twin as S
from quire.sources import model as M


def outline(spark: SparkSession, d: str) -> DataFrame:
    """Three-level headings as a numbered table of contents."""
    return toc.nested_order(toc.detect_outline(M.heading_pages(spark, d)))


def _layout_headings(spark: SparkSession, d: str) -> DataFrame:
    return toc.headings_from_layout(cleaning.block_roles(spark, d))


def _raw_toc(spark: SparkSession, d: str) -> DataFrame:
    """Headings of the outline and of the layout together, so that titles repeat."""
    both = outline(spark, d).select("book_id", "title", "level", "page").unionByName(
        outline(spark, d).select(
            "book_id", F.concat("title", F.lit(" （续）")).alias("title"), "level", (F.col("page") + 1).alias("page")
        )
    )
    return toc.nested_order(both)


def _line_books(spark: SparkSession, d: str) -> DataFrame:
    return M.documents(spark, d).select(
        F.col("doc_id").alias("book_id"),
        F.concat(F.lit("Book "), F.col("doc_id")).alias("title"),
        F.size(F.split("text", "\n")).cast("bigint").alias("total_pages"),
    )


def chapter_tree(spark: SparkSession, d: str) -> DataFrame:
    return toc.build_chapters(outline(spark, d), _line_books(spark, d))


def _check(spark: SparkSession, d: str) -> DataFrame:
    items = outline(spark, d)
    issues = toc.check_outline(items)
    return issues.join(toc.outline_counts(items), "book_id")


def _numerals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 10000
    digit = lambda k: F.element_at(F.array(*[F.lit(x) for x in "零一二三四五六七八九"]), (k + 1).cast("int"))
    part = lambda k, unit: F.when(k > 0, F.concat(digit(k), F.lit(unit))).otherwise("")
    tens = F.floor(n / 10) % 10
    text = F.concat(
        part(F.floor(n / 1000), "千"), part(F.floor(n / 100) % 10, "百"),
        F.when((n >= 10) & (n < 20), "十").otherwise(part(tens, "十")), part(n % 10, ""),
    )
    return M.table(spark, d, "part").filter("p_partkey % 10000 > 0").select(
        F.col("p_partkey"), T.numeral_value(text).alias("value")
    )


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return toc.choose_source(
        toc.detect_headings(M.heading_pages(spark, d)),
        _layout_headings(spark, d).drop("block_no"),
        _line_books(spark, d).select(
            "book_id", F.lit(1).cast("bigint").alias("page"), F.lit(1).cast("bigint").alias("level"),
            F.lit(toc.WHOLE_BOOK).alias("title"),
        ),
    )


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    n, line = F.col("n"), F.col("line")
    word = F.regexp_extract(line, "^[^ ]+", 0)
    return M.lines(spark, d).select(
        "book_id",
        n.cast("bigint").alias("idx"),
        F.when(n % 6 == 1, "Heading 1").when(n % 6 == 3, "标题 2").otherwise("Normal").alias("style"),
        F.when(n % 6 == 5, F.concat(F.lit("第"), (n + 1).cast("string"), F.lit("章 "), word, F.lit(" 12")))
        .when(n % 6 == 4, F.concat(F.lit("一、"), word))
        .when(n % 6 == 2, F.concat(F.lit("第"), (n + 1).cast("string"), F.lit("节："), word, F.lit("（3）")))
        .otherwise(line)
        .alias("text"),
    )


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return office.segment_paragraphs(_paragraphs(spark, d))


def _section_texts(spark: SparkSession, d: str) -> DataFrame:
    return sections.section_texts(M.chunks(spark, d), outline(spark, d))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return outline(spark, d).filter("level = 1").select(
        "book_id", "title", F.concat(F.lit("# Summary\n### Point\n"), F.col("title")).alias("summary")
    )


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    """Page ranges of all books when their first chapter is missing, so that there are gaps."""
    return toc.page_intervals(chapter_tree(spark, d).filter("order_index > 0"), _line_books(spark, d))


QUERIES = {
    "two_level_heading_detection": lambda s, d: toc.detect_headings(M.heading_pages(s, d)),
    "toc_from_layout_titles": _layout_headings,
    "three_level_heading_detection": lambda s, d: toc.detect_outline(M.heading_pages(s, d)),
    "toc_deduplication": lambda s, d: toc.deduplicate(_raw_toc(s, d)),
    "chinese_numeral_value": _numerals,
    "toc_reordering": lambda s, d: toc.order_outline(outline(s, d)),
    "toc_completeness_check": _check,
    "chapter_tree_build": chapter_tree,
    "page_interval_gap_fill": _intervals,
    "toc_source_priority": _sources,
    "paragraph_style_level": lambda s, d: _paragraphs(s, d).select(
        "book_id", "idx", "style", T.style_level(F.col("style")).cast("bigint").alias("level")
    ),
    "paragraph_page_segmentation": lambda s, d: _segments(s, d),
    "office_toc": lambda s, d: office.office_toc(_segments(s, d)),
    "office_pages": lambda s, d: office.office_pages(_segments(s, d)),
    "office_heading_cleanup": lambda s, d: _paragraphs(s, d).select(
        "book_id", "idx", T.clean_office_heading(F.col("text")).alias("title")
    ),
    "nested_chapter_view": lambda s, d: tree.tree_paths(
        M.chapters(s, d).select(F.col("chapter_id").alias("node_id"), "parent_id")
    ).select(F.col("node_id").alias("chapter_id"), "depth", F.array_join("path", "/").alias("path")),
    "section_text_assembly": _section_texts,
    "markdown_heading_downgrade": lambda s, d: M.chunks(s, d).select(
        "chunk_id",
        T.downgrade_headings(F.concat(F.lit("# A b\n##### c\n####### no\n#x\n"), F.col("content"))).alias("markdown"),
    ),
    "book_markdown_assembly": lambda s, d: sections.markdown_books(
        _line_books(s, d), outline(s, d), _summaries(s, d), _section_texts(s, d)
    ),
    "structured_document": lambda s, d: sections.structured_document(M.chapters(s, d), M.chunks(s, d)),
}

_NUMBER = S.rx("line", f"第[{P.SPACE}]*([{P.NUM}]+)", 1)


def _top(n: int) -> str:
    return f"""top AS (SELECT book_id, page, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT book_id, page,
      list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')[1:{n}] AS l FROM heading_pages)),
     cut AS (SELECT * FROM top QUALIFY i < coalesce(min(CASE WHEN {S.rm('line', P.DOT_LEADER)} THEN i END) OVER (PARTITION BY book_id, page), 99))"""


def _prefix(x: str) -> str:
    return S.rx(x, f"^(第[{P.NUM}]+[章篇编部])", 1)


_HEADINGS = S.HEADING_PAGES + ", " + _top(3) + f""", hit AS (
  SELECT book_id, page, CASE WHEN {S.rm('line', P.CHAPTER)} THEN 1 ELSE 2 END::bigint AS level,
    CASE WHEN {S.rm('line', P.CHAPTER)} THEN '第' || {_NUMBER} || '章' || {S.clean_heading(S.rx('line', P.CHAPTER, 2))}
         ELSE '第' || {_NUMBER} || '节' || {S.clean_heading(S.rx('line', P.SECTION, 2))} END AS title
  FROM cut WHERE {S.rm('line', P.CHAPTER)} OR {S.rm('line', P.SECTION)}
  QUALIFY row_number() OVER (PARTITION BY book_id, page ORDER BY i) = 1),
 headings AS (SELECT book_id, page, level, title FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM hit) WHERE n >= 3
  QUALIFY row_number() OVER (PARTITION BY book_id, CASE WHEN {_prefix('title')} <> '' THEN {_prefix('title')} ELSE title END ORDER BY page) = 1)"""


def _ok(pattern: str, group: int) -> str:
    return f"({S.rm('line', pattern)} AND length({S.clean_outline_title(S.rx('line', pattern, group))}) <= 28)"


def _t(pattern: str, group: int) -> str:
    return S.clean_outline_title(S.rx("line", pattern, group))


OUTLINE = S.HEADING_PAGES + ", " + _top(4) + f""", hit AS (
  SELECT book_id, page, CASE WHEN {_ok(P.DOTTED_3, 2)} THEN 3 WHEN {_ok(P.CHAPTER, 2)} THEN 1 ELSE 2 END::bigint AS level,
    CASE WHEN {_ok(P.DOTTED_3, 2)} THEN {S.rx('line', P.DOTTED_3, 1)} || ' ' || {_t(P.DOTTED_3, 2)}
         WHEN {_ok(P.CHAPTER, 2)} THEN '第' || {_NUMBER} || '章 ' || {_t(P.CHAPTER, 2)}
         WHEN {_ok(P.PLAIN_SECTION, 2)} THEN '第' || {_NUMBER} || '节 ' || {_t(P.PLAIN_SECTION, 2)}
         ELSE {S.rx('line', P.DOTTED_2, 1)} || ' ' || {_t(P.DOTTED_2, 2)} END AS title
  FROM cut WHERE {_ok(P.DOTTED_3, 2)} OR {_ok(P.CHAPTER, 2)} OR {_ok(P.PLAIN_SECTION, 2)} OR {_ok(P.DOTTED_2, 2)}
  QUALIFY row_number() OVER (PARTITION BY book_id, page ORDER BY i) = 1),
 found AS (SELECT book_id, page, level, title FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM hit) WHERE n >= 2
  QUALIFY row_number() OVER (PARTITION BY book_id, {S.outline_key('title', 'level')} ORDER BY page, level, title) = 1),
 outline AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, level, title) - 1 AS seq FROM found)"""
_LAYOUT = cleaning.ROLES + f""", titles AS (
  SELECT book_id, page, block_no, {S.strip('text')} AS title FROM roles WHERE role = 'title'),
 ranked AS (SELECT *, CASE WHEN {S.rm('title', f"第[{P.SPACE}]*[{P.NUM}]+[{P.SPACE}]*[章篇编部]")} THEN 1
      WHEN {S.rm('title', f"第[{P.SPACE}]*[{P.NUM}]+[{P.SPACE}]*节")} THEN 2
      WHEN {S.rm('title', "^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{1,2}")} THEN 3 ELSE 2 END::bigint AS level,
      count(*) OVER (PARTITION BY book_id) AS n FROM titles WHERE title <> '' AND length(title) <= 50),
 layout_headings AS (SELECT book_id, page, block_no, level, title FROM ranked WHERE n >= 3
  QUALIFY row_number() OVER (PARTITION BY book_id, {S.rr('title', rf"[{P.SPACE}，。、|｜.．:：—-]+")} ORDER BY page, block_no, level, title) = 1)"""
_LINE_BOOKS = """line_books AS (
  SELECT doc_id AS book_id, 'Book ' || doc_id AS title, len(string_split(text, chr(10))) AS total_pages FROM documents)"""
_TREE = OUTLINE + ", " + _LINE_BOOKS + """, levelled AS (
  SELECT book_id, seq AS order_index, title, level - min(level) OVER (PARTITION BY book_id) + 1 AS level, page AS start_page FROM outline),
 parented AS (SELECT a.*, (SELECT max(b.order_index) FROM levelled b WHERE b.book_id = a.book_id AND b.order_index < a.order_index
    AND b.level < a.level) AS parent_index FROM levelled a),
 followed AS (SELECT *, lead(start_page) OVER (PARTITION BY book_id, parent_index ORDER BY order_index) AS following FROM parented),
 tree AS (SELECT k.book_id, coalesce(order_index, 0) AS order_index, parent_index, coalesce(f.title, '全书') AS title, coalesce(level, 1) AS level,
    coalesce(start_page, 1) AS start_page, CASE WHEN order_index IS NULL THEN greatest(total_pages, 1)
      ELSE greatest(start_page, coalesce(following - 1, total_pages)) END AS end_page
  FROM line_books k LEFT JOIN followed f ON k.book_id = f.book_id)"""
_PARAGRAPHS = S.LINES + """, paragraphs AS (
  SELECT book_id, n AS idx, CASE n % 6 WHEN 1 THEN 'Heading 1' WHEN 3 THEN '标题 2' ELSE 'Normal' END AS style,
   CASE n % 6 WHEN 5 THEN '第' || (n + 1) || '章 ' || regexp_extract(line, '^[^ ]+', 0) || ' 12'
              WHEN 4 THEN '一、' || regexp_extract(line, '^[^ ]+', 0)
              WHEN 2 THEN '第' || (n + 1) || '节：' || regexp_extract(line, '^[^ ]+', 0) || '（3）' ELSE line END AS text FROM lines)"""
_PNUM = S.rx("text", f"第[{P.SPACE}]*([{P.NUM}]+)", 1)
_SEGMENTS = _PARAGRAPHS + f""", para AS (SELECT book_id, idx, style, {S.strip('text')} AS text FROM paragraphs WHERE {S.strip('text')} <> ''),
 kinds AS (SELECT *, CASE style WHEN 'Heading 1' THEN 1 WHEN '标题 2' THEN 2 END AS styled,
   CASE WHEN style <> 'Normal' THEN 'styled' WHEN {S.rm('text', P.CHAPTER)} AND length(text) <= 45 THEN 'chapter'
        WHEN {S.rm('text', P.SECTION)} AND length(text) <= 45 THEN 'section'
        WHEN {S.rm('text', '^[一二三四五六七八九十]+、')} AND length(text) BETWEEN 2 AND 40 THEN 'listed' END AS kind FROM para),
 named AS (SELECT *, CASE kind WHEN 'chapter' THEN '第' || {_PNUM} || '章 ' || {S.clean_office_heading(S.rx('text', P.CHAPTER, 2))}
    WHEN 'section' THEN '第' || {_PNUM} || '节 ' || {S.clean_office_heading(S.rx('text', P.SECTION, 2))}
    WHEN 'styled' THEN text WHEN 'listed' THEN text END AS heading,
    CASE kind WHEN 'styled' THEN styled = 1 WHEN 'chapter' THEN true END AS opens_chapter FROM kinds),
 carried AS (SELECT *, coalesce(last_value(opens_chapter IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_chapter,
    heading IS NOT NULL AND row_number() OVER (PARTITION BY book_id, heading ORDER BY idx) = 1 AS opens FROM named),
 paged AS (SELECT *, sum(opens::int) OVER (PARTITION BY book_id ORDER BY idx) AS running,
    first_value(NOT opens) OVER (PARTITION BY book_id ORDER BY idx) AS leading_text FROM carried),
 segments AS (SELECT book_id, idx, (running + leading_text::int)::bigint AS page, text,
    CASE WHEN opens THEN CASE kind WHEN 'styled' THEN styled WHEN 'chapter' THEN 1 WHEN 'section' THEN 2
      ELSE CASE WHEN after_chapter THEN 2 ELSE 1 END END END::bigint AS level,
    CASE WHEN opens THEN {S.clean_office_heading('heading')} END AS title, CASE WHEN opens THEN running END::bigint AS toc_page FROM paged)"""
_OWNED = OUTLINE + S.CHUNKS[len(S.LINES):] + """, heads AS (
  SELECT book_id, page, title FROM outline QUALIFY row_number() OVER (PARTITION BY book_id, page ORDER BY level DESC, seq DESC) = 1),
 owned AS (SELECT c.book_id, c.chunk_index, c.content, (SELECT arg_max(h.title, h.page) FROM heads h WHERE h.book_id = c.book_id AND h.page <= c.page_start) AS title
  FROM chunks c)"""
_ADD = f"""CASE WHEN {S.strip('p')} <> '' AND NOT contains(acc, {S.strip('p')}) THEN {S.strip("acc || chr(10) || chr(10) || p")} ELSE acc END"""
_SECTIONS = _OWNED + f""", sections AS (
  SELECT book_id, title, list_reduce(list(content ORDER BY chunk_index), lambda acc, p: {_ADD}, '') AS text
  FROM owned WHERE title IS NOT NULL GROUP BY 1, 2)"""
_DOWNGRADE = r"""array_to_string(list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^#{{1,6}}[ \t]+.+$')
   THEN repeat('#', least(6, length(regexp_extract(l, '^(#{{1,6}})', 1)) + 2)) || ' ' || regexp_extract(l, '^#{{1,6}}[ \t]+(.+)$', 1) ELSE l END), chr(10))"""

ORACLE = {
    "two_level_heading_detection": f"WITH {_HEADINGS} SELECT book_id, page, level, title FROM headings",
    "toc_from_layout_titles": f"WITH {_LAYOUT} SELECT book_id, page, block_no, level, title FROM layout_headings",
    "three_level_heading_detection": f"WITH {OUTLINE} SELECT book_id, page, level, title FROM outline",
    "toc_deduplication": f"""WITH {OUTLINE}, both_ AS (SELECT book_id, title, level, page FROM outline UNION ALL
       SELECT book_id, title || ' （续）', level, page + 1 FROM outline),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, level, title) - 1 AS seq FROM both_),
      cleaned AS (SELECT book_id, {S.clean_outline_title('title')} AS title, level, page, seq FROM numbered),
      keyed AS (SELECT *, {S.outline_key('title', 'level')} AS key FROM cleaned WHERE title <> ''),
      kept AS (SELECT *, first_value(page * 1000000 + level * 100000 + seq) OVER (PARTITION BY book_id, key ORDER BY page, level, seq) AS place FROM keyed
       QUALIFY row_number() OVER (PARTITION BY book_id, key ORDER BY length(title), page, level, seq) = 1)
      SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY place) - 1 AS seq, title, level, page FROM kept""",
    "chinese_numeral_value": "SELECT p_partkey, p_partkey % 10000 AS value FROM part WHERE p_partkey % 10000 > 0",
    "toc_reordering": f"""WITH {OUTLINE}, items AS (SELECT *, CASE WHEN level = 1 THEN {S.rx('title', '第([0-9]+)章', 1)}::bigint END AS number,
        {S.rx('title', '^([0-9]{1,2})', 1)} AS lead_ FROM outline),
      ch AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY coalesce(number, 999), page, seq) AS rank FROM items WHERE level = 1),
      every AS (SELECT book_id, rank, 0 AS kind, seq, title, level, page FROM ch
        UNION ALL SELECT i.book_id, c.rank, 1, i.seq, i.title, i.level, i.page FROM items i JOIN ch c ON i.book_id = c.book_id AND i.lead_::bigint = c.number
          WHERE i.level <> 1 AND i.lead_ <> ''
        UNION ALL SELECT i.book_id, coalesce((SELECT arg_max(c.rank, c.page * 1000 + c.rank) FROM ch c WHERE c.book_id = i.book_id AND c.page <= i.page), 2147483647),
          2, i.seq, i.title, i.level, i.page FROM items i WHERE i.level <> 1 AND i.lead_ = '')
      SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY rank, kind, page, seq) AS position, title, level, page FROM every""",
    "toc_completeness_check": f"""WITH {OUTLINE}, numbered AS (SELECT book_id, level,
        CASE level WHEN 1 THEN 0 ELSE {S.rx('title', '^([0-9]+)[.]', 1)}::bigint END AS major,
        CASE level WHEN 3 THEN {S.rx('title', '^[0-9]+[.]([0-9]+)[.]', 1)}::bigint ELSE 0 END AS minor,
        CASE level WHEN 1 THEN {S.rx('title', '^第([0-9]+)章', 1)} WHEN 2 THEN {S.rx('title', '^[0-9]+[.]([0-9]+)', 1)}
          ELSE {S.rx('title', '^[0-9]+[.][0-9]+[.]([0-9]+)', 1)} END::bigint AS n FROM outline
        WHERE level <> 2 OR regexp_matches(title, '^[0-9]+[.]')),
      wanted AS (SELECT book_id, level, major, minor, unnest(range(1, max(n))) AS m FROM numbered GROUP BY 1, 2, 3, 4),
      missing AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM numbered x WHERE x.book_id = w.book_id AND x.level = w.level
         AND x.major = w.major AND x.minor = w.minor AND x.n = w.m)
         QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY level, major, minor, m) <= 30),
      counts AS (SELECT book_id, count(*) FILTER (level = 1) AS chapters, count(*) FILTER (level = 2) AS sections,
         count(*) FILTER (level = 3) AS subsections FROM outline GROUP BY 1)
      SELECT book_id, CASE level WHEN 1 THEN 'missing_chapter' WHEN 2 THEN 'missing_section' ELSE 'missing_subsection' END AS type,
        CASE level WHEN 1 THEN '第' || m || '章' WHEN 2 THEN major || '.' || m ELSE major || '.' || minor || '.' || m END AS ref,
        level, chapters, sections, subsections FROM missing JOIN counts USING (book_id)""",
    "chapter_tree_build": f"WITH {_TREE} SELECT book_id, order_index, parent_index, title, level, start_page, end_page FROM tree",
    "page_interval_gap_fill": f"""WITH {_TREE}, ch AS (SELECT * FROM tree WHERE order_index > 0),
      marked AS (SELECT *, greatest(1, coalesce(max(end_page + 1) OVER (PARTITION BY book_id ORDER BY start_page, order_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS cur FROM ch)
      SELECT book_id, order_index AS chapter_index, start_page, end_page FROM ch
      UNION ALL SELECT book_id, NULL, cur, start_page - 1 FROM marked WHERE cur < start_page
      UNION ALL SELECT b.book_id, NULL, coalesce(m, 0) + 1, total_pages FROM line_books b
        LEFT JOIN (SELECT book_id, max(end_page) AS m FROM ch GROUP BY 1) r ON b.book_id = r.book_id WHERE coalesce(m, 0) + 1 <= total_pages""",
    "toc_source_priority": f"""WITH {_HEADINGS}{_LAYOUT[len(S.LINES):]}, {_LINE_BOOKS}, every AS (
        SELECT book_id, 0::bigint AS priority, page, level, title FROM headings UNION ALL
        SELECT book_id, 1, page, level, title FROM layout_headings UNION ALL SELECT book_id, 2, 1, 1, '全书' FROM line_books)
      SELECT * FROM every QUALIFY priority = min(priority) OVER (PARTITION BY book_id)""",
    "paragraph_style_level": f"WITH {_PARAGRAPHS} SELECT book_id, idx, style, CASE style WHEN 'Heading 1' THEN 1 WHEN '标题 2' THEN 2 END::bigint AS level FROM paragraphs",
    "paragraph_page_segmentation": f"WITH {_SEGMENTS} SELECT * FROM segments",
    "office_toc": f"""WITH {_SEGMENTS} SELECT book_id, idx AS seq, title, level, toc_page AS page FROM segments WHERE title IS NOT NULL
      QUALIFY count(*) OVER (PARTITION BY book_id) >= 2""",
    "office_pages": f"WITH {_SEGMENTS} SELECT book_id, page, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM segments GROUP BY 1, 2",
    "office_heading_cleanup": f"WITH {_PARAGRAPHS} SELECT book_id, idx, {S.clean_office_heading('text')} AS title FROM paragraphs",
    "nested_chapter_view": f"""WITH RECURSIVE {S.CHAPTERS}, walk AS (SELECT chapter_id, 0::bigint AS depth, chapter_id::varchar AS path FROM chapters WHERE parent_id IS NULL
      UNION ALL SELECT c.chapter_id, depth + 1, path || '/' || c.chapter_id FROM chapters c JOIN walk w ON c.parent_id = w.chapter_id) SELECT * FROM walk""",
    "section_text_assembly": f"WITH {_SECTIONS} SELECT book_id, title, text FROM sections",
    "markdown_heading_downgrade": f"""WITH {S.CHUNKS}, m AS (SELECT chunk_id, '# A b' || chr(10) || '##### c' || chr(10) || '####### no' || chr(10) || '#x' || chr(10) || content AS t FROM chunks)
      SELECT chunk_id, {_DOWNGRADE.format(x='t')} AS markdown FROM m""",
    "book_markdown_assembly": f"""WITH {_SECTIONS}, {_LINE_BOOKS}, parts AS (SELECT o.book_id, o.seq, repeat('  ', (o.level - 1)::int) || '- ' || o.title AS outline_line,
        concat_ws(chr(10), repeat('#', least(6, o.level + 2)::int) || ' ' || o.title, '',
          CASE WHEN o.level = 1 THEN concat_ws(chr(10), '<details>', '<summary>💡 AI 精读总结（点击展开/收起）</summary>', '', '### Summary', '##### Point', o.title, '', '</details>', '', '---', '') END,
          CASE WHEN coalesce(s.text, '') <> '' THEN concat_ws(chr(10), CASE WHEN o.level = 1 THEN '### 📄 章节原文' || chr(10) END, s.text, '') END) AS body
        FROM outline o LEFT JOIN sections s ON o.book_id = s.book_id AND o.title = s.title)
      SELECT k.book_id, '# 《' || any_value(k.title) || '》' || chr(10) || chr(10) || '> 由标题目录、精读总结与正文生成' || chr(10) || chr(10) || '## 📑 目录' || chr(10)
        || string_agg(outline_line, chr(10) ORDER BY seq) || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY seq) AS markdown
      FROM line_books k JOIN parts p ON k.book_id = p.book_id GROUP BY k.book_id""",
    "structured_document": f"""WITH {S.CHUNKS}, {S.CHAPTERS} SELECT h.book_id, h.chapter_id, parent_id, title, level, order_index,
        coalesce(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index), '') AS text
      FROM chapters h LEFT JOIN chunks c ON h.chapter_id = c.chapter_id GROUP BY ALL""",
}
