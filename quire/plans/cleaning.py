"""Registered queries: page cleaning and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as X
from quire.functions import titles as T
from quire.operators import layout
from quire.plans import twin as S
from quire.sources import model as M


def _running(spark: SparkSession, d: str) -> DataFrame:
    return layout.running_lines(M.page_blocks(spark, d))


def with_running_lines(pages: DataFrame, running: DataFrame) -> DataFrame:
    """Attach the running headers and footers of the book to each page."""
    listed = running.groupBy("book_id").agg(F.sort_array(F.collect_set("text")).alias("listed"))
    return pages.join(listed, "book_id", "left")


def _apply(step):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return M.raw_pages(spark, d).select("book_id", "page", step(F.col("text")).alias("text"))

    return run


def _by_line(step):
    return _apply(lambda text: F.array_join(step(X.lines_of(text)), "\n"))


def header_footer_lines(spark: SparkSession, d: str) -> DataFrame:
    pages = with_running_lines(M.raw_pages(spark, d), _running(spark, d))
    return pages.select(
        "book_id", "page", F.array_join(X.drop_listed_lines(X.lines_of(F.col("text")), F.col("listed")), "\n").alias("text")
    )


def cleaned_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = with_running_lines(M.raw_pages(spark, d), _running(spark, d))
    return pages.select("book_id", "page", X.clean_text(F.col("text"), F.col("listed")).alias("text"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return layout.body_font_size(M.page_blocks(spark, d), M.books(spark, d))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return layout.classify_blocks(M.page_blocks(spark, d), _sizes(spark, d))


def block_roles(spark: SparkSession, d: str) -> DataFrame:
    return layout.final_roles(_classified(spark, d), _running(spark, d))


QUERIES = {
    "header_footer_line_removal": header_footer_lines,
    "page_number_line_removal": _by_line(X.drop_page_numbers),
    "adjacent_duplicate_line_removal": _by_line(X.drop_repeated_lines),
    "repeated_character_collapse": _apply(X.collapse_repeats),
    "broken_english_word_join": _apply(X.join_broken_words),
    "broken_chinese_line_join": _apply(X.join_broken_lines),
    "clean_text": cleaned_pages,
    "body_font_size": _sizes,
    "block_role_classifier": lambda s, d: _classified(s, d).select("book_id", "page", "block_no", "role"),
    "running_header_footer": _running,
    "title_line_set": lambda s, d: layout.title_lines(block_roles(s, d)),
    "clean_page_text": lambda s, d: layout.clean_page_text(block_roles(s, d)),
    "layout_statistics": lambda s, d: layout.layout_statistics(_sizes(s, d), _running(s, d)),
    "heading_text_cleanup": lambda s, d: M.heading_pages(s, d).select(
        "book_id", "page", T.clean_heading(F.col("text")).alias("title")
    ),
}

_LINES_OF = "string_split(text, chr(10))"


def _join(lines: str) -> str:
    return f"array_to_string({lines}, chr(10))"


def _blanked(lines: str) -> str:
    return f"list_transform({lines}, lambda l: CASE WHEN {S.strip('l')} = '' THEN '' ELSE l END)"


def _without_listed(lines: str) -> str:
    return f"list_filter({_blanked(lines)}, lambda l: l = '' OR NOT coalesce(list_contains(listed, {S.strip('l')}), false))"


def _without_numbers(lines: str) -> str:
    return f"list_filter({lines}, lambda l: NOT {S.rm(S.strip('l'), P.PAGE_NUMBER_LINE)})"


def _without_repeats(col: str) -> str:
    previous = f"CASE WHEN i = 1 THEN '' ELSE {S.strip(f'{col}[i - 1]')} END"
    return f"list_transform(list_filter({col}, lambda l, i: {S.strip('l')} <> {previous}), lambda l: CASE WHEN {S.strip('l')} = '' THEN '' ELSE l END)"


def _collapsed(x: str) -> str:
    # RE2 has no back-references; these are the only repeated characters the rules put in.
    return S.rr(S.rr(x, "日{3,}", "日"), "。{3,}", "。")


def _words_joined(x: str) -> str:
    return S.rr(S.rr(x, r"([A-Za-z])-\n([a-z])", r"\1\2"), r"([a-z])\n([a-z])", r"\1\2")


def _title(x: str) -> str:
    return f"(length({S.strip(x)}) <= 30 AND {S.rm(S.strip(x), P.TITLE_LINE)})"


def _lines_joined(x: str) -> str:
    last, line = "acc[len(acc)]", "l[1]"
    join = (
        f"{S.strip(last)} <> '' AND NOT {S.rm(S.strip(last), P.CLOSED_LINE)} AND NOT {_title(last)} AND NOT {_title(line)}"
    )
    step = (
        f"CASE WHEN {S.strip(line)} = '' AND len(acc) = 0 THEN acc WHEN {S.strip(line)} = '' THEN list_append(acc, '') "
        f"WHEN len(acc) = 0 THEN [{line}] WHEN {join} THEN list_append(acc[1:len(acc) - 1], {last} || {S.strip(line)}) "
        f"ELSE list_append(acc, {line}) END"
    )
    return _join(
        f"list_reduce(list_transform(string_split({x}, chr(10)), lambda y: [y]), lambda acc, l: {step}, []::varchar[])"
    )


_RUNNING = S.BLOCKS + """, running AS (
  SELECT book_id, text, n_pages, CASE WHEN top >= 0.8 * n THEN 'header' WHEN bottom >= 0.8 * n THEN 'footer' END AS running_role
  FROM (SELECT book_id, text, count(DISTINCT page) AS n_pages, count(*) AS n, count(*) FILTER (y0 < 800 * 0.08) AS top,
          count(*) FILTER (y1 > 800 * (1 - 0.08)) AS bottom FROM blocks WHERE length(text) <= 60 GROUP BY 1, 2)
  WHERE n_pages >= 3 AND (top >= 0.8 * n OR bottom >= 0.8 * n))"""
_SIZES = S.BLOCKS + """, sizes AS (
  SELECT book_id, size AS body_size FROM (SELECT book_id, round(size, 1) AS size, count(*) AS n FROM blocks WHERE size > 0 GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY n DESC, size) = 1)"""
_ROLE = f"""CASE WHEN y0 < 800 * 0.08 THEN 'header' WHEN y1 > 800 * (1 - 0.08) THEN 'footer'
   WHEN (length(text) - length(translate(text, {S.q(P.MATH_CHARS)}, ''))) / greatest(length(text), 1) > 0.05 THEN 'formula'
   WHEN size >= body_size * 1.15 OR (flags & 16 > 0 AND length(text) <= 40 AND size >= body_size * 1.05) THEN 'title'
   ELSE 'body' END"""
_RUNNING_ONLY = _RUNNING[len(S.BLOCKS):]
ROLES = _SIZES + _RUNNING_ONLY + f""", roles AS (
  SELECT b.book_id, page, block_no, b.text, coalesce(running_role, {_ROLE.replace('text', 'b.text')}) AS role
  FROM blocks b JOIN sizes USING (book_id) LEFT JOIN running r ON b.book_id = r.book_id AND b.text = r.text)"""
_LISTED = ", listed AS (SELECT book_id, list(DISTINCT text) AS listed FROM running GROUP BY 1)"
_RAW_AND_LISTED = S.RAW_PAGES + _RUNNING[len(S.LINES):] + _LISTED


def _raw(expression: str) -> str:
    return f"WITH {S.RAW_PAGES} SELECT book_id, page, {expression} AS text FROM raw_pages"


CLEANED = _RAW_AND_LISTED + f""", kept AS (
  SELECT book_id, page, {_without_numbers(_without_listed(_LINES_OF))} AS a FROM raw_pages LEFT JOIN listed USING (book_id)),
 once AS (SELECT book_id, page, {_join(_without_repeats('a'))} AS text FROM kept),
 cleaned AS (SELECT book_id, page, {S.strip(_lines_joined(_words_joined(_collapsed('text'))))} AS text FROM once)"""

ORACLE = {
    "header_footer_line_removal": f"WITH {_RAW_AND_LISTED} SELECT book_id, page, {_join(_without_listed(_LINES_OF))} AS text FROM raw_pages LEFT JOIN listed USING (book_id)",
    "page_number_line_removal": _raw(_join(_without_numbers(_LINES_OF))),
    "adjacent_duplicate_line_removal": f"WITH {S.RAW_PAGES}, a AS (SELECT book_id, page, {_LINES_OF} AS a FROM raw_pages) SELECT book_id, page, {_join(_without_repeats('a'))} AS text FROM a",
    "repeated_character_collapse": _raw(_collapsed("text")),
    "broken_english_word_join": _raw(_words_joined("text")),
    "broken_chinese_line_join": _raw(_lines_joined("text")),
    "clean_text": f"WITH {CLEANED} SELECT book_id, page, text FROM cleaned",
    "body_font_size": f"WITH {_SIZES} SELECT book_id, body_size FROM sizes",
    "block_role_classifier": f"WITH {_SIZES} SELECT book_id, page, block_no, {_ROLE} AS role FROM blocks JOIN sizes USING (book_id)",
    "running_header_footer": f"WITH {_RUNNING} SELECT book_id, text, n_pages, running_role FROM running",
    "title_line_set": f"WITH {ROLES} SELECT DISTINCT book_id, text FROM roles WHERE role = 'title'",
    "clean_page_text": f"WITH {ROLES} SELECT book_id, page, {S.strip('string_agg(text, chr(10) ORDER BY block_no)')} AS text FROM roles WHERE role NOT IN ('header', 'footer') GROUP BY 1, 2",
    "layout_statistics": f"""WITH {_SIZES}{_RUNNING_ONLY} SELECT s.book_id, body_size,
      count(*) FILTER (running_role = 'header') AS header_count, count(*) FILTER (running_role = 'footer') AS footer_count
      FROM sizes s LEFT JOIN running r ON s.book_id = r.book_id GROUP BY 1, 2""",
    "heading_text_cleanup": f"WITH {S.HEADING_PAGES} SELECT book_id, page, {S.clean_heading('text')} AS title FROM heading_pages",
}
