"""SQL fragments shared by the statements the results are checked against."""

from __future__ import annotations

from quire.functions import patterns as P


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(P.SPACE_CHARS)})"


def round_half_even(x: str, digits: int) -> str:
    """Rounding by the exact value of a double, in whole numbers."""

    def scaled(places: int) -> str:
        whole = f"((({x}) * {2**places}::double)::hugeint * {10**digits})"
        unit, half = f"{2**places}::hugeint", f"{2 ** (places - 1)}::hugeint"
        low = f"({whole} // {unit})"
        return f"({low} + CASE WHEN {whole} % {unit} > {half} OR ({whole} % {unit} = {half} AND {low} % 2 = 1) THEN 1 ELSE 0 END)"

    return (
        f"(CASE WHEN ({x}) < {2.0**-9} THEN {scaled(71)} WHEN ({x}) < 1 THEN {scaled(62)} ELSE {scaled(52)} END)::double / {10**digits}"
    )


def rr(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def rm(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def rx(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def join_spaced_han(x: str) -> str:
    pattern = rf"([{P.HAN}])[{P.SPACE}]+([{P.HAN}])"
    return rr(rr(x, pattern, r"\1\2"), pattern, r"\1\2")


def clean_heading(x: str) -> str:
    x = rr(strip(x), rf"[{P.SPACE}]*[0-9{P.SPACE}]+$")
    x = rr(x, rf"\([a-zA-Z{P.SPACE}]+$")
    for pattern in (P.PROSE_TAILS[0], "|".join(P.PROSE_TAILS[1:])):
        x = rr(x, pattern)
    return f"trim({join_spaced_han(x)}, {q(' ，。、|｜')})"


def clean_outline_title(x: str) -> str:
    x = rr(strip(x), rf"[{P.SPACE}]*[0-9]+[.．、]?[{P.SPACE}]*$")
    x = rr(x, rf"[{P.SPACE}]*[0-9]+$")
    x = rr(x, rf"厂[{P.SPACE}]*$")
    x = rr(x, rf"[（(][^）)]*[)）][{P.SPACE}]*$")
    return f"trim({join_spaced_han(x)}, {q(' ，。、|｜.．')})"


def clean_office_heading(x: str) -> str:
    x = rr(strip(x), rf"[{P.SPACE}]*[0-9{P.SPACE}]+$")
    x = rr(x, rf"[（(][0-9]+[）)][{P.SPACE}]*$")
    x = rr(x, rf"20[0-9]{{2}}[{P.SPACE}]*年?[{P.SPACE}]*(?:简答|论述|名词解释|计算|问答|考|预测).*$")
    x = rr(x, rf"（20[0-9]{{2}}年?[^）]*）[{P.SPACE}]*$")
    return f"trim({join_spaced_han(x)}, {q(' ，。、|｜:：')})"


def outline_key(title: str, level: str) -> str:
    bare = rr(clean_outline_title(title), rf"[{P.SPACE}，。、|｜.．:：—-]+")
    return f"({level})::varchar || '|' || {bare}"


LINES = """lines AS (
  SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)"""
PAGES = LINES + """, pages_ AS (
  SELECT book_id, n // 3 + 1 AS page, string_agg(line, chr(10) ORDER BY n) AS text FROM lines GROUP BY 1, 2)"""
RAW_PAGES = PAGES + """, raw_pages AS (
  SELECT book_id, page, concat_ws(chr(10), '  Reader Vol ' || book_id, string_split(text, chr(10))[1], text, '', '',
    '日日日日 ok', 'func-', 'tion x', '第3章 标题', '中文断行', '继续。。。', '- ' || page || ' -') AS text FROM pages_)"""
_NAME = "(regexp_extract(line, '^[^ ]+', 0) || ' topic  ' || (n + 1))"
HEADING_PAGES = LINES + f""", heading_pages AS (
  SELECT book_id, n + 1 AS page,
    CASE WHEN (book_id + n) % 5 = 3 THEN line ELSE
      (CASE WHEN (book_id + n) % 9 = 4 THEN 'Contents ..... 1' || chr(10) ELSE '' END) || chr(10) || ' ' ||
      (CASE n % 4 WHEN 0 THEN '第 ' || (n // 4 + 1) || ' 章 ' || {_NAME}
                  WHEN 1 THEN (n // 4 + 1) || '.1 ' || {_NAME}
                  WHEN 2 THEN '第' || (n // 4 + 1) || '节 | ' || {_NAME}
                  ELSE (n // 4 + 1) || '.2.2 ' || {_NAME} END) || chr(10) || line END AS text FROM lines)"""
_FW = "regexp_extract(line, '^[^ ]+', 0)"
BLOCKS = LINES + f""", each_page AS (SELECT DISTINCT book_id, n // 3 + 1 AS page FROM lines), blocks AS (
  SELECT book_id, n // 3 + 1 AS page, n % 3 + 1 AS block_no,
    CASE WHEN n % 11 = 10 THEN '∑∫≤≥ x = y' WHEN n % 7 = 0 THEN '第' || (n // 7 + 1) || '章 ' || {_FW}
         WHEN n % 7 = 3 THEN (n // 7 + 1) || '.1 ' || {_FW} WHEN n % 14 = 5 THEN (n // 7 + 1) || '.1.1 ' || {_FW}
         ELSE line END AS text,
    (CASE WHEN n % 7 = 0 THEN 16.0 WHEN n % 14 = 5 THEN 14.0 WHEN n % 7 = 3 THEN 12.62 WHEN n % 5 = 4 THEN 11.96
         WHEN n % 13 = 12 THEN 10.02 ELSE 12.04 END)::double AS size,
    CASE WHEN n % 7 = 3 THEN 16 ELSE 0 END AS flags,
    (CASE WHEN n % 17 = 16 THEN 30 ELSE n % 3 * 100 + 200 END)::double AS y0,
    (CASE WHEN n % 17 = 16 THEN 50 ELSE n % 3 * 100 + 240 END)::double AS y1 FROM lines
  UNION ALL SELECT book_id, page, 0, 'Reader Vol ' || book_id, 9, 0, 10, 20 FROM each_page
  UNION ALL SELECT book_id, page, 99, 'All rights reserved', 9, 0, 780, 790 FROM each_page)"""
CHUNKS = PAGES + """, chunks AS (
  SELECT book_id * 100000 + page - 1 AS chunk_id, book_id,
    CASE WHEN NOT (book_id % 10 = 9 AND page = 1) THEN book_id * 1000 + (page - 1) // 4 END AS chapter_id,
    page - 1 AS chunk_index, page AS page_start, page AS page_end, text AS content, length(text) AS word_count FROM pages_)"""
CHAPTERS = """chapters AS (
  SELECT book_id * 1000 + k AS chapter_id, book_id, CASE WHEN k % 3 <> 0 THEN book_id * 1000 + k - k % 3 END AS parent_id,
    'Chapter ' || (k + 1) AS title, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END::bigint AS level, k AS order_index,
    k * 4 + 1 AS start_page, least(k * 4 + 4, total) AS end_page
  FROM (SELECT book_id, total, unnest(range(0, (total - 1) // 4 + 1)) AS k FROM
    (SELECT doc_id AS book_id, (len(string_split(text, chr(10))) + 2) // 3 AS total FROM documents)))"""
BOOKS = """books AS (
  SELECT doc_id AS book_id, 'Book ' || doc_id AS title, source AS file_type, lang AS category,
    (len(string_split(text, chr(10))) + 2) // 3 AS total_pages FROM documents)"""
QUIZZES = """quizzes AS (
  SELECT p_partkey AS quiz_id, (p_size % 5)::bigint AS book_id, p_size::bigint AS chapter_id,
    CASE p_partkey % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'blank' ELSE 'short' END AS q_type,
    p_name AS question, p_type, p_brand AS answer FROM part)"""
QUIZ_CHAPTERS = """quiz_chapters AS (
  SELECT chapter_id, chapter_id % 5 AS book_id, 'Chapter ' || chapter_id AS title, chapter_id AS order_index FROM
    (SELECT p_size::bigint AS chapter_id FROM part UNION SELECT n_nationkey::bigint + 41 FROM nation))"""
QUIZ_BOOKS = "quiz_books AS (SELECT r_regionkey::bigint AS book_id, r_name AS title FROM region)"
ATTEMPTS = """attempts AS (
  SELECT event_id AS attempt_id, json_extract_string(props, '$.k')::bigint * 20 + user_id % 20 AS quiz_id,
    ' brand#' || (user_id % 25) || ' ' AS user_answer,
    CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END::bigint AS is_correct, ts AS answered_at FROM events)"""
LATEST = ATTEMPTS + """, latest AS (
  SELECT quiz_id, is_correct, answered_at, attempt_id FROM attempts
  QUALIFY row_number() OVER (PARTITION BY quiz_id ORDER BY answered_at DESC, attempt_id DESC) = 1)"""
NODES = """nodes AS (
  SELECT p_partkey AS node_id, CASE WHEN p_partkey >= 4 THEN p_partkey // 4 END AS parent_id, p_name AS title,
    p_type AS note, (p_size % 5)::bigint AS book_id, CASE WHEN p_partkey % 2 = 0 THEN p_size::bigint END AS chapter_id,
    CASE p_size % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'fuzzy' ELSE 'known' END AS mastery,
    p_partkey % 4 AS order_index FROM part)"""
ANNOTATIONS = """annotations AS (
  SELECT o_orderkey AS annotation_id, o_custkey % 5 AS book_id, o_orderkey % 40 + 1 AS page,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'quote ' || o_orderpriority || chr(10) || 'line ' || o_orderkey END AS text,
    CASE WHEN o_orderkey % 3 = 0 THEN 'note' || chr(10) || o_orderstatus END AS note,
    CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS knowledge_node_id FROM orders)"""
CHAT_LOGS = """chat_logs AS (
  SELECT a.conv_id * 1000 + a.turn AS chat_id, a.conv_id % 5 AS book_id, a.text AS question,
    b.text || ' [资料' || (a.turn + 1) || '][资料' || (a.conv_id % 4) || ']' AS answer, a.turn % 4 + 1 AS n_sources,
    a.conv_id * 60 + a.turn AS created_at
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""
TOKENS = CHUNKS + f""", tokens AS (
  SELECT chunk_id, book_id, unnest(regexp_extract_all(lower(content), {q(P.WORD)})) AS token FROM chunks)"""
