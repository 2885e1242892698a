"""Registered queries: listings, digests, change detection, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import lexical, reports
from quire.plans import enrichment, outline
from quire.plans import twin as S
from quire.session import written
from quire.sources import model as M


def _books(spark: SparkSession, d: str) -> DataFrame:
    return M.books(spark, d).withColumn("created_at", F.col("book_id") % 97)


def _deep(spark: SparkSession, d: str) -> DataFrame:
    """Analysis state of the labelled books; good ones are done and have a summary per level-1 chapter."""
    summary = lambda k: F.struct(
        F.concat(F.lit("Chapter "), F.lit(k)).alias("title"), F.concat(F.lit(f"Summary {k} of "), F.col("doc_id")).alias("summary")
    )
    return M.table(spark, d, "labels").select(
        F.col("doc_id").alias("book_id"),
        F.when(F.col("quality") == 1, "done").otherwise("none").alias("status"),
        F.concat(F.lit("# Deep "), F.col("doc_id")).alias("markdown"),
        F.array(*[summary(k) for k in (1, 2, 4)]).alias("summaries"),
    )


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "labels").select(
        F.col("doc_id").alias("task_id"), (F.col("doc_id") % 300).alias("book_id"),
        F.when(F.col("toxic") == 1, "running").otherwise("done").alias("status"),
        F.concat(F.lit("import "), F.col("doc_id")).alias("message"),
    )


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return reports.library_listing(
        _books(spark, d), M.quizzes(spark, d), M.chapters(spark, d), _deep(spark, d), _tasks(spark, d), 2, 50
    )


def _digests(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    books = M.books(spark, d)
    if only is not None:
        books = books.join(only.select("book_id").distinct(), "book_id", "left_semi")
    return reports.book_digest(
        books, M.chapters(spark, d), M.chunks(spark, d), enrichment.analysis(spark, d, only), _deep(spark, d)
    )


def _digest(spark: SparkSession, d: str) -> DataFrame:
    return _digests(spark, d).select(
        "book_id", "title", "category", "file_type", "total_pages",
        F.array_join(F.transform("chapters", lambda c: F.concat(c["title"], F.when(c["has_content"], "+").otherwise("-"))), ",").alias("chapters"),
        F.array_join("keywords", ",").alias("keywords"),
        F.array_join(F.transform("definitions", lambda x: x["term"]), ",").alias("definitions"),
        F.array_join(F.transform("theorems", lambda x: x["type"]), ",").alias("theorems"),
        F.col("has_deep_analysis").cast("bigint").alias("has_deep_analysis"),
    )


def _combined(spark: SparkSession, d: str) -> DataFrame:
    """One request per language and source, for all their books."""
    requests = M.books(spark, d).select(F.concat_ws("/", "category", "file_type").alias("request_id"), "book_id")
    picked = written(reports.picked_books(requests), "picked")
    return reports.combined_digest(picked, _digests(spark, d, picked), _deep(spark, d))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Stored hashes that are right, stale, missing, or of chapters that are gone."""
    k = F.col("chapter_id")
    now = reports.chapter_material(M.chunks(spark, d), limit=2147483647)
    stored = now.filter(k % 3 != 2).select(
        F.when(k % 3 == 1, k + 900).otherwise(k).alias("chapter_id"), F.md5("text").alias("hash"),
        F.when(k % 2 == 0, "s").alias("summary"),
    )
    return reports.changed_chapters(M.chapters(spark, d), M.chunks(spark, d), stored)


def _associations(spark: SparkSession, d: str) -> DataFrame:
    """Requests to tag the labelled books by name."""
    named = M.table(spark, d, "labels").select(
        F.col("doc_id").alias("book_id"),
        F.explode(F.array(F.lit(" en "), F.concat(F.lit("shelf "), F.col("doc_id") % 7), F.lit("  "))).alias("name"),
    )
    wanted = named.select("book_id", F.trim("name").alias("name")).filter("name <> ''").distinct()
    tags = enrichment.library_tags(spark, d)
    new_tags, new_links = lexical.assign_tags(wanted, tags, enrichment.library_links(spark, d))
    return new_links.join(tags.select("tag_id", "name").unionByName(new_tags), "tag_id")


def _history(spark: SparkSession, d: str) -> DataFrame:
    sources = F.to_json(F.array(F.struct((F.col("chat_id") * 10).alias("chunk_id"), F.col("n_sources").alias("page"))))
    logs = M.chat_logs(spark, d).withColumn("sources_json", F.when(F.col("chat_id") % 2 == 0, sources))
    return reports.chat_history(logs, 2, 20).select(
        "chat_id", "question", "total", F.size("sources").cast("bigint").alias("n"),
        F.get("sources", F.lit(0))["chunk_id"].alias("first_chunk"), F.get("sources", F.lit(0))["page"].alias("first_page"),
    )


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return reports.recent(
        M.table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), "o_orderpriority",
                                           F.col("o_orderdate").cast("string").alias("created_at")),
        "created_at", "report_id",
    ).select("report_id", F.col("o_orderpriority").alias("content"))


def _dialogues(spark: SparkSession, d: str) -> DataFrame:
    turns = M.table(spark, d, "conversations")
    context = turns.filter("turn = 0").select("conv_id", F.repeat("text", 20).alias("context"))
    # Blocks of five turns and four turns of history, so that the test data crosses block borders.
    shown = reports.dialogue_context(turns, context, last=4, block=5)
    return shown.select(
        "conv_id", "turn", "context",
        F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), h["text"])), "|").alias("history"),
    )


QUERIES = {
    "library_listing": _listing,
    "book_digest": _digest,
    "multi_book_digest": _combined,
    "cached_chapter_summary": lambda s, d: reports.chapter_summaries(M.chapters(s, d), _deep(s, d)).select(
        "book_id", "n", "title", "summary"
    ),
    "incremental_change_detection": _changes,
    "tag_usage": lambda s, d: reports.tag_usage(enrichment.library_tags(s, d), enrichment.library_links(s, d)),
    "tag_association": _associations,
    "chat_history": _history,
    "annotations_by_page": lambda s, d: reports.by_page(M.annotations(s, d), "annotation_id").select("book_id", "page", "annotation_id", "text"),
    "recent_reports": _reports,
    "dialogue_context_window": _dialogues,
    "chapter_material": lambda s, d: reports.chapter_material(M.chunks(s, d)),
    "chapter_material_for_expansion": lambda s, d: reports.chapter_material(M.chunks(s, d), 10, 500, 6000),
    "chapter_material_for_review": lambda s, d: reports.chapter_material(M.chunks(s, d), 8, 400, 4000),
    "annotation_export": lambda s, d: reports.annotation_export(M.annotations(s, d), M.quiz_books(s, d)),
}

_TAGS = "tags AS (SELECT name, row_number() OVER (ORDER BY name) AS tag_id FROM (SELECT DISTINCT lang AS name FROM documents))"
_LINKS = "links AS (SELECT doc_id AS book_id, tag_id FROM documents JOIN tags ON lang = name WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"
_DIGEST = enrichment._DEFINITIONS + enrichment._THEOREMS + f""", {enrichment._KEYWORDS}{S.CHUNKS[len(S.LINES):]}, {S.CHAPTERS}, {S.BOOKS},
  kw AS (SELECT book_id, string_agg(w, ',' ORDER BY r) AS keywords, string_agg(w, '、' ORDER BY r) FILTER (r <= 20) AS top20 FROM keyword_rows GROUP BY 1),
  df AS (SELECT book_id, string_agg(term, ',' ORDER BY i) FILTER (i < 15) AS definitions, string_agg(term || '=' || substr(definition, 1, 60), '; ' ORDER BY i) FILTER (i < 8) AS top8 FROM definitions GROUP BY 1),
  th AS (SELECT book_id, string_agg(t.kind, ',' ORDER BY i) FILTER (i < 15) AS theorems FROM theorems GROUP BY 1),
  ch AS (SELECT book_id, string_agg(title || CASE WHEN chapter_id IN (SELECT chapter_id FROM chunks WHERE chapter_id IS NOT NULL) THEN '+' ELSE '-' END, ',' ORDER BY order_index) AS chapters,
     string_agg(title, '、' ORDER BY order_index) FILTER (order_index < 30) AS top30 FROM chapters GROUP BY 1)"""


def _material(where: str, content: str, limit: int) -> str:
    return f"""WITH {S.CHUNKS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY chunk_index) AS r FROM chunks WHERE chapter_id IS NOT NULL)
      SELECT chapter_id, substr(string_agg({content}, chr(10) ORDER BY chunk_index), 1, {limit}) AS text FROM ranked WHERE {where} GROUP BY 1"""


ORACLE = {
    "library_listing": f"""WITH {S.BOOKS}, {S.QUIZZES}, {S.CHAPTERS}, shown AS (SELECT * FROM books ORDER BY book_id % 97 DESC, book_id DESC LIMIT 50 OFFSET 50)
      SELECT s.book_id, title, file_type, category, total_pages, (SELECT count(*) FROM quizzes q WHERE q.book_id = s.book_id) AS quiz_count,
        (SELECT count(*) FROM chapters c WHERE c.book_id = s.book_id) AS chapter_count,
        coalesce((SELECT 'done' FROM labels l WHERE l.doc_id = s.book_id AND quality = 1), 'none') AS deep_status,
        (SELECT arg_max('import ' || doc_id, doc_id) FROM labels l WHERE l.doc_id % 300 = s.book_id AND toxic = 1) AS task_message, (SELECT count(*) FROM books) AS total FROM shown s""",
    "book_digest": f"""WITH {_DIGEST} SELECT b.book_id, title, category, file_type, total_pages, chapters, coalesce(keywords, '') AS keywords, coalesce(definitions, '') AS definitions,
        coalesce(theorems, '') AS theorems, (b.book_id IN (SELECT doc_id FROM labels WHERE quality = 1))::bigint AS has_deep_analysis
      FROM books b LEFT JOIN ch USING (book_id) LEFT JOIN kw USING (book_id) LEFT JOIN df USING (book_id) LEFT JOIN th USING (book_id)""",
    "multi_book_digest": f"""WITH {_DIGEST}, picked AS (SELECT category || '/' || file_type AS request_id, book_id, title, category, row_number() OVER (PARTITION BY category, file_type ORDER BY book_id) AS r FROM books
        QUALIFY row_number() OVER (PARTITION BY category, file_type ORDER BY book_id) <= 8),
      parts AS (SELECT request_id, r, '【文献《' || title || '》】' || CASE WHEN book_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN chr(10) || '# Deep ' || book_id
        ELSE '分类:' || category || ' 章节:' || top30 || chr(10) || '关键词:' || coalesce(top20, '') || chr(10) || '定义:' || coalesce(top8, '') END AS part
        FROM picked LEFT JOIN ch USING (book_id) LEFT JOIN kw USING (book_id) LEFT JOIN df USING (book_id))
      SELECT request_id, substr(string_agg(part, chr(10) || chr(10) ORDER BY r), 1, 25000) AS text FROM parts GROUP BY 1""",
    "cached_chapter_summary": f"""WITH {S.CHAPTERS}, top AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY order_index) AS n FROM chapters WHERE level = 1)
      SELECT book_id, n, title, 'Summary ' || (order_index + 1) || ' of ' || book_id AS summary FROM top WHERE title IN ('Chapter 1', 'Chapter 2', 'Chapter 4') AND book_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "incremental_change_detection": f"""WITH {S.CHUNKS}, {S.CHAPTERS}, now_ AS (SELECT chapter_id, md5(string_agg(content, chr(10) ORDER BY chunk_index)) AS h FROM chunks WHERE chapter_id IS NOT NULL GROUP BY 1),
      stored AS (SELECT CASE WHEN chapter_id % 3 = 1 THEN chapter_id + 900 ELSE chapter_id END AS chapter_id, h, chapter_id % 2 = 0 AS s FROM now_ WHERE chapter_id % 3 <> 2),
      cur AS (SELECT c.chapter_id, h FROM chapters c LEFT JOIN now_ USING (chapter_id))
      SELECT coalesce(c.chapter_id, s.chapter_id) AS chapter_id, c.h AS hash, CASE WHEN c.chapter_id IS NULL THEN 'gone' WHEN c.h IS NULL THEN 'empty' WHEN c.h = s.h AND s.s THEN 'reuse' ELSE 'redo' END AS action
      FROM cur c FULL JOIN stored s ON c.chapter_id = s.chapter_id""",
    "tag_usage": f"WITH {_TAGS}, {_LINKS} SELECT t.tag_id, name, count(book_id) AS book_count FROM tags t LEFT JOIN links l ON t.tag_id = l.tag_id GROUP BY 1, 2",
    "tag_association": f"""WITH {_TAGS}, {_LINKS}, wanted AS (SELECT doc_id AS book_id, 'en' AS name FROM labels UNION SELECT doc_id, 'shelf ' || (doc_id % 7) FROM labels),
      fresh AS (SELECT name, row_number() OVER (ORDER BY name) + (SELECT max(tag_id) FROM tags) AS tag_id FROM (SELECT DISTINCT name FROM wanted WHERE name NOT IN (SELECT name FROM tags))),
      every AS (SELECT * FROM tags UNION ALL SELECT * FROM fresh)
      SELECT tag_id, book_id, name FROM wanted JOIN every USING (name) WHERE (book_id, tag_id) NOT IN (SELECT book_id, tag_id FROM links)""",
    "chat_history": f"""WITH {S.CHAT_LOGS} SELECT chat_id, question, (SELECT count(*) FROM chat_logs) AS total, (chat_id % 2 = 0)::bigint AS n,
        CASE WHEN chat_id % 2 = 0 THEN chat_id * 10 END AS first_chunk, CASE WHEN chat_id % 2 = 0 THEN n_sources END AS first_page
      FROM (SELECT * FROM chat_logs ORDER BY created_at DESC, chat_id DESC LIMIT 20 OFFSET 20)""",
    "annotations_by_page": f"WITH {S.ANNOTATIONS} SELECT book_id, page, annotation_id, text FROM annotations",
    "recent_reports": "SELECT o_orderkey AS report_id, o_orderpriority AS content FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
    "dialogue_context_window": """SELECT c.conv_id, c.turn, coalesce(substr(repeat(z.text, 20), 1, 8000), '') AS context,
        coalesce((SELECT string_agg(h.role || ':' || h.text, '|' ORDER BY h.turn) FROM conversations h WHERE h.conv_id = c.conv_id AND h.turn BETWEEN c.turn - 4 AND c.turn - 1), '') AS history
      FROM conversations c LEFT JOIN conversations z ON z.conv_id = c.conv_id AND z.turn = 0""",
    "chapter_material": _material("true", "content", 12000),
    "chapter_material_for_expansion": _material("r <= 10", "substr(content, 1, 500)", 6000),
    "chapter_material_for_review": _material("r <= 8", "substr(content, 1, 400)", 4000),
    "annotation_export": f"""WITH {S.ANNOTATIONS}, {S.QUIZ_BOOKS} SELECT book_id, page, '## 第 ' || page || ' 页' || chr(10) ||
        string_agg(concat_ws(chr(10), '', '> ' || replace(text, chr(10), ' '), '- 📝 ' || replace(note, chr(10), ' ')), chr(10) ORDER BY annotation_id) || chr(10) AS markdown FROM annotations GROUP BY 1, 2
      UNION ALL SELECT book_id, 0, '# 标注导出（' || title || '）' || chr(10) FROM quiz_books WHERE book_id IN (SELECT book_id FROM annotations)""",
}
