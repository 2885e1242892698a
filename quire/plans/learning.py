"""Registered queries: quizzes, mastery, plans, knowledge trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import knowledge, mastery, planning, tree
from quire.plans import twin as S
from quire.sources import model as M

def _day(text: str) -> Column:
    return F.to_date(F.lit(text))


AS_OF = "2024-01-30"
PLAN_START = "2024-01-01"


def _mastery(spark: SparkSession, d: str) -> DataFrame:
    return mastery.chapter_mastery(M.quiz_chapters(spark, d), M.quizzes(spark, d), M.attempts(spark, d))


def _listing(spark: SparkSession, d: str, quizzes: DataFrame, page: int, size: int) -> DataFrame:
    shown = mastery.listing(quizzes, M.quiz_books(spark, d), M.quiz_chapters(spark, d), page, size)
    return shown.withColumn("options", F.array_join("options", "|"))


def _import(spark: SparkSession, d: str) -> DataFrame:
    incoming = M.quizzes(spark, d).withColumn("chapter_id", F.col("chapter_id") + 20)
    return mastery.import_quizzes(incoming, M.quiz_chapters(spark, d)).select(
        "quiz_id", "chapter_id", "book_id", F.col("accepted").cast("bigint").alias("accepted")
    )


def _quiz_context(spark: SparkSession, d: str) -> DataFrame:
    chapters = M.chapters(spark, d)
    summaries = chapters.filter("chapter_id % 2 = 0").select(
        "chapter_id", F.concat(F.lit("Summary of "), F.col("title")).alias("summary")
    )
    return mastery.quiz_context(chapters, M.chunks(spark, d), summaries)


def _check_ins(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "events").filter("event_type = 'purchase' and user_id < 3").select(F.to_date("ts").alias("date"))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    plan = planning.study_plan(M.knowledge_nodes(spark, d), _check_ins(spark, d), _day(AS_OF), _day(PLAN_START))
    return plan.withColumn("date", F.col("date").cast("string"))


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    writes = M.table(spark, d, "events").filter("event_type = 'signup'").select(
        (F.col("user_id") % 3).alias("plan_id"), F.to_date("ts").cast("string").alias("date"), F.col("props").alias("content"),
        (F.col("event_id") % 2).alias("done"), F.col("event_id").alias("seq"),
    )
    return planning.upsert_check_ins(writes)


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "nation").select((F.col("n_nationkey") * 3 + 2).cast("bigint").alias("root_id"))


def _moves(spark: SparkSession, d: str) -> DataFrame:
    """Every node asks to move below another one; some below their own descendants."""
    key = F.col("node_id")
    target = (
        F.when(key % 5 == 0, key * 4 + 1).when(key % 5 == 1, F.floor(key / 16)).when(key % 5 == 2, key)
        .when(key % 5 == 3, key + 1)
    )
    return M.knowledge_nodes(spark, d).select("node_id", target.alias("target_id"))


def _append(spark: SparkSession, d: str) -> DataFrame:
    added = M.table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 1000000).alias("node_id"), F.when(F.col("s_suppkey") % 10 > 0, F.col("s_suppkey") % 50).alias("parent_id")
    )
    return tree.append_order(M.knowledge_nodes(spark, d), added)


def _linked_nodes(spark: SparkSession, d: str) -> DataFrame:
    return M.knowledge_nodes(spark, d).withColumn(
        "chapter_id", F.when(F.col("node_id") % 2 == 0, F.col("node_id") % 500 * 1000)
    )


def _json_trees(spark: SparkSession, d: str) -> DataFrame:
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    json = F.concat(
        F.lit('[{"title":"'), word, F.lit('","children":[{"title":"a","children":[{"title":"b","children":[{"title":"c","children":[{"title":"deep"}]}]}]},'
              '{"title":" ","children":[{"title":"lost"}]},{"title":"'), word, F.lit(' 2"}]},{"title":"end","children":[]}]'),
    )
    return M.documents(spark, d).select(F.col("doc_id").alias("tree_id"), json.alias("json"))


QUERIES = {
    "auto_grading": lambda s, d: mastery.grade(M.attempts(s, d), M.quizzes(s, d)),
    "running_correct_rate": lambda s, d: mastery.running_correct_rate(M.attempts(s, d)),
    "latest_attempt_per_quiz": lambda s, d: mastery.latest_attempts(M.attempts(s, d)).select("quiz_id", "is_correct", "attempt_id"),
    "wrong_answer_book": lambda s, d: _listing(s, d, mastery.wrong_quizzes(M.quizzes(s, d), M.attempts(s, d)), 2, 20),
    "chapter_wrong_rate": lambda s, d: mastery.chapter_wrong_rates(M.quizzes(s, d), M.attempts(s, d)),
    "chapter_mastery": _mastery,
    "learning_overview": lambda s, d: mastery.overview(
        M.quiz_books(s, d), M.quiz_chapters(s, d), M.quizzes(s, d), M.attempts(s, d), _day(AS_OF)
    ),
    "study_streak": lambda s, d: mastery.study_streak(M.attempts(s, d), _day(AS_OF)),
    "activity_calendar": lambda s, d: mastery.activity_calendar(M.attempts(s, d), _day(AS_OF), 40).withColumn(
        "date", F.col("date").cast("string")
    ),
    "weakness_ranking": lambda s, d: mastery.weakness_ranking(_mastery(s, d), M.quiz_books(s, d)),
    "quiz_listing": lambda s, d: _listing(s, d, mastery.quiz_filter(M.quizzes(s, d), q_type="choice"), 2, 20),
    "quiz_batch_import": _import,
    "quiz_context": _quiz_context,
    "study_plan_allocation": _plan,
    "check_in_upsert": _upsert,
    "knowledge_tree_read": lambda s, d: tree.read_tree(M.knowledge_nodes(s, d)),
    "subtree_closure": lambda s, d: tree.subtree_closure(M.knowledge_nodes(s, d), _roots(s, d)),
    "subtree_delete": lambda s, d: tree.delete_subtrees(M.knowledge_nodes(s, d), _roots(s, d)).select("node_id", "title"),
    "move_validation": lambda s, d: tree.validate_moves(M.knowledge_nodes(s, d), _moves(s, d)),
    "append_order": _append,
    "chapter_node_skeleton": lambda s, d: knowledge.chapter_skeleton(M.books(s, d), M.chapters(s, d), M.knowledge_nodes(s, d)),
    "node_source_text": lambda s, d: knowledge.node_sources(_linked_nodes(s, d), M.chapters(s, d), M.chunks(s, d), M.books(s, d)),
    "node_annotations": lambda s, d: knowledge.node_annotations(M.annotations(s, d), M.quiz_books(s, d)),
    "tree_filter_with_ancestors": lambda s, d: tree.filter_with_ancestors(M.knowledge_nodes(s, d), " Ring").select("node_id", "title"),
    "mastery_counts": lambda s, d: knowledge.mastery_counts(M.knowledge_nodes(s, d)),
    "json_tree_flatten": lambda s, d: knowledge.flatten_json_trees(_json_trees(s, d)),
    "annotation_back_flow": lambda s, d: knowledge.annotations_to_nodes(M.annotations(s, d), M.knowledge_nodes(s, d)),
}

_MASTERY = f"{S.LATEST}, {S.QUIZZES}, {S.QUIZ_CHAPTERS}, " + f"""rates AS (SELECT chapter_id, {S.round_half_even('avg(1 - is_correct)', 3)} AS wrong_rate FROM latest JOIN quizzes USING (quiz_id) GROUP BY 1),
  mastery AS (SELECT c.book_id, c.chapter_id, c.title, order_index, coalesce(n, 0) AS quizzes, coalesce(wrong_rate, 0) AS wrong_rate,
    CASE WHEN n IS NULL THEN 0 ELSE {S.round_half_even('1 - coalesce(wrong_rate, 0)', 3)} END AS mastery
  FROM quiz_chapters c LEFT JOIN (SELECT chapter_id, count(*) AS n FROM quizzes GROUP BY 1) q ON c.chapter_id = q.chapter_id LEFT JOIN rates r ON c.chapter_id = r.chapter_id)"""
_LISTED = """SELECT p.quiz_id, q_type, question, question || '|' || p_type AS options, coalesce(b.title, '') AS book_title, c.title AS chapter_title,
    (SELECT count(*) FROM chosen) AS total FROM (SELECT * FROM chosen ORDER BY quiz_id LIMIT 20 OFFSET 20) p
    LEFT JOIN quiz_books b USING (book_id) LEFT JOIN quiz_chapters c ON p.chapter_id = c.chapter_id"""
_STREAK = """days AS (SELECT DISTINCT answered_at::date AS d FROM attempts WHERE answered_at::date <= date '2024-01-30'),
  streak AS (SELECT count(*) FILTER (date '2024-01-30' - d = r - 1) AS streak_days FROM (SELECT d, row_number() OVER (ORDER BY d DESC) AS r FROM days))"""
_WALK = S.NODES + """, walk AS (SELECT node_id, parent_id, title, 0::bigint AS depth, order_index || ':' || node_id AS sort_path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT c.node_id, c.parent_id, c.title, depth + 1, sort_path || '/' || c.order_index || ':' || c.node_id FROM nodes c JOIN walk w ON c.parent_id = w.node_id)"""
_ROOTS = "roots AS (SELECT n_nationkey::bigint * 3 + 2 AS root_id FROM nation)"
_CLOSURE = S.NODES + ", " + _ROOTS + """, closure AS (SELECT root_id, node_id FROM roots JOIN nodes ON node_id = root_id
  UNION ALL SELECT c.root_id, n.node_id FROM closure c JOIN nodes n ON n.parent_id = c.node_id)"""

ORACLE = {
    "auto_grading": f"""WITH {S.ATTEMPTS}, {S.QUIZZES} SELECT attempt_id, a.quiz_id, CASE WHEN q_type = 'short' THEN 0 ELSE (upper(trim(user_answer)) = upper(trim(answer)))::int END::bigint AS is_correct,
      (q_type = 'short')::bigint AS is_self_graded FROM attempts a JOIN quizzes USING (quiz_id)""",
    "running_correct_rate": f"""WITH {S.ATTEMPTS}, rates AS (SELECT attempt_id, quiz_id, avg(is_correct) OVER (PARTITION BY quiz_id ORDER BY answered_at, attempt_id
      ROWS UNBOUNDED PRECEDING) AS rate FROM attempts) SELECT attempt_id, quiz_id, {S.round_half_even('rate', 2)} AS correct_rate FROM rates""",
    "latest_attempt_per_quiz": f"WITH {S.LATEST} SELECT quiz_id, is_correct, attempt_id FROM latest",
    "wrong_answer_book": f"WITH {S.LATEST}, {S.QUIZZES}, {S.QUIZ_BOOKS}, {S.QUIZ_CHAPTERS}, chosen AS (SELECT * FROM quizzes WHERE quiz_id IN (SELECT quiz_id FROM latest WHERE is_correct = 0)) {_LISTED}",
    "chapter_wrong_rate": f"WITH {_MASTERY} SELECT chapter_id, wrong_rate FROM rates",
    "chapter_mastery": f"WITH {_MASTERY} SELECT book_id, chapter_id, title, order_index, quizzes, wrong_rate, mastery FROM mastery",
    "learning_overview": f"""WITH {_MASTERY}, {S.QUIZ_BOOKS}, {_STREAK} SELECT (SELECT count(*) FROM quiz_books) AS book_count, (SELECT count(*) FROM quizzes) AS quiz_count,
      (SELECT count(*) FROM attempts) AS attempts_total, {S.round_half_even('sum(mastery * quizzes) / sum(quizzes)', 3)} AS avg_mastery, (SELECT streak_days FROM streak) AS streak_days FROM mastery""",
    "study_streak": f"WITH {S.ATTEMPTS}, {_STREAK} SELECT streak_days FROM streak",
    "activity_calendar": f"""WITH {S.ATTEMPTS}, c AS (SELECT (date '2024-01-30' - g::int)::date AS d FROM (SELECT unnest(range(0, 41)) AS g))
      SELECT strftime(d, '%Y-%m-%d') AS date, count(attempt_id) AS attempts FROM c LEFT JOIN attempts ON answered_at::date = d GROUP BY 1""",
    "weakness_ranking": f"""WITH {_MASTERY}, {S.QUIZ_BOOKS} SELECT m.book_id, coalesce(b.title, '') AS book_title, chapter_id, m.title AS chapter_title, mastery,
      CASE WHEN mastery < 0.5 THEN '优先复习' ELSE '保持' END AS suggest FROM mastery m LEFT JOIN quiz_books b ON m.book_id = b.book_id WHERE quizzes > 0 ORDER BY mastery, chapter_id LIMIT 10""",
    "quiz_listing": f"WITH {S.QUIZZES}, {S.QUIZ_BOOKS}, {S.QUIZ_CHAPTERS}, chosen AS (SELECT * FROM quizzes WHERE q_type = 'choice') {_LISTED}",
    "quiz_batch_import": f"""WITH {S.QUIZZES}, {S.QUIZ_CHAPTERS} SELECT quiz_id, q.chapter_id + 20 AS chapter_id, c.book_id, (c.book_id IS NOT NULL)::bigint AS accepted
      FROM quizzes q LEFT JOIN quiz_chapters c ON c.chapter_id = q.chapter_id + 20""",
    "quiz_context": f"""WITH {S.CHUNKS}, {S.CHAPTERS}, firsts AS (SELECT chapter_id, substr(string_agg(substr(content, 1, 600), chr(10) || chr(10) ORDER BY chunk_index), 1, 4000) AS raw FROM
        (SELECT * FROM chunks WHERE chapter_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY chunk_index) <= 4) GROUP BY 1)
      SELECT c.chapter_id, CASE WHEN c.chapter_id % 2 = 0 THEN '【章节总结】' || chr(10) || 'Summary of ' || title || chr(10) || chr(10) || '【原文片段】' || chr(10) || substr(coalesce(raw, ''), 1, 2000)
        ELSE coalesce(raw, '') END AS context FROM chapters c LEFT JOIN firsts f ON c.chapter_id = f.chapter_id""",
    "study_plan_allocation": f"""WITH {S.NODES}, ranked AS (SELECT *, row_number() OVER (ORDER BY CASE mastery WHEN 'fuzzy' THEN 1 WHEN 'known' THEN 2 ELSE 0 END, order_index, node_id) AS position, count(*) OVER () AS n FROM nodes),
      placed AS (SELECT *, (position - 1) // greatest(1, (n + 29) // 30) AS day FROM ranked),
      checked AS (SELECT DISTINCT ts::date AS d FROM events WHERE event_type = 'purchase' AND user_id < 3)
      SELECT strftime(date '2024-01-01' + g::int, '%Y-%m-%d') AS date, position, node_id, title, mastery, (k.d IS NOT NULL)::bigint AS checked
      FROM (SELECT unnest(range(0, 30)) AS g) LEFT JOIN placed ON day = g LEFT JOIN checked k ON k.d = (date '2024-01-01' + g::int)::date""",
    "check_in_upsert": """SELECT user_id % 3 AS plan_id, strftime(ts, '%Y-%m-%d') AS date, arg_max(props, event_id) AS content, arg_max(event_id % 2, event_id) AS done
      FROM events WHERE event_type = 'signup' GROUP BY 1, 2""",
    "knowledge_tree_read": f"""WITH RECURSIVE {_WALK} SELECT w.*, (SELECT count(*) FROM nodes c WHERE c.parent_id = w.node_id) AS n_children FROM walk w""",
    "subtree_closure": f"WITH RECURSIVE {_CLOSURE} SELECT root_id, node_id FROM closure",
    "subtree_delete": f"WITH RECURSIVE {_CLOSURE} SELECT node_id, title FROM nodes WHERE node_id NOT IN (SELECT node_id FROM closure)",
    "move_validation": f"""WITH RECURSIVE {S.NODES}, up AS (SELECT node_id, node_id AS a FROM nodes UNION ALL SELECT u.node_id, n.parent_id FROM up u JOIN nodes n ON n.node_id = u.a WHERE n.parent_id IS NOT NULL),
      moves AS (SELECT node_id, CASE node_id % 5 WHEN 0 THEN node_id * 4 + 1 WHEN 1 THEN node_id // 16 WHEN 2 THEN node_id WHEN 3 THEN node_id + 1 END AS target_id FROM nodes)
      SELECT node_id, target_id, CASE WHEN target_id IS NULL THEN 'ok' WHEN target_id = node_id THEN 'onto itself' WHEN target_id NOT IN (SELECT node_id FROM nodes) THEN 'unknown target'
        WHEN EXISTS (SELECT 1 FROM up WHERE up.node_id = m.target_id AND up.a = m.node_id) THEN 'into own subtree' ELSE 'ok' END AS verdict FROM moves m""",
    "append_order": f"""WITH {S.NODES}, added AS (SELECT s_suppkey + 1000000 AS node_id, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey % 50 END AS parent_id FROM supplier)
      SELECT node_id, parent_id, coalesce((SELECT max(order_index) FROM nodes n WHERE n.parent_id IS NOT DISTINCT FROM a.parent_id), -1) + row_number() OVER (PARTITION BY parent_id ORDER BY node_id) AS order_index FROM added a""",
    "chapter_node_skeleton": f"""WITH {S.BOOKS}, {S.CHAPTERS}, every AS (SELECT book_id, NULL::bigint AS chapter_id, NULL::bigint AS up, '《' || title || '》章节骨架' AS title, 0 AS order_index, false AS c FROM books
        UNION ALL SELECT book_id, chapter_id, parent_id, title, order_index, true FROM chapters),
      made AS (SELECT *, row_number() OVER (ORDER BY book_id, c, order_index, chapter_id) + (SELECT max(p_partkey) FROM part) AS node_id FROM every)
      SELECT m.node_id, p.node_id AS parent_id, m.book_id, m.chapter_id, m.title, m.order_index FROM made m
      LEFT JOIN made p ON m.c AND p.book_id = m.book_id AND coalesce(m.up, -1) = coalesce(p.chapter_id, -1)""",
    "node_source_text": f"""WITH {S.CHUNKS}, {S.CHAPTERS}, {S.BOOKS}, linked AS (SELECT p_partkey AS node_id, p_name AS node_title, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 500 * 1000 END AS chapter_id FROM part),
      texts AS (SELECT chapter_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM chunks GROUP BY 1)
      SELECT node_id, node_title, c.book_id, b.title AS book_title, c.title AS chapter_title, start_page AS page_start, end_page AS page_end, CASE WHEN c.chapter_id IS NULL THEN '' ELSE coalesce(text, '') END AS text
      FROM linked l LEFT JOIN chapters c ON l.chapter_id = c.chapter_id LEFT JOIN books b ON c.book_id = b.book_id LEFT JOIN texts t ON t.chapter_id = c.chapter_id""",
    "node_annotations": f"""WITH {S.ANNOTATIONS}, {S.QUIZ_BOOKS} SELECT knowledge_node_id AS node_id, annotation_id, a.book_id, coalesce(title, '') AS book_title, page, coalesce(text, '') AS text, coalesce(note, '') AS note
      FROM annotations a LEFT JOIN quiz_books b ON a.book_id = b.book_id WHERE knowledge_node_id IS NOT NULL""",
    "tree_filter_with_ancestors": f"""WITH RECURSIVE {S.NODES}, up AS (SELECT node_id AS a FROM nodes WHERE contains(lower(title || coalesce(note, '')), 'ring')
        UNION SELECT n.parent_id FROM up JOIN nodes n ON n.node_id = a WHERE n.parent_id IS NOT NULL) SELECT node_id, title FROM nodes WHERE node_id IN (SELECT a FROM up)""",
    "mastery_counts": f"""WITH {S.NODES} SELECT count(*) AS total, count(*) FILTER (mastery = 'known') AS known, count(*) FILTER (mastery = 'fuzzy') AS fuzzy,
      count(*) FILTER (mastery = 'unknown') AS "unknown" FROM nodes""",
    "json_tree_flatten": """WITH t AS (SELECT doc_id AS tree_id, regexp_extract(text, '[A-Za-z]+', 0) AS w FROM documents)
      SELECT tree_id, path, depth::bigint AS depth, title, order_index::bigint AS order_index FROM (
        SELECT tree_id, '/0' AS path, 0 AS depth, w AS title, 0 AS order_index FROM t UNION ALL SELECT tree_id, '/1', 0, 'end', 1 FROM t
        UNION ALL SELECT tree_id, '/0/0', 1, 'a', 0 FROM t WHERE w <> '' UNION ALL SELECT tree_id, '/0/2', 1, trim(w || ' 2'), 2 FROM t WHERE w <> ''
        UNION ALL SELECT tree_id, '/0/0/0', 2, 'b', 0 FROM t WHERE w <> '' UNION ALL SELECT tree_id, '/0/0/0/0', 3, 'c', 0 FROM t WHERE w <> '') WHERE title <> ''""",
    "annotation_back_flow": f"""WITH {S.ANNOTATIONS}, loose AS (SELECT annotation_id, book_id, trim(coalesce(note, text, ''), chr(10) || ' ') AS seed FROM annotations WHERE knowledge_node_id IS NULL)
      SELECT row_number() OVER (ORDER BY annotation_id) + (SELECT max(p_partkey) FROM part) AS node_id, annotation_id, book_id, substr(seed, 1, 40) AS title, 'note' AS node_type, substr(seed, 1, 500) AS note
      FROM loose WHERE seed <> ''""",
}
