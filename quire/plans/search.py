"""Registered queries: index, retrieval, prompts and checks of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import tokens as K
from quire.operators import answers as A
from quire.operators import blocks, graph, index, retrieval
from quire.plans import enrichment
from quire.plans import twin as S
from quire.session import fresh_path, once, written
from quire.sources import model as M


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as questions; every tenth one has nothing to search for."""
    text = F.when(F.col("query_id") % 10 == 9, F.lit("？？？")).otherwise(F.col("text"))
    return M.queries(spark, d).select("query_id", text.alias("text"))


def stored_index(spark: SparkSession, d: str) -> blocks.BlockIndex:
    """The index of the corpus of a folder, stored once in a session before it is searched."""
    return once(spark, f"index of {d}", lambda: blocks.write_index(M.chunks(spark, d), fresh_path(spark, "index")))


def _found(spark: SparkSession, d: str, k: int) -> blocks.Found:
    return stored_index(spark, d).search(questions(spark, d), k)


def _search(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d, P.TOP_K)
    hits = retrieval.enrich_hits(found.top, M.chunks(spark, d), M.books(spark, d), M.chapters(spark, d))
    return hits.join(found.totals, "query_id").select(
        "query_id", "rank", "chunk_id", "book_title", "chapter_title", "score", "total"
    )


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query_id")
    scopes = questions(spark, d).select(
        "query_id",
        F.when(q % 4 == 1, F.sequence(q * 3, q * 3 + 40)).when(q % 4 == 3, F.sequence(q, q + 400)).alias("book_ids"),
        F.when(q % 4 >= 2, "en").alias("category"),
        F.when(q % 8 == 4, F.lit(2).cast("bigint")).alias("tag_id"),
        F.when(q % 8 == 0, q * 1000).alias("chapter_id"),
    )
    index = stored_index(spark, d)
    scope = index.scope(scopes, M.books(spark, d), enrichment.library_links(spark, d))
    return index.search(questions(spark, d), P.TOP_K, scope).top


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    hits = written(_found(spark, d, P.TOP_K).top, "hits")
    shown = hits.join(M.chunks(spark, d).select("chunk_id", "content"), "chunk_id").join(questions(spark, d), "query_id")
    tokens = F.regexp_extract_all("content", F.lit(P.WORD), F.lit(0))
    return shown.select(
        "query_id", "chunk_id", retrieval.snippet(tokens, K.query_tokens(F.col("text"))).alias("snippet")
    )


def _label_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first vector of each label as a query."""
    return M.table(spark, d, "embeddings").groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "embeddings").select((F.col("vec_id") * 100000).alias("chunk_id"), "embedding")


def _question_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each question takes the stored vector of the same number."""
    stored = M.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return stored.join(questions(spark, d).select("query_id"), "query_id", "left_semi")


def _vector_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_search(_question_vectors(spark, d), _vectors(spark, d), 2 * P.TOP_K)


def _full_text_hits(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, 2 * P.TOP_K).top


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    return stored_index(spark, d).substrings(questions(spark, d))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse([_vector_hits(spark, d), _full_text_hits(spark, d), _fallback(spark, d)], P.TOP_K)


def _described(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    return retrieval.enrich_hits(hits, M.chunks(spark, d), M.books(spark, d), M.chapters(spark, d))


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank(_described(spark, d, _fused(spark, d)).join(questions(spark, d), "query_id"), P.TOP_K)


def _context(spark: SparkSession, d: str) -> DataFrame:
    hits = _described(spark, d, _found(spark, d, P.TOP_K).top)
    return retrieval.neighbour_context(hits, M.chunks(spark, d))


def retrieved(spark: SparkSession, d: str) -> DataFrame:
    """The full path; questions with nothing to search for have no vector either."""
    near = _vector_hits(spark, d).join(
        questions(spark, d).filter("text = '？？？'").select("query_id"), "query_id", "left_anti"
    )
    index = stored_index(spark, d)
    return retrieval.retrieve(questions(spark, d), M.chunks(spark, d), M.books(spark, d), M.chapters(spark, d), index, near)


def _citations(spark: SparkSession, d: str) -> DataFrame:
    return A.verify_citations(M.chat_logs(spark, d)).select(
        "chat_id", F.array_join(F.transform("cited", lambda n: n.cast("string")), ",").alias("cited"),
        F.array_join(F.transform("mismatched", lambda n: n.cast("string")), ",").alias("mismatched"),
        F.col("verified").cast("bigint").alias("verified"),
    )


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    events = M.table(spark, d, "events")
    searches = events.filter("event_type = 'view'").select(
        "ts", F.col("event_id").alias("id"), (F.floor("value") % 7).alias("hits")
    )
    checks = events.filter("event_type = 'click'").select(
        "ts", F.col("event_id").alias("id"), (F.col("user_id") % 2).alias("verified")
    )
    return A.retrieval_metrics(searches, checks)


def _concept_sources(spark: SparkSession, d: str) -> DataFrame:
    names = graph.nodes(graph.concepts(enrichment.concept_sources(spark, d)))
    asked = names.select(F.col("name").alias("query_id"), F.col("name").alias("text"))
    return stored_index(spark, d).search(asked, 30).top.select(
        F.col("query_id").alias("concept"), "chunk_id", "rank"
    )


def _model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Model answers about the books: bare, fenced or embedded JSON, or none at all."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    item = lambda page, level: F.concat(
        F.lit('{"title": "'), word, F.lit(f' {level}", "page": '), page.cast("string"), F.lit(f', "level": {level}}}')
    )
    pages = F.col("doc_id") % 5
    body = F.concat(F.lit("["), item(pages, 1), F.lit(", "), item(pages + 1, 2), F.lit("]"))
    kind = F.col("doc_id") % 4
    return M.documents(spark, d).select(
        F.col("doc_id").alias("book_id"),
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked.")))
        .otherwise(F.concat(F.lit("不是JSON "), word))
        .alias("answer"),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_pages"),
    )


def _split_answers(spark: SparkSession, d: str) -> DataFrame:
    """Proposed splits of the chunks: at half of their length, unchanged, or no JSON."""
    plain = F.regexp_replace("content", r'[\n"\\]', " ")
    half = (F.length("content") / 2).cast("int")
    two = F.concat(
        F.lit('["'), F.substring(plain, F.lit(1), half), F.lit('", "'),
        F.substring(plain, half + 1, F.length("content")), F.lit('"]'),
    )
    kind = F.col("chunk_id") % 3
    return M.chunks(spark, d).select(
        "chunk_id", "content",
        F.when(kind == 0, two).when(kind == 1, F.concat(F.lit('["'), plain, F.lit('"]'))).otherwise("不是JSON").alias("answer"),
    )


QUERIES = {
    "bm25_search": _search,
    "inverted_index_build": lambda s, d: index.build_index(M.chunks(s, d)).postings,
    "search_scope_filters": _scoped,
    "highlighted_snippet": _snippets,
    "substring_fallback": lambda s, d: _fallback(s, d),
    "exact_vector_top_k": lambda s, d: retrieval.vector_search(_label_vectors(s, d), _vectors(s, d), 2 * P.TOP_K),
    "hit_enrichment": lambda s, d: _described(s, d, _found(s, d, P.TOP_K).top).select(
        "query_id", "chunk_id", "book_id", "book_title", "chapter_title", "page_start", "page_end", "snippet"
    ),
    "reciprocal_rank_fusion": _fused,
    "feature_rerank": lambda s, d: _reranked(s, d).select("query_id", "rank", "chunk_id", "rerank_score"),
    "neighbour_context": _context,
    "outline_fallback": lambda s, d: retrieval.outline_fallback(
        questions(s, d), _found(s, d, 1).totals, M.books(s, d), M.chapters(s, d)
    ),
    "retrieve": retrieved,
    "prompt_assembly": lambda s, d: A.assemble_prompts(questions(s, d), retrieved(s, d)),
    "citation_verification": _citations,
    "retrieval_metrics": _metrics,
    "concept_source_lookup": _concept_sources,
    "model_answer_json": lambda s, d: _model_answers(s, d).select(
        "book_id", A.json_block(F.col("answer")).alias("json")
    ),
    "model_toc_validation": lambda s, d: A.validated_toc(_model_answers(s, d)),
    "model_split_validation": lambda s, d: A.validated_split(_split_answers(s, d)),
}

_QUESTIONS = "questions AS (SELECT item_id AS query_id, CASE WHEN item_id % 10 = 9 THEN '？？？' ELSE text END AS text FROM benchmark)"
_INDEXED = S.TOKENS + f""", all_tokens AS (SELECT chunk_id, book_id, token FROM tokens UNION ALL
    SELECT chunk_id, book_id, lower(content) FROM chunks WHERE len(regexp_extract_all(lower(content), {S.q(P.WORD)})) = 0),
  postings AS (SELECT chunk_id, book_id, token, count(*) AS tf, sum(count(*)) OVER (PARTITION BY chunk_id)::bigint AS dl FROM all_tokens GROUP BY 1, 2, 3),
  stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM (SELECT chunk_id, count(*) AS dl FROM all_tokens GROUP BY 1))"""


def _bm25(asked: str) -> str:
    return f"""wanted AS (SELECT query_id, token FROM (SELECT query_id, w AS token, row_number() OVER (PARTITION BY query_id ORDER BY length(w) DESC, min(i)) AS k FROM
      (SELECT query_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT query_id, regexp_extract_all(lower(text), {S.q(P.WORD)}) AS l FROM {asked}))
      WHERE length(w) >= 2 OR ascii(w) < 128 GROUP BY query_id, w) WHERE k <= 8),
  df AS (SELECT token, count(*) AS df FROM postings WHERE token IN (SELECT token FROM wanted) GROUP BY 1),
  scores AS (SELECT query_id, chunk_id, book_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM postings JOIN wanted USING (token) JOIN df USING (token), stats GROUP BY 1, 2, 3)"""


def _top(source: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source}
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {k})"""


_SCORED = _INDEXED + ", " + _QUESTIONS + ", " + _bm25("questions")
_TOP5 = _SCORED + ", " + _top("scores", 5, "top5")
_TITLES = f"{S.BOOKS}, {S.CHAPTERS}"


def _substring(asked: str) -> str:
    return f"""phrases AS (SELECT query_id, w AS phrase FROM (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY length(w) DESC, min(i)) AS k FROM
      (SELECT query_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT query_id, regexp_extract_all(lower({S.strip('text')}), {S.q(P.WORD)}) AS l FROM {asked}))
      WHERE length(w) >= 2 GROUP BY query_id, w) WHERE k <= 3
    UNION ALL SELECT query_id, substr(lower({S.strip('text')}), 1, 20) FROM {asked} WHERE len(list_filter(regexp_extract_all(lower(text), {S.q(P.WORD)}), lambda w: length(w) >= 2)) = 0),
  fallback AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM
    (SELECT DISTINCT query_id, chunk_id FROM phrases JOIN chunks ON contains(lower(content), phrase) WHERE phrase <> '')
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 5)"""


def _cosine(asked: str, name: str) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
    (SELECT a.query_id, b.vec_id * 100000 AS chunk_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score FROM {asked} a, embeddings b)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10)"""


_LISTS = _SCORED + ", " + _top("scores", 10, "top10") + f""", question_vectors AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id IN (SELECT query_id FROM questions)),
  {_cosine('question_vectors', 'near')}"""


def _fusing(lists: str) -> str:
    return f"""fused_all AS (SELECT query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 10) AS score FROM ({lists}) GROUP BY 1, 2),
  {_top('fused_all', 10, 'fused')}"""


_FUSED = _LISTS + ", " + _substring("questions") + ", " + _fusing(
    "SELECT query_id, chunk_id, rank FROM near UNION ALL SELECT query_id, chunk_id, rank FROM top10 UNION ALL SELECT query_id, chunk_id, rank FROM fallback"
)
_RAW_WORDS = f"""(SELECT query_id, w FROM (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS k FROM
    (SELECT query_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT query_id, regexp_extract_all(text, {S.q(P.WORD)}) AS l FROM questions))
    WHERE length(w) >= 2 GROUP BY 1, 2) WHERE k <= 10)"""
_RERANK = f"""shares AS (SELECT f.query_id, f.chunk_id, count(w) AS n, count(*) FILTER (contains(content, w)) AS all_hits,
      count(*) FILTER (contains(substr(content, 1, 200), w)) AS front_hits
    FROM fused f JOIN chunks c ON f.chunk_id = c.chunk_id LEFT JOIN {_RAW_WORDS} q ON f.query_id = q.query_id GROUP BY 1, 2),
  finals AS (SELECT f.query_id, f.chunk_id, f.rank AS old_rank,
      (CASE WHEN n = 0 THEN 0::double ELSE all_hits / n END) * 0.4::double + (CASE WHEN n = 0 THEN 0::double ELSE front_hits / n END) * 0.2::double
      + least(f.score * 100, 1.0::double) * 0.3::double
      + (CASE WHEN length(content) < 50 THEN 0.3 WHEN length(content) > 2000 THEN 0.5 ELSE 1.0 END)::double * 0.1::double AS final
    FROM fused f JOIN shares s ON f.query_id = s.query_id AND f.chunk_id = s.chunk_id JOIN chunks c ON f.chunk_id = c.chunk_id),
  reranked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, old_rank) AS rank, {S.round_half_even('final', 4)} AS rerank_score FROM finals
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final DESC, old_rank) <= 5)"""


def _around(hits: str) -> str:
    return f"""sized AS (SELECT *, count(*) OVER (PARTITION BY book_id, chapter_id) AS n FROM chunks),
  contexts AS (SELECT h.query_id, h.chunk_id, string_agg(o.content, chr(10) ORDER BY o.chunk_index) AS context FROM {hits} h JOIN sized c ON h.chunk_id = c.chunk_id
    JOIN chunks o ON o.book_id = c.book_id AND o.chapter_id IS NOT DISTINCT FROM c.chapter_id AND (c.n <= 3 OR abs(o.chunk_index - c.chunk_index) <= 1) GROUP BY 1, 2)"""


_OUTLINES = """outlines AS (SELECT q.query_id, string_agg(line, chr(10) ORDER BY b.book_id) AS snippet FROM questions q,
    (SELECT b.book_id, '《' || any_value(b.title) || '》目录：' || coalesce(string_agg(h.title, ' / ' ORDER BY order_index) FILTER (order_index < 40), '') AS line
     FROM (SELECT * FROM books ORDER BY book_id LIMIT 3) b LEFT JOIN chapters h ON h.book_id = b.book_id GROUP BY 1) b
    WHERE q.query_id NOT IN (SELECT query_id FROM {hits}) GROUP BY 1)"""
_RETRIEVED = _LISTS + f""", primaries AS (SELECT query_id, chunk_id, rank FROM near WHERE query_id % 10 <> 9 UNION ALL SELECT query_id, chunk_id, rank FROM top10),
  weak AS (SELECT * FROM questions WHERE query_id NOT IN (SELECT query_id FROM primaries GROUP BY 1 HAVING count(*) >= 3)),
  {_substring('weak')}, {_fusing('SELECT * FROM primaries UNION ALL SELECT * FROM fallback')}, {_RERANK}, {_around('reranked')}, {_TITLES}, {_OUTLINES.format(hits='fused')},
  retrieved AS (SELECT r.query_id, r.rank, r.chunk_id, c.book_id, b.title AS book_title, h.title AS chapter_title, c.page_start, c.page_end,
      substr(c.content, 1, 400) AS snippet, context, rerank_score
    FROM reranked r JOIN chunks c ON r.chunk_id = c.chunk_id JOIN books b ON c.book_id = b.book_id LEFT JOIN chapters h ON c.chapter_id = h.chapter_id
      JOIN contexts x ON x.query_id = r.query_id AND x.chunk_id = r.chunk_id
    UNION ALL SELECT query_id, 1, 0, NULL, '', NULL, NULL, NULL, snippet, snippet, NULL FROM outlines)"""
_ANSWERS = """answers AS (SELECT doc_id AS book_id, doc_id % 4 AS kind, len(string_split(text, chr(10))) AS n_pages, regexp_extract(text, '[A-Za-z]+', 0) AS word, doc_id % 5 AS p FROM documents),
  bodies AS (SELECT *, '[{"title": "' || word || ' 1", "page": ' || p || ', "level": 1}, {"title": "' || word || ' 2", "page": ' || (p + 1) || ', "level": 2}]' AS body FROM answers)"""

ORACLE = {
    "bm25_search": f"""WITH {_TOP5}, {_TITLES}, totals AS (SELECT query_id, count(*) AS total FROM scores GROUP BY 1)
      SELECT t.query_id, rank, t.chunk_id, b.title AS book_title, h.title AS chapter_title, score, total FROM top5 t JOIN chunks c ON t.chunk_id = c.chunk_id
      JOIN books b ON c.book_id = b.book_id LEFT JOIN chapters h ON c.chapter_id = h.chapter_id JOIN totals USING (query_id)""",
    "inverted_index_build": f"WITH {_INDEXED} SELECT chunk_id, book_id, token, tf, dl FROM postings",
    "search_scope_filters": f"""WITH {_SCORED}, tags AS (SELECT name, row_number() OVER (ORDER BY name) AS tag_id FROM (SELECT DISTINCT lang AS name FROM documents)),
      kept AS (SELECT s.* FROM scores s JOIN documents d ON s.book_id = d.doc_id JOIN (SELECT chunk_id, chapter_id FROM chunks) c ON s.chunk_id = c.chunk_id
        WHERE (query_id % 8 <> 0 OR c.chapter_id = query_id * 1000) AND (query_id % 4 <> 1 OR book_id BETWEEN query_id * 3 AND query_id * 3 + 40) AND (query_id % 4 <> 3 OR book_id BETWEEN query_id AND query_id + 400)
          AND (query_id % 4 < 2 OR lang = 'en') AND (query_id % 8 <> 4 OR (lang IN (SELECT name FROM tags WHERE tag_id = 2) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)))),
      {_top('kept', 5, 'best')} SELECT query_id, chunk_id, book_id, score, rank FROM best""",
    "highlighted_snippet": f"""WITH {_TOP5}, shown AS (SELECT t.query_id, t.chunk_id, regexp_extract_all(content, {S.q(P.WORD)}) AS toks,
        (SELECT list(token) FROM wanted w WHERE w.query_id = t.query_id) AS ws FROM top5 t JOIN chunks c ON t.chunk_id = c.chunk_id),
      flagged AS (SELECT *, list_transform(toks, lambda x: list_contains(ws, lower(x))::int) AS f FROM shown),
      counted AS (SELECT *, list_transform(range(1, greatest(len(f) - 12 + 1, 1) + 1), lambda i: list_sum(f[i:i + 11])) AS cs FROM flagged),
      placed AS (SELECT *, list_position(cs, list_max(cs)) AS at_ FROM counted)
      SELECT query_id, chunk_id, CASE WHEN at_ > 1 THEN '…' ELSE '' END || array_to_string(list_transform(list_zip(toks[at_:at_ + 11], f[at_:at_ + 11]),
        lambda z: CASE WHEN z[2] = 1 THEN '[' || z[1] || ']' ELSE z[1] END), ' ') || CASE WHEN at_ + 11 < len(f) THEN '…' ELSE '' END AS snippet FROM placed""",
    "substring_fallback": f"WITH {S.CHUNKS}, {_QUESTIONS}, {_substring('questions')} SELECT query_id, chunk_id, rank FROM fallback",
    "exact_vector_top_k": f"""WITH label_vectors AS (SELECT label::bigint AS query_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1),
      {_cosine('label_vectors', 'near')} SELECT query_id, chunk_id, score, rank FROM near""",
    "hit_enrichment": f"""WITH {_TOP5}, {_TITLES} SELECT t.query_id, t.chunk_id, c.book_id, b.title AS book_title, h.title AS chapter_title, page_start, c.page_end,
      substr(content, 1, 400) AS snippet FROM top5 t JOIN chunks c ON t.chunk_id = c.chunk_id JOIN books b ON c.book_id = b.book_id LEFT JOIN chapters h ON c.chapter_id = h.chapter_id""",
    "reciprocal_rank_fusion": f"WITH {_FUSED} SELECT query_id, chunk_id, score, rank FROM fused",
    "feature_rerank": f"WITH {_FUSED}, {_RERANK} SELECT query_id, rank, chunk_id, rerank_score FROM reranked",
    "neighbour_context": f"WITH {_TOP5}, {_around('top5')} SELECT query_id, chunk_id, context FROM contexts",
    "outline_fallback": f"WITH {_SCORED}, {_TITLES}, {_OUTLINES.format(hits='scores')} SELECT query_id, snippet FROM outlines",
    "retrieve": f"WITH {_RETRIEVED} SELECT * FROM retrieved",
    "prompt_assembly": f"""WITH {_RETRIEVED}, blocks AS (SELECT query_id, max(CASE WHEN chunk_id = 0 THEN snippet END) AS outline,
        string_agg('[资料' || rank || ']（' || CASE WHEN book_title <> '' THEN '《' || book_title || '》' ELSE '' END || coalesce(' ' || chapter_title, '') ||
          CASE WHEN page_start IS NULL THEN '' WHEN page_end <> page_start THEN ' 第' || page_start || '-' || page_end || '页' ELSE ' 第' || page_start || '页' END
          || '）' || chr(10) || CASE WHEN coalesce(context, '') <> '' THEN context ELSE snippet END, chr(10) || chr(10) ORDER BY rank) AS blocks FROM retrieved GROUP BY 1)
      SELECT q.query_id, CASE WHEN outline IS NOT NULL THEN {S.q(A.ASK_WITH_OUTLINE)} ELSE {S.q(A.ASK_WITH_SOURCES)} END AS system,
        CASE WHEN outline IS NOT NULL THEN '书籍目录：' || chr(10) || outline ELSE '书籍资料：' || chr(10) || CASE WHEN length(blocks) > 12000
          THEN substr(blocks, 1, 12000) || chr(10) || '…（内容过长已截断）' ELSE blocks END END || chr(10) || chr(10) || '问题：' || q.text AS "user"
      FROM questions q JOIN blocks USING (query_id)""",
    "citation_verification": f"""WITH {S.CHAT_LOGS}, c AS (SELECT chat_id, n_sources, list_transform(regexp_extract_all(answer, {S.q(P.CITATION)}, 1), lambda x: x::bigint) AS l FROM chat_logs),
      w AS (SELECT *, list_filter(l, lambda x: x < 1 OR x > n_sources) AS bad FROM c)
      SELECT chat_id, array_to_string(l, ',') AS cited, array_to_string(bad, ',') AS mismatched, (len(l) > 0 AND len(bad) = 0)::bigint AS verified FROM w""",
    "retrieval_metrics": f"""WITH s AS (SELECT floor(value)::bigint % 7 AS hits FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 100),
      c AS (SELECT user_id % 2 AS v FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100)
      SELECT (SELECT count(*) FROM s) AS total_queries, (SELECT {S.round_half_even('avg(hits)', 1)} FROM s) AS avg_retrieval_hits,
        (SELECT count(*) FROM c) AS total_citation_checks, (SELECT {S.round_half_even('avg(v)', 2)} FROM c) AS citation_verify_rate""",
    "concept_source_lookup": f"""WITH {enrichment._CONCEPTS}, {_INDEXED[len(S.LINES) + 2:]}, asked AS (SELECT name AS query_id, replace(name, '定理', ' 定理 ') AS text FROM nodes_), {_bm25('asked')},
      {_top('scores', 30, 'best')} SELECT query_id AS concept, chunk_id, rank FROM best""",
    "model_answer_json": f"WITH {_ANSWERS} SELECT book_id, CASE WHEN kind < 3 THEN body END AS json FROM bodies",
    "model_toc_validation": f"""WITH {_ANSWERS} SELECT book_id, s AS seq, {S.strip("word || ' ' || (s + 1)")} AS title, s + 1 AS level, p + s AS page
      FROM bodies, (SELECT unnest(range(0, 2)) AS s) WHERE kind < 3 AND p + s BETWEEN 1 AND n_pages""",
    "model_split_validation": f"""WITH {S.CHUNKS}, plain AS (SELECT chunk_id, content, {S.rr('content', '[' + chr(10) + '"' + chr(92) * 2 + ']', ' ')} AS t, length(content) AS n FROM chunks),
      pieces AS (SELECT *, CASE WHEN chunk_id % 3 = 0 THEN [substr(t, 1, n // 2), substr(t, n // 2 + 1)] ELSE [] END AS ps FROM plain),
      good AS (SELECT chunk_id, CASE WHEN len(ps) = 2 AND abs(n - length({S.strip('content')})) <= 50 THEN list_filter(ps, lambda x: {S.strip('x')} <> '') ELSE [content] END AS ps FROM pieces)
      SELECT chunk_id, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS content FROM good""",
}
