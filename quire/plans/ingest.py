"""Registered queries: files, stores and streams."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import answers, blocks, retrieval
from quire.plans import twin as S
from quire.session import fresh_path, ship_with_tasks
from quire.sources import files, model as M, store
from quire.streaming import jobs

ship_with_tasks(__name__)


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    """The documents as uploaded files: right and wrong signatures, unknown types, empty files."""
    k = F.col("doc_id")
    kind = k % 7
    name = F.when(kind < 3, ".PDF").when(kind == 3, ".docx").when(kind == 4, ".pptx").when(kind == 5, ".txt").otherwise("")
    text = (
        F.when(kind == 0, F.concat(F.lit(" \n%PDF-1.7 "), F.col("text")))
        .when(kind == 1, F.lit(""))
        .when(kind == 3, F.concat(F.lit("PK\x03\x04"), F.col("text")))
        .otherwise(F.col("text"))
    )
    return M.documents(spark, d).select(
        F.concat(F.lit("/in.box/file"), k, name).alias("path"), F.encode(text, "UTF-8").alias("content")
    ).withColumn("length", F.octet_length("content").cast("bigint"))


def _docx(texts: pd.Series) -> pd.Series:
    """A DOCX file of each text, one paragraph per line, every third one styled."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'

    def build(text: str) -> bytes:
        style = '<w:pPr><w:pStyle w:val="H1"/></w:pPr>'
        body = "".join(
            f'<w:p>{style if i % 3 == 0 else ""}<w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'
            for i, line in enumerate(text.split("\n"))
        )
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("word/styles.xml", styles)
            archive.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        return out.getvalue()

    return texts.map(build)


def _pptx(texts: pd.Series) -> pd.Series:
    """A PPTX file of each text: per slide a text frame with one line and a table row with two."""
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    p = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def build(text: str) -> bytes:
        lines = text.split("\n")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            links, ids = [], []
            for number, at in enumerate(range(0, len(lines), 3), 1):
                para = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
                cells = "".join(f"<a:tc><a:txBody>{para(t)}</a:txBody></a:tc>" for t in lines[at + 1 : at + 3])
                table = f"<p:graphicFrame><a:tbl><a:tr>{cells}</a:tr></a:tbl></p:graphicFrame>" if cells else ""
                archive.writestr(
                    f"ppt/slides/slide{number}.xml",
                    f"<p:sld {p} {a}><p:sp><p:txBody>{para(lines[at])}</p:txBody></p:sp>{table}</p:sld>",
                )
                links.append(f'<Relationship Id="r{number}" Target="slides/slide{number}.xml"/>')
                ids.append(f'<p:sldId r:id="r{number}"/>')
            archive.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships>{"".join(links)}</Relationships>')
            archive.writestr("ppt/presentation.xml", f'<p:presentation {p} {r}><p:sldIdLst>{"".join(ids)}</p:sldIdLst></p:presentation>')
        return out.getvalue()

    return texts.map(build)


def _office_files(spark: SparkSession, d: str) -> DataFrame:
    docs = M.documents(spark, d).select(F.col("doc_id").alias("book_id"), "text")
    word = docs.filter("book_id % 2 = 0").select(
        "book_id", F.lit("docx").alias("file_type"), F.pandas_udf(_docx, "binary")("text").alias("content")
    )
    slides = docs.filter("book_id % 2 = 1").select(
        "book_id", F.lit("pptx").alias("file_type"), F.pandas_udf(_pptx, "binary")("text").alias("content")
    )
    return word.unionByName(slides)


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """All books; some have lost their pages, which is one of the two cases looked for."""
    pages = M.pages(spark, d).filter("book_id % 50 <> 7")
    return files.scanned_books(M.books(spark, d), pages).withColumn("scanned", F.col("scanned").cast("bigint"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Store all chunks, then replace a third of the books twice and delete another third."""
    path = fresh_path(spark, "chunks")
    chunks = M.chunks(spark, d).select("book_id", "chunk_id", "content")
    store.create_store(chunks, path, 8)
    fresh = chunks.filter("book_id % 3 = 0").withColumn("content", F.concat(F.lit("new: "), F.col("content")))
    for _ in range(2):
        store.replace_books(spark, path, fresh, fresh, 8)
    store.replace_books(spark, path, chunks.limit(0), chunks.filter("book_id % 3 = 1"), 8)
    return store.read_store(spark, path)


def _rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return blocks.write_index(M.chunks(spark, d), fresh_path(spark, "index")).table("frequency")


def _purged(spark: SparkSession, d: str) -> DataFrame:
    """What stays when the books with toxic labels are removed."""
    tables = {
        "chapters": M.chapters(spark, d).select("book_id", F.col("chapter_id").alias("id")),
        "chunks": M.chunks(spark, d).select("book_id", F.col("chunk_id").alias("id")),
        "books": M.books(spark, d).select("book_id", F.col("book_id").alias("id")),
    }
    toxic = M.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("book_id"))
    kept = store.purge_books(tables, toxic)
    tagged = [df.select(F.lit(name).alias("table"), "book_id", "id") for name, df in kept.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def _vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Store all vectors, negate those of some books, delete others, then search what is left."""
    path = fresh_path(spark, "vectors")
    vectors = M.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("book_id"), (F.col("vec_id") * 100000).alias("chunk_id"), "embedding"
    )
    store.create_store(vectors, path, 8)
    turned = vectors.filter("book_id % 5 = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    store.replace_books(spark, path, turned, turned, 8)
    store.replace_books(spark, path, vectors.limit(0), vectors.filter("book_id % 5 = 2"), 8)
    asked = M.table(spark, d, "embeddings").groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )
    return retrieval.vector_search(asked, store.read_store(spark, path), 5)


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A stored table as a stream, be it one file or a folder of files.

    As a pattern the path may be either; a stream takes a plain one for a folder.
    """
    schema = M.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, "events")


def _run(stream: DataFrame, sink, spark: SparkSession, name: str, mode: str, conf: dict[str, str] | None = None) -> None:
    jobs.start(stream, sink, fresh_path(spark, f"{name}-state"), mode, conf).awaitTermination()


def _stream_activity(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "activity")
    stream = jobs.daily_activity(M.attempts_from_events(_event_stream(spark, d)))
    _run(stream, jobs.update_log(path), spark, "activity", "update")
    return jobs.newest_rows(spark, path, ["date"]).withColumn("date", F.col("date").cast("string"))


def _stream_late(spark: SparkSession, d: str) -> DataFrame:
    activity, arrivals = fresh_path(spark, "activity"), fresh_path(spark, "arrivals")
    attempts = M.attempts_from_events(_event_stream(spark, d))
    _run(jobs.daily_activity(attempts), jobs.update_log(activity), spark, "activity", "update")
    _run(jobs.daily_arrivals(attempts), jobs.update_log(arrivals), spark, "arrivals", "update")
    return jobs.late_attempts(spark, activity, arrivals).withColumn("date", F.col("date").cast("string"))


def _stream_quiz_state(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "quiz-state")
    stream = jobs.quiz_state(M.attempts_from_events(_event_stream(spark, d)))
    _run(stream, jobs.update_log(path), spark, "quiz-state", "update")
    return jobs.newest_rows(spark, path, ["quiz_id"])


def _stream_imports(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "imports")
    arriving = _stream(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("file_hash"))
    _run(jobs.import_deduplication(arriving), jobs.update_log(path), spark, "imports", "append", jobs.KEYED)
    return spark.read.parquet(path).select("file_id", "file_hash", "duplicate_of")


def _stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    newest = [F.desc("ts"), F.desc("id")]
    searches, checks = fresh_path(spark, "searches"), fresh_path(spark, "checks")
    events = _event_stream(spark, d).withColumnRenamed("event_id", "id")
    asked = events.filter("event_type = 'view'").select("ts", "id", (F.floor("value") % 7).alias("hits"))
    checked = events.filter("event_type = 'click'").select("ts", "id", (F.col("user_id") % 2).alias("verified"))
    _run(asked, jobs.rolling_window(searches, newest), spark, "searches", "append")
    _run(checked, jobs.rolling_window(checks, newest), spark, "checks", "append")
    return answers.retrieval_metrics(jobs.last_window(spark, searches), jobs.last_window(spark, checks))


QUERIES = {
    "file_type_dispatch": lambda s, d: files.route_files(_uploads(s, d)).select(
        "path", "file_type", F.col("accepted").cast("bigint").alias("accepted")
    ),
    "upload_validation": lambda s, d: files.check_uploads(files.route_files(_uploads(s, d))).select("path", "verdict"),
    "office_text_extraction": lambda s, d: files.office_text(_office_files(s, d)),
    "scanned_book_detector": _scanned,
    "page_reconstruction": lambda s, d: files.pages_from_chunks(
        M.chunks(s, d).withColumn("page_start", F.floor(F.col("page_start") / 2) * 3 + 1)
    ),
    "idempotent_book_write": _stored,
    "full_index_rebuild": _rebuilt,
    "cascade_purge": _purged,
    "vector_upsert_delete": _vector_store,
    "streaming_import_dedup": _stream_imports,
    "streaming_daily_activity": _stream_activity,
    "streaming_late_attempts": _stream_late,
    "streaming_quiz_state": _stream_quiz_state,
    "streaming_retrieval_metrics": _stream_metrics,
}

_METRICS = f"""WITH s AS (SELECT floor(value)::bigint % 7 AS hits FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 100),
  c AS (SELECT user_id % 2 AS v FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100)
  SELECT (SELECT count(*) FROM s) AS total_queries, (SELECT {S.round_half_even('avg(hits)', 1)} FROM s) AS avg_retrieval_hits,
    (SELECT count(*) FROM c) AS total_citation_checks, (SELECT {S.round_half_even('avg(v)', 2)} FROM c) AS citation_verify_rate"""
_PATH = "'/in.box/file' || doc_id || CASE WHEN doc_id % 7 < 3 THEN '.PDF' WHEN doc_id % 7 = 3 THEN '.docx' WHEN doc_id % 7 = 4 THEN '.pptx' WHEN doc_id % 7 = 5 THEN '.txt' ELSE '' END"

ORACLE = {
    "file_type_dispatch": f"""SELECT {_PATH} AS path, CASE WHEN doc_id % 7 < 3 THEN 'pdf' WHEN doc_id % 7 = 3 THEN 'docx' WHEN doc_id % 7 = 4 THEN 'pptx' WHEN doc_id % 7 = 5 THEN 'txt'
      ELSE 'box/file' || doc_id END AS file_type, (doc_id % 7 < 5)::bigint AS accepted FROM documents""".replace("ELSE 'box/file' || doc_id END", "ELSE '' END"),
    "upload_validation": f"""SELECT {_PATH} AS path, CASE WHEN doc_id % 7 >= 5 THEN 'unsupported type' WHEN doc_id % 7 = 1 OR (doc_id % 7 <> 3 AND doc_id % 7 <> 0 AND text = '') THEN 'empty'
      WHEN doc_id % 7 = 0 THEN 'ok' WHEN doc_id % 7 = 2 THEN CASE WHEN starts_with(ltrim(text), '%PDF-') THEN 'ok' ELSE 'no PDF signature' END
      WHEN doc_id % 7 = 3 THEN 'broken archive' ELSE 'no ZIP signature' END AS verdict FROM documents""",
    "office_text_extraction": f"""WITH {S.LINES} SELECT book_id, 'docx' AS file_type, NULL::bigint AS page, n AS idx, CASE WHEN n % 3 = 0 THEN 'heading 1' ELSE 'Normal' END AS style, line AS text FROM lines WHERE book_id % 2 = 0
      UNION ALL SELECT book_id, 'pptx', n // 3 + 1, n // 3, NULL, concat_ws(chr(10), max(CASE WHEN n % 3 = 0 AND trim(line) <> '' THEN trim(line) END), string_agg(trim(line), ' | ' ORDER BY n) FILTER (n % 3 > 0))
        FROM lines WHERE book_id % 2 = 1 GROUP BY 1, n // 3""",
    "scanned_book_detector": f"""WITH {S.PAGES} SELECT doc_id AS book_id, (coalesce(avg(length({S.strip('p.text')})), 0) < 30)::bigint AS scanned
      FROM documents LEFT JOIN pages_ p ON p.book_id = doc_id AND doc_id % 50 <> 7 GROUP BY 1""",
    "page_reconstruction": f"""WITH {S.CHUNKS}, texts AS (SELECT book_id, page_start // 2 * 3 + 1 AS page, string_agg(content, chr(10) ORDER BY chunk_index) AS text FROM chunks GROUP BY 1, 2),
      every AS (SELECT book_id, unnest(range(1, max(page) + 1)) AS page FROM texts GROUP BY 1) SELECT book_id, page, coalesce(text, '') AS text FROM every LEFT JOIN texts USING (book_id, page)""",
    "idempotent_book_write": f"WITH {S.CHUNKS} SELECT book_id, chunk_id, CASE WHEN book_id % 3 = 0 THEN 'new: ' || content ELSE content END AS content FROM chunks WHERE book_id % 3 <> 1",
    "full_index_rebuild": f"""WITH {S.TOKENS}, every AS (SELECT chunk_id, token FROM tokens UNION ALL SELECT chunk_id, lower(content) FROM chunks
      WHERE len(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) = 0) SELECT token, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM every GROUP BY 1""",
    "cascade_purge": f"""WITH {S.CHUNKS}, {S.CHAPTERS}, every AS (SELECT 'chapters' AS "table", book_id, chapter_id AS id FROM chapters UNION ALL SELECT 'chunks', book_id, chunk_id FROM chunks
      UNION ALL SELECT 'books', doc_id, doc_id FROM documents) SELECT * FROM every WHERE book_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "vector_upsert_delete": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 5 = 1 THEN list_transform(embedding::double[], lambda x: -x) ELSE embedding::double[] END AS e FROM embeddings WHERE vec_id % 5 <> 2),
      a AS (SELECT label::bigint AS query_id, arg_min(embedding, vec_id)::double[] AS e FROM embeddings GROUP BY 1),
      s AS (SELECT query_id, vec_id * 100000 AS chunk_id, round(list_cosine_similarity(a.e, v.e), 6) AS score FROM a, v)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5""",
    "streaming_import_dedup": """WITH h AS (SELECT doc_id AS file_id, sha256(text) AS file_hash FROM documents), f AS (SELECT *, min(file_id) OVER (PARTITION BY file_hash) AS o FROM h)
      SELECT file_id, file_hash, CASE WHEN o <> file_id THEN o END AS duplicate_of FROM f""",
    "streaming_daily_activity": "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS attempts FROM events GROUP BY 1",
    "streaming_late_attempts": "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS attempts, 0::bigint AS late FROM events GROUP BY 1",
    "streaming_quiz_state": f"WITH {S.LATEST}, r AS (SELECT quiz_id, {S.round_half_even('avg(is_correct)', 2)} AS correct_rate FROM attempts GROUP BY 1) SELECT quiz_id, is_correct, correct_rate FROM latest JOIN r USING (quiz_id)",
    "streaming_retrieval_metrics": _METRICS,
}
