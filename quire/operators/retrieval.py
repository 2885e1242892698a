"""Retrieval for a batch of queries: BM25, substrings, vectors, fusion, re-ranking, context.

Every operator is keyed by ``query_id``. Rank filters sit directly above their window, so each task
keeps at most ``k`` rows per query before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import patterns as P
from quire.functions.numbers import round_half_even
from quire.functions.text import let, strip
from quire.functions.tokens import longest, query_tokens, words
from quire.operators.index import Index
from quire.session import checkpointed, written

if TYPE_CHECKING:
    from quire.operators.blocks import BlockIndex

K1 = 1.2
B = 0.75
RUNS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


def bm25_scores(queries: DataFrame, index: Index) -> DataFrame:
    """``(query_id, chunk_id, book_id, score)`` of every chunk with at least one query token.

    The query side is a few tokens per query; it is written, so that the planner knows its bytes.
    """
    wanted = queries.select("query_id", F.explode(query_tokens(F.col("text"))).alias("token"))
    frequency = index.frequency.join(wanted.select("token").distinct(), "token", "left_semi")
    n_docs = index.stats.select("n_docs").scalar()
    avgdl = index.stats.select("avgdl").scalar()
    weighted = wanted.join(frequency, "token").select(
        "query_id",
        "token",
        F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf"),
    )
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl)
    weighted = written(weighted, "weights")
    hits = index.postings.join(weighted, "token")
    return hits.groupBy("query_id", "chunk_id", "book_id").agg(
        F.round(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / norm), 6).alias("score")
    )


def top_k(scores: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """The best ``k`` chunks of each query behind ``offset``, by score and chunk id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    ranked = scores.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k + offset)
    return ranked.filter(F.col("rank") > offset) if offset else ranked


def hit_totals(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id").agg(F.count("*").alias("total"))


def scope_filter(
    scores: DataFrame, scopes: DataFrame, books: DataFrame, links: DataFrame, chunks: DataFrame | None = None
) -> DataFrame:
    """Keep hits inside the scope of their query: book list, category, tag and chapter, intersected.

    ``scopes(query_id, book_ids, category, tag_id)``, and ``chapter_id`` if ``chunks(chunk_id,
    chapter_id)`` are given; NULL leaves a dimension open, an empty list
    or intersection gives no hit.
    """
    scoped = scores.join(scopes, "query_id", "left").filter(
        F.col("book_ids").isNull() | F.array_contains("book_ids", F.col("book_id"))
    )
    shelves = books.select("book_id", F.col("category").alias("shelf"))
    in_category = scoped.join(shelves, "book_id", "left").filter(
        F.col("category").isNull() | (F.col("shelf") == F.col("category"))
    )
    linked = links.select("book_id", "tag_id").distinct().withColumn("linked", F.lit(True))
    tagged = in_category.join(linked, ["book_id", "tag_id"], "left")
    kept = tagged.filter(F.col("tag_id").isNull() | F.col("linked"))
    if chunks is not None and "chapter_id" in scopes.columns:
        # Only hits of queries with a chapter look up theirs.
        own = chunks.select("chunk_id", F.col("chapter_id").alias("own_chapter"))
        within = kept.filter("chapter_id IS NOT NULL").join(own, "chunk_id").filter("own_chapter = chapter_id")
        kept = kept.filter("chapter_id IS NULL").select(*scores.columns).unionByName(within.select(*scores.columns))
    return kept.select(*scores.columns)


def snippet(tokens: Column, wanted: Column, width: int = 12) -> Column:
    """``width`` tokens around the densest match, hits in brackets, ``…`` at the cuts."""

    def build(flags: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(flags) - width + 1, F.lit(1)))
        counts = F.transform(starts, lambda i: F.size(F.filter(F.slice(flags, i, width), lambda f: f)))

        def render(at: Column) -> Column:
            shown = F.zip_with(
                F.slice(tokens, at, width),
                F.slice(flags, at, width),
                lambda t, f: F.when(f, F.concat(F.lit("["), t, F.lit("]"))).otherwise(t),
            )
            return F.concat(
                F.when(at > 1, "…").otherwise(""),
                F.array_join(shown, " "),
                F.when(at + width - 1 < F.size(flags), "…").otherwise(""),
            )

        return let(let(counts, lambda c: F.array_position(c, F.array_max(c)).cast("int")), render)

    return let(F.transform(tokens, lambda t: F.array_contains(wanted, F.lower(t))), build)


def fallback_phrases(queries: DataFrame) -> DataFrame:
    """The three longest words of each query; without words its first 20 characters."""
    text = F.lower(strip(F.col("text")))
    found = words(text)
    phrases = F.when(F.size(found) > 0, longest(found, 3)).otherwise(F.array(F.substring(text, 1, 20)))
    return queries.select("query_id", F.explode(phrases).alias("phrase")).filter("phrase <> ''")


def _grams(text: Column, n: Column) -> Column:
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    )


def substring_search(
    queries: DataFrame,
    chunks: DataFrame,
    limit: int = P.TOP_K,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Chunks that contain a fallback phrase of the query, lowest chunk ids first.

    ``keep`` filters rows with ``query_id`` and ``book_id`` to the scope of their query.

    A text is a sequence of runs of word characters and runs of others, and any piece of a phrase
    that is such a run lies inside one run of the text. So phrases are matched against the distinct
    runs of the corpus through the rarest character pair of their longest piece, an equi join on a
    vocabulary, and only phrases of several pieces are looked up in the text itself.
    """
    pieces = F.regexp_extract_all("phrase", F.lit(RUNS), F.lit(0))
    phrases = (
        fallback_phrases(queries)
        .select("query_id", "phrase", longest(pieces, 1)[0].alias("piece"), F.size(pieces).alias("n_pieces"))
    )
    runs = chunks.select(
        "chunk_id", "book_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(RUNS), F.lit(0)))).alias("run")
    )
    vocabulary = runs.select("run").distinct()
    two, one = F.lit(2), F.lit(1)
    run_grams = vocabulary.select(
        "run",
        F.explode(
            F.concat(_grams(F.col("run"), one), F.when(F.length("run") > 1, _grams(F.col("run"), two)).otherwise(F.array().cast("array<string>")))
        ).alias("gram"),
    )
    piece_grams = written(
        phrases.select("piece").distinct().select(
            "piece", F.explode(_grams(F.col("piece"), F.least(F.length("piece"), two))).alias("gram")
        ),
        "grams",
    )
    relevant = run_grams.join(piece_grams.select("gram").distinct(), "gram", "left_semi")
    gram_counts = relevant.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = piece_grams.join(gram_counts, "gram").groupBy("piece").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram")
    )
    matched = rarest.join(relevant, "gram").filter(F.contains("run", "piece")).select("piece", "run")
    # A phrase of one piece needs only its lowest chunk ids; equal ids share a dense rank.
    lowest = F.dense_rank().over(Window.partitionBy("query_id", "phrase").orderBy("chunk_id"))
    wanted = written(matched.join(phrases, "piece"), "pieces")
    found = runs.join(wanted, "run").select(
        "query_id", "phrase", "n_pieces", "chunk_id", "book_id"
    )
    if keep:
        found = keep(found)
    whole = found.filter("n_pieces = 1").withColumn("at", lowest).filter(F.col("at") <= limit)
    checked = (
        found.filter("n_pieces > 1")
        .distinct()
        .join(chunks.select("chunk_id", "content"), "chunk_id")
        .filter(F.contains(F.lower("content"), F.col("phrase")))
        .select("query_id", "chunk_id")
    )
    hits = whole.select("query_id", "chunk_id").unionByName(checked).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    return hits.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= limit)


_SCOPE = {"book_ids": "book_id", "category": "category", "tag_id": "tag_ids"}


def scoped_vectors(vectors: DataFrame, books: DataFrame, links: DataFrame) -> DataFrame:
    """Vectors with the category and the tags of their book, for searches within a scope."""
    tags = links.groupBy("book_id").agg(F.collect_set("tag_id").alias("tag_ids"))
    return vectors.join(books.select("book_id", "category"), "book_id", "left").join(tags, "book_id", "left")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """Nearest chunks by cosine similarity, exactly.

    ``queries(query_id, embedding)`` are taken in blocks of at most ``block`` vectors, the only
    thing sent to the tasks; ``vectors(chunk_id, embedding)`` are never moved. A task multiplies its
    batch with the block and passes on its own ``k`` best per query. Queries may carry ``book_ids``,
    ``category`` and ``tag_id`` (see ``scoped_vectors``); NULL leaves a dimension open.
    """
    scope = [c for c in _SCOPE if c in queries.columns]
    numbered = queries.select("query_id", "embedding", *scope).orderBy("query_id")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id bigint, score double"
    context = queries.sparkSession.sparkContext
    columns = _SCOPE

    def search(rows: list) -> DataFrame:
        ids = [r.query_id for r in rows]
        matrix = np.asarray([r.embedding for r in rows], dtype=np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        limits = [(i, {c: r[c] for c in scope if r[c] is not None}) for i, r in enumerate(rows)]
        shared = context.broadcast((ids, matrix / np.where(norms == 0, 1, norms), [x for x in limits if x[1]]))

        def outside(batch: pd.DataFrame, limit: dict) -> np.ndarray:
            out = np.zeros(len(batch), dtype=bool)
            for name, wanted in limit.items():
                values = batch[columns[name]]
                if name == "book_ids":
                    out |= ~values.isin(wanted).to_numpy()
                elif name == "category":
                    out |= (values != wanted).to_numpy()
                else:
                    out |= np.array([tags is None or wanted not in tags for tags in values], dtype=bool)
            return out

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q, scoped = shared.value
            for batch in batches:
                if batch.empty:
                    continue
                m = np.asarray(batch["embedding"].tolist(), dtype=np.float64)
                size = np.linalg.norm(m, axis=1)
                scores = np.round((q @ m.T) / np.where(size == 0, 1, size), 6)
                for i, limit in scoped:
                    scores[i, outside(batch, limit)] = -np.inf
                chunk = batch["chunk_id"].to_numpy()
                # Best scores first, smaller chunk ids first among equal scores.
                order = np.lexsort((np.broadcast_to(chunk, scores.shape), -scores), axis=1)[:, :k]
                best = pd.DataFrame(
                    {
                        "query_id": np.repeat(names, order.shape[1]),
                        "chunk_id": chunk[order].ravel(),
                        "score": np.take_along_axis(scores, order, axis=1).ravel(),
                    }
                )
                yield best[best["score"] > -np.inf]

        return vectors.select("chunk_id", "embedding", *[_SCOPE[c] for c in scope]).mapInPandas(nearest, schema)

    found, rows = [], []
    for row in numbered.toLocalIterator():
        rows.append(row)
        if len(rows) == block:
            found.append(search(rows))
            rows = []
    if rows or not found:
        found.append(search(rows) if rows else queries.sparkSession.createDataFrame([], schema))
    return top_k(reduce(DataFrame.unionByName, found), k)


def enrich_hits(hits: DataFrame, chunks: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Titles, page range and a 400-character snippet for each hit.

    Hits are written before they meet the chunks: the planner then knows that they are the small side, and of
    chunks, books and chapters only rows of hits move.
    """
    body = chunks.select("chunk_id", "chapter_id", "page_start", "page_end", "chunk_index", "content",
                         F.col("book_id").alias("of_book"))
    hits = written(hits.drop("book_id"), "hits")
    found = written(hits.join(body, "chunk_id").withColumnRenamed("of_book", "book_id"), "bodies")

    def titles(df: DataFrame, key: str, name: str) -> DataFrame:
        wanted = found.select(key).filter(F.col(key).isNotNull()).distinct()
        return df.select(key, F.col("title").alias(name)).join(wanted, key, "left_semi")

    return (
        found.join(titles(books, "book_id", "book_title"), "book_id", "left")
        .join(titles(chapters, "chapter_id", "chapter_title"), "chapter_id", "left")
        .withColumn("page_end", F.coalesce("page_end", "page_start"))
        .withColumn("book_title", F.coalesce("book_title", F.lit("")))
        .withColumn("snippet", F.substring("content", 1, P.SNIPPET_CHARS))
    )


def fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``(query_id, chunk_id, rank)``; keeps ``2 k``."""
    union = reduce(DataFrame.unionByName, [df.select("query_id", "chunk_id", "rank") for df in lists])
    fused = union.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (P.RRF_K + F.col("rank"))), 10).alias("score")
    )
    return top_k(fused, 2 * k)


def rerank(candidates: DataFrame, k: int) -> DataFrame:
    """Feature score of candidates ``(query_id, chunk_id, text, content, score, rank)``.

    Word coverage, coverage of the first 200 characters, the fused score and a length score.
    """
    wanted = F.slice(words(F.col("text")), 1, 10)
    content = F.col("content")

    def share(text: Column) -> Column:
        return let(
            wanted,
            lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(
                F.size(F.filter(w, lambda x: F.contains(text, x))) / F.size(w)
            ),
        )

    size = F.length(content)
    length_score = F.when(size < 50, 0.3).when(size > 2000, 0.5).otherwise(1.0)
    final = (
        share(content) * 0.4
        + share(F.substring(content, 1, 200)) * 0.2
        + F.least(F.col("score") * 100, F.lit(1.0)) * 0.3
        + length_score * 0.1
    )
    scored = candidates.withColumn("final", final)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "rank"))
    return (
        scored.withColumn("new_rank", rank.cast("bigint"))
        .filter(F.col("new_rank") <= k)
        .withColumn("rerank_score", round_half_even(F.col("final"), 4))
        .drop("final", "rank")
        .withColumnRenamed("new_rank", "rank")
    )


def neighbour_context(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Whole chapter when it has at most three chunks, else the chunk with its neighbours.

    ``hits(query_id, chunk_id, book_id, chapter_id, chunk_index)``. The index of a chapter's chunks
    is contiguous, so neighbours are found by an equi join on the shifted index; only hits move. They are
    written first, so that the planner knows their bytes and leaves the chunks where they lie.
    """
    reach = max(radius, 2)
    hits = written(hits.select("query_id", "chunk_id", "book_id", "chapter_id", "chunk_index"), "hits")
    wanted = hits.select(
        "query_id", "chunk_id", "book_id", F.col("chapter_id").alias("own_chapter"), "chunk_index",
        F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift"),
    ).withColumn("at", F.col("chunk_index") + F.col("shift"))
    around = chunks.select("book_id", F.col("chunk_index").alias("at"), "chapter_id", "content")
    # A chunk without a chapter counts with the others of its book that have none.
    group = ["book_id", F.coalesce("chapter_id", F.lit(-1)).alias("group")]
    touched = hits.select(*group).distinct()
    sizes = chunks.select(*group).join(touched, ["book_id", "group"], "left_semi").groupBy("book_id", "group").agg(
        F.count("*").alias("n")
    )
    near = (
        wanted.join(around, ["book_id", "at"])
        .filter(F.col("chapter_id").eqNullSafe(F.col("own_chapter")))
        .withColumn("group", F.coalesce("own_chapter", F.lit(-1)))
        .join(sizes, ["book_id", "group"])
        .filter((F.col("n") <= 3) | (F.abs("shift") <= radius))
    )
    pairs = F.sort_array(F.collect_list(F.struct("at", "content")))
    return near.groupBy("query_id", "chunk_id").agg(
        F.array_join(F.transform(pairs, lambda p: p["content"]), "\n").alias("context")
    )


def outline_fallback(queries: DataFrame, hits: DataFrame, books: DataFrame, chapters: DataFrame, n_books: int = 3) -> DataFrame:
    """For queries without any hit: the first 40 chapter titles of the books in scope.

    ``queries`` may carry ``book_ids``; without it the ``n_books`` first books are shown.
    """
    missed = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    if "book_ids" not in missed.columns:
        missed = missed.withColumn("book_ids", F.lit(None).cast("array<bigint>"))
    default = books.select("book_id").orderBy("book_id").limit(n_books).agg(
        F.collect_list("book_id").alias("ids")
    ).scalar()
    scoped = missed.select("query_id", F.explode(F.coalesce("book_ids", default)).alias("book_id"))
    shown = chapters.filter("order_index < 40").join(scoped.select("book_id").distinct(), "book_id", "left_semi")
    titles = shown.groupBy("book_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("order_index", "title"))), lambda c: c["title"]), " / "
        ).alias("titles")
    )
    line = F.concat(F.lit("《"), F.col("title"), F.lit("》目录："), F.coalesce("titles", F.lit("")))
    lines = scoped.join(books.select("book_id", "title"), "book_id").join(titles, "book_id", "left").select(
        "query_id", "book_id", line.alias("line")
    )
    return lines.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("book_id", "line"))), lambda x: x["line"]), "\n"
        ).alias("snippet")
    )


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    books: DataFrame,
    chapters: DataFrame,
    index: Index | BlockIndex,
    vector_hits: DataFrame | None = None,
    k: int = P.TOP_K,
    scopes: DataFrame | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """Answer all queries: search, substring fallback, fusion, re-ranking, context, outline.

    ``scopes`` and ``links`` are those of ``scope_filter``; vector hits come within scope already.

    The ranked lists, at most ``2 k`` rows per query, are checkpointed because several later steps
    read them; the corpus is scored once. A stored index of blocks reads only what can be among them.
    """
    ranked = ["query_id", "chunk_id", "rank"]
    keep = None if scopes is None else lambda hits: scope_filter(hits, scopes, books, links, chunks)
    if isinstance(index, Index):
        scores = bm25_scores(queries, index)
        best = top_k(keep(scores) if keep else scores, 2 * k)
        fallback = lambda weak: substring_search(weak, chunks, k, keep)
    else:
        scope = None if scopes is None else index.scope(scopes, books, links)
        best = index.search(queries, 2 * k, scope).top
        fallback = lambda weak: index.substrings(weak, k, scope)
    full_text = checkpointed(best.select(*ranked))
    primary = [full_text] if vector_hits is None else [checkpointed(vector_hits.select(*ranked)), full_text]
    counts = reduce(
        DataFrame.unionByName, [df.select("query_id", "chunk_id") for df in primary]
    ).groupBy("query_id").agg(F.count("*").alias("n"))
    enough = counts.filter(F.col("n") >= P.MIN_PRIMARY_HITS)
    weak = queries.join(enough, "query_id", "left_anti")
    # Usually every query has hits enough, and the corpus is not searched a second time.
    lists = primary if weak.isEmpty() else [*primary, fallback(weak).select(*ranked)]
    fused = checkpointed(fuse(lists, k))
    described = enrich_hits(fused, chunks, books, chapters).join(queries.select("query_id", "text"), "query_id")
    best = checkpointed(rerank(described, k))
    with_context = best.join(neighbour_context(best, chunks), ["query_id", "chunk_id"], "left")
    columns = ["query_id", "rank", "chunk_id", "book_id", "book_title", "chapter_title", "page_start", "page_end",
               "snippet", "context", "rerank_score"]
    asked = queries if scopes is None else queries.join(scopes.select("query_id", "book_ids"), "query_id", "left")
    outlines = outline_fallback(asked, fused, books, chapters).select(
        "query_id", F.lit(1).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("chunk_id"),
        F.lit(None).cast("bigint").alias("book_id"), F.lit("").alias("book_title"), F.lit(None).cast("string").alias("chapter_title"),
        F.lit(None).cast("bigint").alias("page_start"), F.lit(None).cast("bigint").alias("page_end"), "snippet",
        F.col("snippet").alias("context"), F.lit(None).cast("double").alias("rerank_score"),
    )
    return with_context.select(*columns).unionByName(outlines)
