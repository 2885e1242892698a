"""Index, retrieval, prompts and answer checks on a small library."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import answers as A
from quire.operators import blocks, index, retrieval
from quire.session import checkpointed, fresh_path

CHUNK = "chunk_id bigint, book_id bigint, chapter_id bigint, chunk_index bigint, page_start bigint, page_end bigint, content string"


@pytest.fixture(scope="module")
def library(spark):
    rows = [(10 + i, 1, 1, i, i + 1, i + 1, f"alpha part {i}") for i in range(3)]
    rows += [(20 + i, 1, 2, 3 + i, 4 + i, 5 + i, f"beta section {i}") for i in range(5)]
    rows += [(30, 2, None, 0, 1, None, "gamma alpha; thermodynamics"), (31, 2, None, 1, 2, 2, "gamma delta"), (32, 2, 3, 2, 3, 3, "gamma beta beta")]
    chunks = spark.createDataFrame(rows, CHUNK)
    books = spark.createDataFrame([(1, "One", "x"), (2, "Two", "y")], "book_id bigint, title string, category string")
    chapters = spark.createDataFrame(
        [(1, 1, "First", 0), (2, 1, "Second", 1), (3, 2, "Third", 0)], "chapter_id bigint, book_id bigint, title string, order_index bigint"
    )
    return chunks, books, chapters


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def test_bm25_against_formula(spark, library):
    chunks = library[0]
    made = {r.chunk_id: r.score for r in retrieval.bm25_scores(asked(spark, "beta"), index.build_index(chunks)).collect()}
    sizes = {r.chunk_id: len(r.content.replace(";", "").split()) for r in chunks.collect()}
    average = sum(sizes.values()) / len(sizes)
    counts = {**{20 + i: 1 for i in range(5)}, 32: 2}
    idf = max(math.log((11 - 6 + 0.5) / (6 + 0.5)), 1e-6)
    for chunk, tf in counts.items():
        score = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[chunk] / average))
        assert made[chunk] == pytest.approx(score, abs=1e-6)
    assert set(made) == set(counts)


@pytest.fixture(scope="module")
def stored(spark, library):
    return blocks.write_index(library[0], fresh_path(spark, "test-index"))


def test_stored_index_is_the_same(spark, library, stored, rows):
    direct = index.build_index(library[0])
    one = stored.table("blocks").select("token", "slot", F.explode("postings").alias("p")).select("token", F.expr(f"slot * 64 + {blocks.PLACE}").alias("number"), F.expr(blocks.TF).alias("tf"), F.expr(blocks.DL).alias("dl"))
    named = one.join(stored.table("entries").select("number", "chunk_id", "book_id"), "number")
    assert rows(named, "chunk_id", "book_id", "token", "tf", "dl") == rows(direct.postings, "chunk_id", "book_id", "token", "tf", "dl")
    assert rows(stored.table("frequency"), "token", "df") == rows(direct.frequency, "token", "df")
    assert (stored.n_docs, stored.avgdl) == pytest.approx(tuple(direct.stats.first()))
    again = blocks.read_index(spark, stored.path)
    assert again == stored
    blocks.write_phrases(stored)
    assert blocks.read_index(spark, stored.path).phrases
    bits = stored.table("blocks").select(F.bit_count("mask").alias("n"), F.size("postings").alias("m"))
    assert bits.filter("n <> m").count() == 0


def made_chunks(spark, count):
    """Chunks of frequent and rare words; some words stand in all of them, some in a few."""
    chance = random.Random(4)
    common, rare = [f"w{i}" for i in range(12)], [f"rare{i}" for i in range(count // 8)]
    texts = [" ".join(chance.choices(common, k=chance.randrange(3, 30)) + (chance.sample(rare, 2) if chance.random() < 0.3 else [])) + "; end." for _ in range(count)]
    order = chance.sample(range(count), count)
    rows = [(order[i], order[i] // 40, order[i] // 10 if order[i] % 3 else None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id bigint, book_id bigint, chapter_id bigint, content string").coalesce(3)


@pytest.fixture(scope="module")
def many(spark):
    chunks = checkpointed(made_chunks(spark, 2000))
    return chunks, blocks.write_index(chunks, fresh_path(spark, "many"))


def test_search_in_blocks_is_the_search_of_all_postings(spark, many, rows):
    chunks, stored = many
    questions = asked(spark, "w1 w2 rare7", "w1", "rare3 rare9 rare11", "w0 w1 w2 w3 w4 w5 w6 w7", "nothing", "", None, "rare5 w3 end")
    scores = retrieval.bm25_scores(questions, index.build_index(chunks))
    for k in (1, 30):
        found = stored.search(questions, k)
        columns = ("query_id", "chunk_id", "book_id", "score", "rank")
        assert rows(found.top, *columns) == rows(retrieval.top_k(scores, k), *columns)
        assert rows(found.totals, "query_id", "total") == rows(retrieval.hit_totals(scores), "query_id", "total")
    # Slots without the rare word cannot reach the best scores: their blocks of frequent words are not read.
    found = stored.search(questions.filter("query_id = 0"), 1)
    assert found.scored.count() < found.slots.count() / 2


def test_scopes_in_blocks(spark, many, rows):
    chunks, stored = many
    books = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(48)], "book_id bigint, category string")
    links = spark.createDataFrame([(3, 7), (4, 7), (4, 7), (5, 8)], "book_id bigint, tag_id bigint")
    scopes = spark.createDataFrame(
        [(0, None, None, None, None), (1, [1, 2, 99], None, None, None), (2, None, "even", None, None), (3, [3, 4], "even", 7, None),
         (4, None, None, 7, None), (5, [], None, None, None), (6, None, None, None, 31), (7, None, "none", None, None), (8, [3], None, None, 31)],
        "query_id bigint, book_ids array<bigint>, category string, tag_id bigint, chapter_id bigint",
    )
    questions = asked(spark, *["w1 w2 rare7"] * 10)
    scores = retrieval.bm25_scores(questions, index.build_index(chunks))
    kept = retrieval.scope_filter(scores, scopes, books, links, chunks)
    found = stored.search(questions, 4, stored.scope(scopes, books, links))
    assert rows(found.top, "query_id", "chunk_id", "score", "rank") == rows(retrieval.top_k(kept, 4), "query_id", "chunk_id", "score", "rank")
    assert rows(found.totals, "query_id", "total") == rows(retrieval.hit_totals(kept), "query_id", "total")
    keep = lambda hits: retrieval.scope_filter(hits, scopes, books, links, chunks)
    phrases = asked(spark, *["are7 d."] * 10)
    made = stored.substrings(phrases, 4, stored.scope(scopes, books, links))
    assert rows(made, "query_id", "chunk_id", "rank") == rows(retrieval.substring_search(phrases, chunks, 4, keep), "query_id", "chunk_id", "rank")


def test_empty_index(spark):
    stored = blocks.write_index(spark.createDataFrame([], "chunk_id bigint, book_id bigint, content string"), fresh_path(spark, "empty"))
    found = stored.search(asked(spark, "x"), 3)
    assert found.top.count() == found.totals.count() == stored.substrings(asked(spark, "x")).count() == 0


def test_ties_and_pages(spark, library):
    scores = retrieval.bm25_scores(asked(spark, "section"), index.build_index(library[0]))
    first = [r.chunk_id for r in retrieval.top_k(scores, 2).orderBy("rank").collect()]
    second = [r.chunk_id for r in retrieval.top_k(scores, 2, offset=2).orderBy("rank").collect()]
    assert first + second == [20, 21, 22, 23]


def test_scopes(spark, library, rows):
    chunks, books, _ = library
    scores = retrieval.bm25_scores(asked(spark, *["alpha gamma"] * 5), index.build_index(chunks))
    scopes = spark.createDataFrame(
        [(0, None, None, None), (1, [1], None, None), (2, None, "y", None), (3, [1], "y", None), (4, None, None, 7)],
        "query_id bigint, book_ids array<bigint>, category string, tag_id bigint",
    )
    links = spark.createDataFrame([(2, 7)], "book_id bigint, tag_id bigint")
    kept = retrieval.scope_filter(scores, scopes, books, links)
    seen = {}
    for query, book in rows(kept.select("query_id", "book_id").distinct()):
        seen.setdefault(query, set()).add(book)
    assert seen == {0: {1, 2}, 1: {1}, 2: {2}, 4: {2}}
    one = chunks.filter("chapter_id IS NOT NULL").select("chapter_id").orderBy("chapter_id").first().chapter_id
    in_chapter = retrieval.scope_filter(scores, scopes.withColumn("chapter_id", F.when(F.col("query_id") == 0, one)), books, links, chunks)
    found = in_chapter.filter("query_id = 0").join(chunks, "chunk_id").select("chapter_id").distinct().collect()
    assert {r.chapter_id for r in found} <= {one} and in_chapter.filter("query_id = 1").count() == kept.filter("query_id = 1").count()


@pytest.mark.parametrize(
    "query, expected",
    [("modyn", [30]), ("hermo zzz", [30]), ("a; t", [30]), ("eta", [20, 21, 22, 23, 24]), (";", [30]), ("???", [])],
)
def test_substring(spark, library, query, expected):
    found = retrieval.substring_search(asked(spark, query), library[0]).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == expected


def test_substrings_in_blocks(spark, library, stored, rows):
    limit = 2
    texts = ["modyn", "hermo zzz", "a; t", "eta", ";", "???", "b", "? ?", "n", "", "section 1", "; t", "a"]
    made = stored.substrings(asked(spark, *texts), limit)
    expected = []
    content = {r.chunk_id: r.content.lower() for r in library[0].collect()}
    for q, phrase in rows(retrieval.fallback_phrases(asked(spark, *texts)), "query_id", "phrase"):
        expected += [(q, c) for c, t in content.items() if phrase in t]
    best = {q: sorted({c for k, c in expected if k == q})[:limit] for q, _ in expected}
    assert rows(made, "query_id", "chunk_id") == sorted(((q, c) for q, cs in best.items() for c in cs), key=repr)
    assert rows(made, "query_id", "chunk_id", "rank") == rows(retrieval.substring_search(asked(spark, *texts), library[0], limit), "query_id", "chunk_id", "rank")


def test_substrings_of_many_chunks(spark, many, rows):
    chunks, stored = many
    questions = asked(spark, "are17", "w1", "rare", "end.", "w11 w0", "e", "5; e")
    made = rows(stored.substrings(questions, 7), "query_id", "chunk_id", "rank")
    assert made == rows(retrieval.substring_search(questions, chunks, 7), "query_id", "chunk_id", "rank")


def test_snippet(spark):
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(words, ["w20", "w22"])], "t array<string>, w array<string>")
    text = df.select(retrieval.snippet(F.col("t"), F.col("w")).alias("s")).first().s
    assert text.startswith("…") and "[w20]" in text and "[w22]" in text and len(text.strip("…").split()) == 12


def test_vectors_in_blocks(spark, rows):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(50)]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(7)]
    q = spark.createDataFrame(queries, "query_id bigint, embedding array<float>")
    v = spark.createDataFrame(vectors, "chunk_id bigint, embedding array<float>")
    made = rows(retrieval.vector_search(q, v, 4, block=3), "query_id", "rank", "chunk_id")
    assert made == rows(retrieval.vector_search(q, v, 4), "query_id", "rank", "chunk_id")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(np.array([e for _, e in queries])) @ unit(np.array([e for _, e in vectors])).T
    best = np.argsort(-scores, axis=1)[:, :4]
    assert made == sorted([(qi, r + 1, int(c)) for qi, row in enumerate(best) for r, c in enumerate(row)], key=repr)


def test_vectors_in_scope(spark, rows):
    vectors = spark.createDataFrame(
        [(i, i % 3, [1.0, float(i)]) for i in range(1, 10)], "chunk_id bigint, book_id bigint, embedding array<float>"
    )
    books = spark.createDataFrame([(0, "x"), (1, "y"), (2, "y")], "book_id bigint, category string")
    links = spark.createDataFrame([(2, 5)], "book_id bigint, tag_id bigint")
    queries = spark.createDataFrame(
        [(0, [0.0, 1.0], None, None, None), (1, [0.0, 1.0], [0, 1], None, None), (2, [0.0, 1.0], None, "y", None),
         (3, [0.0, 1.0], None, "y", 5), (4, [0.0, 1.0], [0], "y", None), (5, [0.0, 1.0], [], None, None)],
        "query_id bigint, embedding array<float>, book_ids array<bigint>, category string, tag_id bigint",
    )
    made = retrieval.vector_search(queries, retrieval.scoped_vectors(vectors, books, links), 2)
    assert rows(made, "query_id", "rank", "chunk_id") == [
        (0, 1, 9), (0, 2, 8), (1, 1, 9), (1, 2, 7), (2, 1, 8), (2, 2, 7), (3, 1, 8), (3, 2, 5),
    ]


def test_retrieve_in_scope(spark, library, stored):
    chunks, books, chapters = library
    queries = asked(spark, "alpha gamma", "alpha gamma", "modyn", "modyn")
    scopes = spark.createDataFrame(
        [(0, [1], None, None), (1, None, "y", None), (2, [1], None, None)],
        "query_id bigint, book_ids array<bigint>, category string, tag_id bigint",
    )
    links = spark.createDataFrame([], "book_id bigint, tag_id bigint")
    made = retrieval.retrieve(
        queries, chunks, books, chapters, index.build_index(chunks), scopes=scopes, links=links
    ).collect()
    of_blocks = retrieval.retrieve(queries, chunks, books, chapters, stored, scopes=scopes, links=links).collect()
    assert sorted(map(tuple, made), key=repr) == sorted(map(tuple, of_blocks), key=repr)
    of = lambda q: {r.book_id for r in made if r.query_id == q}
    assert of(0) == {1} and of(1) == {2} and of(3) == {2}
    assert [r.snippet for r in made if r.query_id == 2] == ["《One》目录：First / Second"]


def test_fusion_ignores_list_order(spark, rows):
    ranked = lambda data: spark.createDataFrame(data, "query_id bigint, chunk_id bigint, rank bigint")
    a, b = ranked([(0, 1, 1), (0, 2, 2)]), ranked([(0, 2, 1), (0, 3, 2)])
    one, two = rows(retrieval.fuse([a, b], 5)), rows(retrieval.fuse([b, a], 5))
    assert one == two and {r[1]: r[-1] for r in one}[2] == 1


def test_rerank(spark):
    df = spark.createDataFrame(
        [(0, 1, "ABC theorem", "ABC theorem about triangles", 0.03, 1), (0, 2, "ABC theorem", "unrelated text", 0.02, 2), (0, 3, "ABC theorem", "theorem only", 0.01, 3)],
        "query_id bigint, chunk_id bigint, text string, content string, score double, rank bigint",
    )
    made = retrieval.rerank(df, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in made] == [1, 3, 2] and all(r.rerank_score is not None for r in made)


def test_rerank_of_han_questions(spark):
    df = spark.createDataFrame(
        [(0, 1, "什么是中值定理", "本章讲述极限", 0.03, 1), (0, 2, "什么是中值定理", "柯西中值定理与罗尔定理", 0.02, 2)],
        "query_id bigint, chunk_id bigint, text string, content string, score double, rank bigint",
    )
    assert [r.chunk_id for r in retrieval.rerank(df, 2).orderBy("rank").collect()] == [2, 1]


def test_han_fallback(spark, rows):
    chunks = spark.createDataFrame(
        [(1, 1, "由拉格朗日中值定理可知"), (2, 1, "矩阵的秩"), (3, 1, "abc矩阵xyz")], "chunk_id bigint, book_id bigint, content string"
    )
    found = retrieval.substring_search(asked(spark, "中值定理", "矩阵", "bc矩"), chunks)
    assert rows(found, "query_id", "chunk_id") == [(0, 1), (1, 2), (1, 3), (2, 3)]


def test_neighbours(spark, library):
    hits = library[0].filter("chunk_id in (10, 20, 22, 30)").select(F.lit(0).alias("query_id"), "chunk_id", "book_id", "chapter_id", "chunk_index")
    made = {r.chunk_id: r.context for r in retrieval.neighbour_context(hits, library[0]).collect()}
    assert made == {
        10: "alpha part 0\nalpha part 1\nalpha part 2",
        20: "beta section 0\nbeta section 1",
        22: "beta section 1\nbeta section 2\nbeta section 3",
        30: "gamma alpha; thermodynamics\ngamma delta",
    }


def test_retrieve_and_prompts(spark, library):
    chunks, books, chapters = library
    queries = asked(spark, "beta section", "modyn", "？？？")
    made = retrieval.retrieve(queries, chunks, books, chapters, index.build_index(chunks))
    found = made.collect()
    assert {r.chunk_id for r in found if r.query_id == 1} == {30}
    assert [r.snippet for r in found if r.query_id == 2] == ["《One》目录：First / Second\n《Two》目录：Third"]
    prompts = {r.query_id: r for r in A.assemble_prompts(asked(spark, "beta section", "modyn", "？？？", "x"), made).collect()}
    assert "[资料1]（《One》 Second" in prompts[0].user and prompts[2].user.startswith("书籍目录：\n")
    assert prompts[3].system == A.ASK_WITHOUT_SOURCES and prompts[3].user == "x"
    assert [len(r.user) < 200 for r in A.assemble_prompts(queries, made, limit=20).filter("query_id = 0").collect()] == [True]


@pytest.mark.parametrize(
    "answer, n, cited, wrong, verified",
    [("甲[资料1]乙[资料2]", 2, [1, 2], [], True), ("[资料5]", 1, [5], [5], False), ("无", 3, [], [], False), ("ref2 资料0", 2, [2, 0], [0], False)],
)
def test_citations(spark, answer, n, cited, wrong, verified):
    df = spark.createDataFrame([(1, answer, n)], "chat_id bigint, answer string, n_sources bigint")
    row = A.verify_citations(df).first()
    assert (row.cited, row.mismatched, row.verified) == (cited, wrong, verified)


def test_metrics(spark):
    searches = spark.createDataFrame([(i, i, i % 3) for i in range(150)], "ts bigint, id bigint, hits bigint")
    checks = spark.createDataFrame([(1, 1, True), (2, 2, False)], "ts bigint, id bigint, verified boolean")
    row = A.retrieval_metrics(searches, checks).first()
    assert tuple(row) == (100, 1.0, 2, 0.5)
    empty = A.retrieval_metrics(searches.limit(0), checks.limit(0)).first()
    assert tuple(empty) == (0, 0.0, 0, 0.0)


@pytest.mark.parametrize(
    "answer, expected",
    [("[1]", "[1]"), ("```json\n{\"a\": 1}\n```", '{"a": 1}'), ("so: [1, 2] ok", "[1, 2]"), ("x {\"a\": 2} y", '{"a": 2}'), ("不是JSON", None)],
)
def test_json_block(value, answer, expected):
    assert value(answer, A.json_block) == expected


def test_split_answers(spark, rows):
    text = "甲" * 40 + "乙" * 40
    df = spark.createDataFrame(
        [(1, text, "不是JSON"), (2, text, f'["{"甲" * 40}", "{"乙" * 40}"]'), (3, text, '["短", "文"]'), (4, text, f'["{text}"]')],
        "chunk_id bigint, content string, answer string",
    )
    made = rows(A.validated_split(df).groupBy("chunk_id").count())
    assert made == [(1, 1), (2, 2), (3, 1), (4, 1)]


def test_blocks_are_made_before_they_are_shuffled():
    """Batches that cut a slot, rows without text and repeated words: one row per word and slot leaves the task."""
    lists = [["a", "b", "a"] if i != 70 else None for i in range(130)]
    table = pa.table({"number": pa.array(range(130), pa.int64()), "keys": pa.array(lists, pa.list_(pa.string()))})
    names = ["token", "slot", "mask", "top", "postings"]
    made = pa.Table.from_batches(blocks._blocks(names, 3.0)(iter(table.to_batches(max_chunksize=50)))).to_pylist()
    assert sorted((r["token"], r["slot"]) for r in made) == [(t, s) for t in "ab" for s in range(3)]
    for r in made:
        numbers = [n for n in range(130) if n >> 6 == r["slot"] and n != 70]
        tf = 2 if r["token"] == "a" else 1
        assert r["postings"] == [(n & 63) | tf << 6 | 3 << 32 for n in numbers]
        assert r["mask"] & (2**64 - 1) == sum(1 << (n & 63) for n in numbers)
        assert r["top"] == pytest.approx(tf * 2.2 / (tf + 1.2))
    empty = pa.table({"number": pa.array([1], pa.int64()), "keys": pa.array([None], pa.list_(pa.string()))})
    assert not sum(len(b) for b in blocks._blocks(names, 3.0)(iter(empty.to_batches())))


def test_blocks_are_packed_by_token():
    """A row for many slots of a token, cut after a number of postings and between pieces; blocks come back whole."""
    numbers = [*range(3000), *range(1 << 33, (1 << 33) + 100)]
    lists = [["a", f"r{n % 1000}", "a"] for n in numbers]
    table = pa.table({"number": pa.array(numbers, pa.int64()), "keys": pa.array(lists, pa.list_(pa.string()))})
    spans = pa.Table.from_batches(blocks._spans(iter(table.to_batches(max_chunksize=5000))))
    of_a = [r for r in spans.to_pylist() if r["token"] == "a"]
    assert len(spans) < 1200 and sum(r["n"] for r in of_a) == 6200
    assert [len(r["postings"]) for r in of_a] == [1024, 1024, 952, 64, 36]
    direct = pa.Table.from_batches(blocks._blocks(["token", "slot", "mask", "top", "postings"], 3.0)(iter(table.to_batches())))
    back = pa.Table.from_batches(blocks._unpacked(3.0)(iter(spans.drop_columns("n").to_batches())))
    order = [("token", "ascending"), ("slot", "ascending")]
    assert back.sort_by(order).to_pylist() == direct.sort_by(order).to_pylist()


def test_few_phrases_need_no_tables(spark, rows):
    texts = ["Alpha betamax", "x alphabet", "中文alpha中文", "what???", None, "", "中文章", "！？", "a-b c"]
    chunks = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id bigint, book_id bigint, content string")
    stored = blocks.write_index(chunks, fresh_path(spark, "few"))
    questions = asked(spark, "ALPHA", "中文", "??", "a-b", "bet alp", "none", "", None, "！")
    direct = rows(retrieval.substring_search(questions, chunks), "query_id", "chunk_id", "rank")
    assert rows(stored.substrings(questions), "query_id", "chunk_id", "rank") == direct and not stored.phrases
    blocks.write_phrases(stored)
    assert rows(stored.substrings(questions), "query_id", "chunk_id", "rank") == direct


def test_chunks_stay_where_they_lie(spark, many, library):
    """Hits are the side that is sent: no plan sorts the texts of the corpus to join them with a few hits."""
    chunks, stored = many
    hits = stored.search(asked(spark, "w1 rare7"), 3).top
    full = chunks.select("*", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit(0).cast("bigint").alias("chunk_index"))
    shown = retrieval.enrich_hits(hits, full, library[1], library[2])
    assert shown.count() == 3
    plan = retrieval.neighbour_context(shown, full)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(book_id#\d+L, at#", plan)
