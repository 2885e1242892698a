"""Chunking, keywords, definitions, theorems, duplicates."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.operators import chunking, dedup, graph, lexical

INTERVAL = "book_id bigint, chapter_index bigint, start_page bigint, end_page bigint"


def cut(spark, texts, packer, intervals=((None, 1, None),)):
    pages = spark.createDataFrame([(1, list(texts))], "book_id bigint, pages array<string>")
    spans = spark.createDataFrame([(1, c, s, e or len(texts)) for c, s, e in intervals], INTERVAL)
    return chunking.chunk_books(pages, spans, packer).orderBy("chunk_index").collect()


def test_window_two_pages(spark):
    made = cut(spark, ["a" * 300, "b" * 300], chunking.window_chunks)
    assert [(c.page_start, c.page_end) for c in made] == [(1, 1), (1, 2)] and all(c.word_count <= 600 for c in made)


def test_window_long_page(spark):
    made = cut(spark, ["a" * 2000], chunking.window_chunks)
    assert len(made) == 4 and all(c.word_count <= 600 for c in made)


def test_window_exact_page(spark):
    assert [c.word_count for c in cut(spark, ["a" * 600], chunking.window_chunks)] == [600]


def test_semantic_pages(spark):
    made = cut(spark, ["第一段。\n\n第二段。", "第三段。"], chunking.pack_paragraphs)
    assert [(c.page_start, c.page_end) for c in made] == [(1, 2)] and made[0].content == "第一段。\n\n第二段。\n\n第三段。"


def test_semantic_chapters(spark):
    made = cut(spark, ["甲文", "乙文"], chunking.pack_paragraphs, [(1, 1, 1), (2, 2, 2)])
    assert [(c.chunk_index, c.chapter_index) for c in made] == [(0, 1), (1, 2)]


def test_long_paragraph(value):
    parts = value("这是一个句子。" * 300, chunking.split_paragraphs)
    assert len(parts) >= 2 and all(len(p) <= 900 for p in parts) and "".join(parts) == "这是一个句子。" * 300


def test_chunks_hold_whole_text(spark):
    rng = random.Random(1)
    texts = ["\n\n".join("字" * rng.randint(1, 700) for _ in range(rng.randint(0, 6))) for _ in range(30)]
    made = cut(spark, texts, chunking.pack_paragraphs)
    assert "".join(c.content for c in made).replace("\n\n", "") == "".join(texts).replace("\n\n", "")
    assert [c.chunk_index for c in made] == list(range(len(made)))
    assert all(c.word_count - 2 * c.content.count("\n\n") <= 900 for c in made)


def test_a_book_of_a_hundred_thousand_paragraphs(spark):
    pages = spark.range(1, 5001).select(
        F.lit(1).cast("bigint").alias("book_id"), F.col("id").alias("page"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.repeat(F.lit("字"), (F.col("id") * 7 + i * 13) % 60 + 1)), "\n\n").alias("text")
    )
    spans = spark.createDataFrame([(1, None, 1, 5000)], INTERVAL)
    made = chunking.chunk_pages(pages, spans).orderBy("chunk_index").collect()
    lengths = [(page * 7 + i * 13) % 60 + 1 for page in range(1, 5001) for i in range(1, 21)]
    sizes, open_ = [], 0
    for n in lengths:
        if open_ and open_ + n > 900:
            sizes.append(open_)
            open_ = 0
        open_ += n
    assert [c.content.count("字") for c in made] == [*sizes, open_]
    assert [c.chunk_index for c in made] == list(range(len(made))) and made[-1].page_end == 5000
    assert chunking.chunk_pages(pages, spans, chunking.window_chunks).count() > 1000


def test_definitions(value):
    found = value("导数是指函数在某一点的变化率。极限是函数趋近的值。", lexical.definitions)
    assert [d.term for d in found] == ["导数"]
    assert [d.term for d in value("前文\n矩阵的概念：数字排成的表；\n后文", lexical.definitions)] == ["矩阵"]
    assert value("矩阵是指没有句号的一行\n后文", lexical.definitions) == []
    assert [d.term for d in value("后文\n矩阵是指没有句号的末行", lexical.definitions)] == ["矩阵"]


def test_theorems(value):
    found = value("定理 3.2：拉格朗日中值定理，若函数连续则存在一点。\n柯西定理：若可导则成立。\n拉格朗日中值定理：重复的内容。", lexical.theorems)
    assert found[0].type == "定理" and found[0].number == "3.2" and "拉格朗日" in found[0].statement
    assert [t.type for t in found] == ["定理", "柯西定理"]


def test_keywords(value):
    assert "导数" in value("导数 导数 导数 函数 函数 极限 积分", lambda c: lexical.keywords(c, 5))
    assert value("abc abc 12 12", lexical.keywords) == []
    assert value("abc abc xy 12 12", lambda c: lexical.keywords(c, script=None)) == ["abc", "xy"]


def test_classifier(value):
    seeds = {"甲": ["矩阵", "向量"], "乙": ["市场", "价格"]}
    assert value("矩阵 市场", lambda c: lexical.classify(c, seeds)) == "甲"
    assert value("价格 市场 矩阵", lambda c: lexical.classify(c, seeds)) == "乙"
    assert value("无", lambda c: lexical.classify(c, seeds)) == lexical.OTHER


def test_exact_duplicates(spark, rows):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, "z")], "file_id bigint, content string")
    found = dedup.exact_duplicates(df)
    assert rows(found, "file_id", "duplicate_of") == [(1, None), (2, None), (3, 1), (4, None)]
    known = found.filter("file_id = 2").select("file_hash")
    assert [r[0] for r in rows(dedup.exact_duplicates(df, known), "file_id")] == [1, 3, 4]


def brute_force(prints, limit):
    found = {}
    for doc, value in prints:
        near = [d for d, v in prints if d < doc and bin((v ^ value) & (2**64 - 1)).count("1") <= limit]
        found[doc] = min(near, default=None)
    return sorted(found.items(), key=repr)


def test_near_duplicates_against_brute_force(spark, rows):
    rng = random.Random(7)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    centres = [rng.getrandbits(64) for _ in range(5)]
    prints = []
    for doc in range(300):
        value = rng.choice(centres) if rng.random() < 0.6 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 8)):
            value ^= 1 << bit
        prints.append((doc, signed(value)))
    prints += [(1000 + i, prints[i][1]) for i in range(0, 300, 7)]
    df = spark.createDataFrame(prints, "doc_id bigint, fingerprint bigint")
    expected = brute_force(prints, 10)
    # A tiny group limit forces many rounds; the result must not depend on it.
    for limit in (5, 2000):
        assert rows(dedup.near_duplicates(df, 10, group_limit=limit)) == expected
    assert rows(dedup.near_duplicates(df, 3)) == brute_force(prints, 3)


def test_fingerprints_of_close_texts(spark):
    base = " ".join(f"word{i}" for i in range(200))
    df = spark.createDataFrame(
        [(1, base), (2, base), (3, base.replace("word7 ", "other ")), (4, " ".join(f"else{i}" for i in range(200))), (5, "!!")],
        "doc_id bigint, text string",
    )
    made = {r.doc_id: r.fingerprint for r in dedup.fingerprints(df).collect()}
    gap = lambda a, b: bin((made[a] ^ made[b]) & (2**64 - 1)).count("1")
    assert gap(1, 2) == 0 and gap(1, 3) <= 10 < gap(1, 4) and made[5] == 0


def test_concept_graph(spark, rows):
    df = spark.createDataFrame(
        [(1, ["导数", "极限", "我们"], [("定理",)]), (2, ["极限", "导数", "12"], [("定理",)]), (3, ["极限"], [])],
        "book_id bigint, keywords array<string>, theorems array<struct<type:string>>",
    )
    nodes = graph.nodes(graph.concepts(df), 2)
    assert rows(nodes, "name", "n_books") == sorted([("极限", 3), ("定理", 2)], key=repr)
    every = graph.nodes(graph.concepts(df))
    assert rows(graph.edges(df, every)) == sorted([("导数", "极限", 1), ("极限", "导数", 1)], key=repr)
    assert [r[2] for r in rows(graph.edges(df, every, undirected=True))] == [2]


def test_a_pair_of_blocks_against_brute_force():
    """More members and leaders than are compared at a time, prints with the sign bit, a block with itself."""
    rng = random.Random(3)
    prints = [(d, rng.getrandbits(64) if d % 3 else rng.getrandbits(9) << 55) for d in range(2500)]
    prints = [(d, v - (1 << 64) if v >> 63 else v) for d, v in prints]
    arrays = lambda block: ([d for d, _ in block], [v for _, v in block])
    early, late = prints[:1200], prints[1200:]
    for members, leaders in ((late, early), (late, late)):
        blocks = {0: leaders, 1: members} if members is not leaders else {0: members}
        pair = pd.DataFrame([(n, *arrays(b)) for n, b in blocks.items()], columns=["block", "ids", "prints"])
        made = {r.first_id: r.match for r in dedup._smallest_matches(3)(pair).itertuples()}
        close = lambda v, w: bin((v ^ w) & (2**64 - 1)).count("1") <= 3
        expected = {d: next((e for e, w in leaders if e < d and close(v, w)), None) for d, v in members}
        assert made == {d: e for d, e in expected.items() if e is not None} and made


def test_quick_patterns_match_the_same(spark):
    parts = ["的定义", "的概念：", "是指", "即为", "即", "表示", "矩阵", "A-b", "(x)", "ABC def", " ", "\n", "。", "；", "12", "数字排成的表"]
    chance = random.Random(5)
    df = spark.createDataFrame([("".join(chance.choices(parts, k=12)),) for _ in range(2000)], "text string")
    for pattern, words in ((P.DEFINITION_OF, P.DEFINITION_OF_WORDS), (P.DEFINITION_IS, P.DEFINITION_IS_WORDS)):
        found = [F.regexp_extract_all("text", F.lit(p), F.lit(g)) for g in (0, 1, 2) for p in (pattern, lexical._quick(pattern, words))]
        assert df.filter(F.size(found[0]) > 0).count() > 500
        assert df.filter((found[0] != found[1]) | (found[2] != found[3]) | (found[4] != found[5])).count() == 0


def test_wanted_tags_are_made_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(book):
        seen.add(1)
        return f"tag {book % 3}"

    wanted = spark.range(12).select(F.col("id").alias("book_id"), name("id").alias("name"))
    tags = spark.createDataFrame([(1, "tag 0")], "tag_id bigint, name string")
    links = spark.createDataFrame([(0, 1)], "book_id bigint, tag_id bigint")
    new_tags, new_links = lexical.assign_tags(wanted, tags, links)
    assert sorted(rows(new_tags, "tag_id", "name")) == [(2, "tag 1"), (3, "tag 2")]
    assert sorted(rows(new_links, "book_id", "tag_id")) == [(b, b % 3 + 1) for b in range(1, 12)]
    assert seen.value == 12
