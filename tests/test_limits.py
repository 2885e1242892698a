"""Inputs beyond what the tables hold: deep trees, large numbers, long files, text that crosses lines."""

import random

import pytest
from pyspark.sql import functions as F

from quire import session
from quire.functions import titles
from quire.functions.numbers import round_half_even
from quire.operators import answers, dedup, lexical, toc, tree
from quire.session import shared_dir
from quire.sources import files


def test_deep_chain_and_cycle(spark):
    rows = [(i, i - 1 if i else None, f"n{i}", 0) for i in range(1500)] + [(9000, 9001, "a", 0), (9001, 9000, "b", 0), (9002, 9001, "c", 0)]
    nodes = spark.createDataFrame(rows, "node_id bigint, parent_id bigint, title string, order_index bigint")
    root = spark.createDataFrame([(0,)], "root_id bigint")
    assert tree.subtree_closure(nodes, root).count() == 1500
    assert sorted(r.node_id for r in tree.delete_subtrees(nodes, root).collect()) == [9000, 9001, 9002]
    moves = spark.createDataFrame([(0, 1499), (1499, 0), (5, 9002)], "node_id bigint, target_id bigint")
    verdicts = {r.node_id: r.verdict for r in tree.validate_moves(nodes, moves).collect()}
    assert verdicts == {0: "into own subtree", 1499: "ok", 5: "target on a cycle"}
    read = {r.node_id: r.depth for r in tree.read_tree(nodes).select("node_id", "depth").collect()}
    assert read[1499] == 1499 and len(read) == 1503 and read[9000] is read[9002] is None


def walked(rows):
    """Number, last number below and depth of each node, by walking; nodes on or below a cycle have none."""
    known, children = {r[0] for r in rows}, {}
    for node, parent, order in rows:
        children.setdefault(parent if parent in known else None, []).append((order, node))
    found, at = {}, 0
    stack = [(node, 0, False) for _, node in sorted(children.get(None, []), reverse=True)]
    while stack:
        node, depth, done = stack.pop()
        if done:
            found[node] = (found[node][0], at - 1, depth)
            continue
        found[node], at = (at, None, depth), at + 1
        stack.append((node, depth, True))
        stack += [(child, depth + 1, False) for _, child in sorted(children.get(node, []), reverse=True)]
    return {node: found.get(node, (None, None, None)) for node in known}


def test_intervals_are_those_of_a_walk(spark):
    chance = random.Random(6)
    reach = [1, 6, 400]
    rows = [(i, chance.randrange(max(0, i - reach[i // 40 % 3]), i) if i and chance.random() < 0.98 else (5000 if i % 2 else None), chance.randrange(3)) for i in range(400)]
    rows += [(900, 901, 0), (901, 900, 1), (902, 901, 0), (903, 903, 0)]
    nodes = spark.createDataFrame(rows, "node_id bigint, parent_id bigint, order_index int")
    expected, walk = walked(rows), tree.intervals(nodes)
    assert {r.node_id: (r.enter, r.leave, r.depth) for r in walk.collect()} == expected
    assert max(d for *_, d in expected.values() if d is not None) > 40
    roots = [3, 7, 399, 901, 12345, *range(0, 400, 9)]
    inside = {(root, n) for root in set(roots) if expected.get(root, (None,))[0] is not None for n, (e, *_) in expected.items() if e is not None and expected[root][0] <= e <= expected[root][1]}
    asked = spark.createDataFrame([(r,) for r in roots], "root_id bigint")
    assert sorted(map(tuple, tree.subtree_closure(nodes, asked, walk).collect())) == sorted(inside)
    assert sorted(r.node_id for r in tree.delete_subtrees(nodes, asked, walk).collect()) == sorted(set(expected) - {n for _, n in inside})
    titled = nodes.select("*", F.concat(F.lit("t"), F.col("node_id") % 37, F.lit(".")).alias("title"), F.lit(None).cast("string").alias("note"))
    hits = {n for n in expected if n % 37 == 5}
    kept = {n for n, (e, last, _) in expected.items() if e is not None and any(expected[h][0] is not None and e <= expected[h][0] <= last for h in hits)}
    assert {r.node_id for r in tree.filter_with_ancestors(titled, "T5.", walk).collect()} == kept


def test_a_chain_of_a_hundred_thousand_nodes(spark):
    n = 100_000
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    walk = tree.intervals(nodes)
    assert walk.filter(f"enter <> node_id or leave <> {n - 1} or depth <> node_id").count() == 0


def test_twelve_levels(spark):
    items = spark.createDataFrame([(1, k, f"t{k}", k + 1, k + 1) for k in range(12)], "book_id bigint, seq bigint, title string, level bigint, page bigint")
    books = spark.createDataFrame([(1, 20), (2, 3)], "book_id bigint, total_pages bigint")
    found = {r.order_index: r.parent_index for r in toc.build_chapters(items, books).filter("book_id = 1").collect()}
    assert found == {k: k - 1 if k else None for k in range(12)}


def test_rounding_at_any_size(spark):
    values = [5000.5, 5000.25, 1023.995, 1024.005, 2.0**20 + 0.125, 2.0**31 + 0.25, 2.0**41 + 0.5, 2.0**52 + 1, 1e300, 0.0, -2.5, -0.125, 123456.785]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4):
        assert [r.r for r in df.select(round_half_even(df["x"], digits).alias("r")).collect()] == [round(v, digits) for v in values]


def test_long_citation_number(spark):
    df = spark.createDataFrame([(1, "见资料1，资料" + "9" * 25, 3), (2, "资料2", 3)], "chat_id bigint, answer string, n_sources bigint")
    found = {r.chat_id: (list(r.cited), list(r.mismatched), r.verified) for r in answers.verify_citations(df).collect()}
    assert found == {1: ([1, 2**63 - 1], [2**63 - 1], False), 2: ([2], [], True)}


def test_large_file_gets_a_verdict(spark, tmp_path, monkeypatch):
    (tmp_path / "small.pdf").write_bytes(b"%PDF-1.7 text")
    (tmp_path / "large.pdf").write_bytes(b"%PDF-1.7 " + b"x" * 500)
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 100)
    checked = files.check_uploads(files.route_files(files.scan_files(spark, str(tmp_path))))
    found = {r.path.rsplit("/", 1)[1]: (r.verdict, r.content is None) for r in checked.select("path", "verdict", "content").collect()}
    assert found == {"small.pdf": ("ok", False), "large.pdf": ("too large", True)}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("导数的定义：\n函数在某点的变化率。", [("导数", "函数在某点的变化率")]),
        ("导数的定义：\n\n函数在某点的变化率。\n最后一行的概念", [("导数", "函数在某点的变化率")]),
        ("导数的定义：函数在某点的变化率。", [("导数", "函数在某点的变化率")]),
        ("没有别的话", []),
    ],
)
def test_definitions_across_lines(spark, text, expected):
    found = spark.createDataFrame([(text,)], "t string").select(lexical.definitions(F.col("t")).alias("d")).first().d
    assert [(d.term, d.definition) for d in found] == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("公共管理在两千多年前随着时代的发展", "公共管理在两千多年前"),
        ("公共管理随着时代的发展组织是人类活动", "公共管理"),
        ("公 共 管 理  12", "公共管理"),
    ],
)
def test_heading_tails_in_one_pass(value, raw, expected):
    assert value(raw, titles.clean_heading) == expected


def test_blank_texts_are_no_duplicates(spark):
    texts = [(1, "！"), (2, "？？"), (3, " \n"), (4, None), (5, ""), (6, "same words here"), (7, "same words here")]
    found = {r.doc_id: r.duplicate_of for r in dedup.near_duplicates_of(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert found == {1: None, 2: 1, 6: None, 7: 6}


def test_hot_group_in_two_rounds(spark):
    """One base with many different near copies, far more than the group limit."""
    base = 0x0123456789ABCDEF
    prints = [(k, base ^ (1 << (k % 60)) ^ (1 << (k // 60 % 60))) for k in range(1200)]
    df = spark.createDataFrame(prints, "doc_id bigint, fingerprint bigint")
    found = {r.doc_id: r.duplicate_of for r in dedup.near_duplicates(df, 4, group_limit=50).collect()}
    assert found[0] is None and all(found[k] == 0 for k in range(1, 1200))


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        shared_dir(Cluster)


def test_release_deletes_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    spark.range(3).write.parquet(session.fresh_path(spark, "x"))
    assert any(tmp_path.iterdir())
    session.release(spark)
    assert not any(tmp_path.iterdir())
