"""Mastery, plans, trees, reports, stores and streams."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import knowledge, mastery, planning, ranking, reports, tree
from quire.plans import ingest
from quire.session import fresh_path
from quire.sources import files, store
from quire.streaming import jobs

DAY = lambda n: dt.datetime(2024, 1, n, 12)


@pytest.fixture(scope="module")
def quiz(spark):
    quizzes = spark.createDataFrame(
        [(1, 1, 10, "choice", "A"), (2, 1, 10, "blank", "x y"), (3, 1, 11, "short", "z"), (4, 2, 12, "choice", "B")],
        "quiz_id bigint, book_id bigint, chapter_id bigint, q_type string, answer string",
    )
    attempts = spark.createDataFrame(
        [(1, 1, " a ", 0, DAY(1)), (2, 1, "b", 1, DAY(1)), (3, 2, "X Y", 1, DAY(2)), (4, 2, "no", 0, DAY(4)), (5, 4, "B", 1, DAY(5))],
        "attempt_id bigint, quiz_id bigint, user_answer string, is_correct bigint, answered_at timestamp",
    )
    chapters = spark.createDataFrame(
        [(10, 1, "a", 0), (11, 1, "b", 1), (12, 2, "c", 0), (13, 2, "d", 1)],
        "chapter_id bigint, book_id bigint, title string, order_index bigint",
    )
    return quizzes, attempts, chapters


def test_grading(quiz, rows):
    quizzes, attempts, _ = quiz
    assert rows(mastery.grade(attempts, quizzes), "attempt_id", "is_correct", "is_self_graded") == [
        (1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0), (5, 1, 0),
    ]


def test_latest_attempt_breaks_ties_by_id(quiz, rows):
    assert rows(mastery.latest_attempts(quiz[1]), "quiz_id", "is_correct") == [(1, 1), (2, 0), (4, 1)]


def test_running_rate(quiz, rows):
    assert rows(mastery.running_correct_rate(quiz[1]), "attempt_id", "correct_rate") == [
        (1, 0.0), (2, 0.5), (3, 1.0), (4, 0.5), (5, 1.0),
    ]


def test_mastery(quiz, rows):
    quizzes, attempts, chapters = quiz
    made = mastery.chapter_mastery(chapters, quizzes, attempts)
    assert rows(made, "chapter_id", "wrong_rate", "mastery") == [(10, 0.5, 0.5), (11, 0.0, 1.0), (12, 0.0, 1.0), (13, 0.0, 0.0)]
    books = quizzes.select("book_id").distinct().withColumn("title", F.lit("t"))
    row = mastery.overview(books, chapters, quizzes, attempts, F.to_date(F.lit("2024-01-05"))).first()
    assert tuple(row) == (2, 4, 5, 0.75, 2)
    weak = mastery.weakness_ranking(made, books, 2).collect()
    assert {r.chapter_id for r in weak} == {10, 11} and weak[0].suggest == mastery.KEEP_GOING


@pytest.mark.parametrize("day, streak", [(1, 1), (2, 2), (3, 0), (5, 2), (6, 0)])
def test_streak(quiz, day, streak):
    assert mastery.study_streak(quiz[1], F.to_date(F.lit(f"2024-01-0{day}"))).first()[0] == streak


def test_calendar(quiz):
    made = mastery.activity_calendar(quiz[1], F.to_date(F.lit("2024-01-06")), 4).orderBy("date").collect()
    assert [r.attempts for r in made] == [1, 0, 1, 1, 0]


def nodes_of(spark, pairs):
    return spark.createDataFrame(
        [(n, p, f"n{n}", None, "known" if n % 2 else "unknown", n) for n, p in pairs],
        "node_id bigint, parent_id bigint, title string, note string, mastery string, order_index bigint",
    )


def test_plan_covers_all_nodes_once(spark):
    nodes = nodes_of(spark, [(i, None) for i in range(11)])
    none = spark.createDataFrame([], "date date")
    day = lambda n: F.to_date(F.lit(f"2024-01-{n:02d}"))
    made = planning.study_plan(nodes, none, day(4), day(1)).orderBy("position").collect()
    assert sorted(r.node_id for r in made) == list(range(11))
    assert [r.date.day for r in made] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4] and made[0].mastery == "unknown"
    assert len({r.date for r in planning.study_plan(nodes, none, day(20), day(1)).collect()}) == 20
    assert planning.study_plan(nodes, none, day(1), day(2)).isEmpty()


def test_check_ins(spark, rows):
    df = spark.createDataFrame([(1, "d", "a", 1, 1), (1, "d", "b", 0, 2), (1, "e", "c", 1, 1)], "plan_id bigint, date string, content string, done bigint, seq bigint")
    assert rows(planning.upsert_check_ins(df)) == [(1, "d", "b", 0), (1, "e", "c", 1)]


def test_tree(spark, rows):
    nodes = nodes_of(spark, [(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5), (7, 99), (8, 9), (9, 8)])
    paths = {r.node_id: r.path for r in tree.tree_paths(nodes).collect()}
    assert paths[4] == [1, 2, 3, 4] and paths[7] == [7] and paths[8] is None and paths[9] is None
    roots = spark.createDataFrame([(2,), (5,)], "root_id bigint")
    assert rows(tree.subtree_closure(nodes, roots)) == [(2, 2), (2, 3), (2, 4), (5, 5), (5, 6)]
    assert [r[0] for r in rows(tree.delete_subtrees(nodes, roots), "node_id")] == [1, 7, 8, 9]
    moves = spark.createDataFrame([(2, 4), (4, 1), (3, 3), (3, None), (3, 77), (1, 6), (66, 1)], "node_id bigint, target_id bigint")
    assert [r.verdict for r in tree.validate_moves(nodes, moves).orderBy("node_id", "target_id").collect()] == [
        "ok", "into own subtree", "ok", "onto itself", "unknown target", "ok", "unknown node",
    ]
    assert [r[0] for r in rows(tree.filter_with_ancestors(nodes, "N4"), "node_id")] == [1, 2, 3, 4]
    added = spark.createDataFrame([(20, 1), (21, 1), (22, None), (23, 6)], "node_id bigint, parent_id bigint")
    assert rows(tree.append_order(nodes, added)) == [(20, 1, 3), (21, 1, 4), (22, None, 6), (23, 6, 0)]


def test_deep_tree(spark):
    nodes = nodes_of(spark, [(i, i - 1 if i else None) for i in range(40)])
    assert tree.tree_paths(nodes).agg(F.max("depth")).first()[0] == 39


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    made = ranking.global_row_number(df, ["k"], "rn").collect()
    assert all(r.rn == r.k + 1 for r in made)
    counts = {}
    for r in ranking.row_number_within(df, ["g"], ["k"], "rn").orderBy("g", "k").collect():
        counts[r.g] = counts.get(r.g, 0) + 1
        assert r.rn == counts[r.g]


def test_dialogue_blocks_do_not_matter(spark, rows):
    turns = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(30)], "conv_id bigint, turn bigint, role string, text string")
    context = spark.createDataFrame([(1, "x" * 9000)], "conv_id bigint, context string")
    made = reports.dialogue_context(turns, context, block=10).orderBy("turn").collect()
    assert [len(r.history) for r in made] == [min(t, 8) for t in range(30)]
    assert [h.text for h in made[20].history] == [f"t{t}" for t in range(12, 20)] and len(made[0].context) == 8000


def test_changed_chapters(spark, rows):
    chapters = spark.createDataFrame([(1,), (2,), (3,), (4,)], "chapter_id bigint")
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 2, "c"), (3, 3, "d")], "chapter_id bigint, chunk_index bigint, content string")
    text = lambda t: __import__("hashlib").md5(t.encode()).hexdigest()
    stored = spark.createDataFrame([(1, text("a\nb"), "s"), (2, text("old"), "s"), (9, "h", "s")], "chapter_id bigint, hash string, summary string")
    assert rows(reports.changed_chapters(chapters, chunks, stored), "chapter_id", "action") == [
        (1, "reuse"), (2, "redo"), (3, "redo"), (4, "empty"), (9, "gone"),
    ]


def test_json_trees(spark, rows):
    df = spark.createDataFrame([(1, '[{"title":"a","children":[{"title":" "},{"title":"b"}]}]'), (2, "no")], "tree_id bigint, json string")
    assert rows(knowledge.flatten_json_trees(df), "path", "title") == [("/0", "a"), ("/0/1", "b")]


def test_uploads(spark, rows):
    import io, zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    data = [("a.pdf", b"%PDF-1"), ("b.pdf", b"  %PDF-1"), ("c.pdf", b"x"), ("d.docx", out.getvalue()), ("e.pptx", b"PK\x03\x04x"), ("f.docx", b"x"), ("g.txt", b"x"), ("h.pdf", b"")]
    df = spark.createDataFrame([(p, c, len(c)) for p, c in data], "path string, content binary, length bigint")
    assert [v for _, v in rows(files.check_uploads(files.route_files(df)), "path", "verdict")] == [
        "ok", "ok", "no PDF signature", "ok", "broken archive", "no ZIP signature", "unsupported type", "empty",
    ]


def test_scan_files(spark, rows, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-")
    (tmp_path / "sub" / "b.TXT").write_bytes(b"x")
    made = files.route_files(files.scan_files(spark, str(tmp_path)))
    assert rows(made, "file_type", "accepted") == [("pdf", True), ("txt", False)]


def test_scanned(spark, rows):
    books = spark.createDataFrame([(1,), (2,), (3,)], "book_id bigint")
    pages = spark.createDataFrame([(1, " "), (1, ""), (1, ""), *[(2, "x" * 200)] * 5], "book_id bigint, text string")
    assert rows(files.scanned_books(books, pages)) == [(1, True), (2, False), (3, True)]


def test_store_replaces_and_deletes(spark, rows):
    path = fresh_path(spark, "test-store")
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "book_id bigint, v string")
    store.create_store(df, path, 4)
    fresh = df.filter("book_id < 5").withColumn("v", F.lit("new"))
    for _ in range(2):
        store.replace_books(spark, path, fresh, fresh, 4)
    store.replace_books(spark, path, df.limit(0), df.filter("book_id >= 10"), 4)
    assert rows(store.read_store(spark, path)) == sorted([(i, "new" if i < 5 else f"v{i}") for i in range(10)], key=repr)
    store.replace_books(spark, path, df.limit(0), df, 4)
    assert store.read_store(spark, path).isEmpty()


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream over files that are read one per batch, in the order they were written."""
    import os

    def make(name, schema, batches):
        folder = tmp_path / name
        for i, rows in enumerate(batches):
            target = str(folder / f"part{i}")
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(target)
            for f in os.listdir(target):
                if f.endswith(".parquet"):
                    os.utime(os.path.join(target, f), (1000 + i, 1000 + i))
        return (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(str(folder))
        )

    return make


ATTEMPT = "attempt_id bigint, quiz_id bigint, is_correct bigint, answered_at timestamp"


def run(stream, sink, tmp_path, mode, conf=None, name="state"):
    jobs.start(stream, sink, str(tmp_path / name), mode, conf).awaitTermination()


def test_late_data(spark, rows, arriving, tmp_path):
    batches = [
        [(1, 1, 1, DAY(1)), (2, 1, 0, DAY(2))],
        [(3, 1, 1, DAY(10))],
        [(4, 1, 1, DAY(10))],
        [(5, 2, 1, DAY(9)), (6, 2, 1, DAY(1))],
    ]
    out = str(tmp_path / "out")
    run(jobs.daily_activity(arriving("a", ATTEMPT, batches)), jobs.update_log(out), tmp_path, "update")
    made = {r.date.day: r.attempts for r in jobs.newest_rows(spark, out, ["date"]).collect()}
    # The row for day 1 in the last batch is more than a day late.
    assert made == {1: 1, 2: 1, 9: 1, 10: 2}


def test_quiz_state(spark, rows, arriving, tmp_path):
    batches = [[(1, 1, 1, DAY(1))], [(2, 1, 0, DAY(2)), (3, 2, 1, DAY(1))]]
    out = str(tmp_path / "out")
    run(jobs.quiz_state(arriving("q", ATTEMPT, batches)), jobs.update_log(out), tmp_path, "update")
    assert rows(jobs.newest_rows(spark, out, ["quiz_id"]), "quiz_id", "is_correct", "correct_rate") == [(1, 0, 0.5), (2, 1, 1.0)]


def test_late_rows_are_counted(spark, rows, arriving, tmp_path):
    batches = [[(1, 1, 1, DAY(10))], [(2, 1, 0, DAY(10))], [(3, 1, 1, DAY(9)), (4, 1, 1, DAY(1)), (5, 2, 1, DAY(2))]]
    stream = arriving("l", ATTEMPT, batches)
    counted, every = str(tmp_path / "counted"), str(tmp_path / "every")
    run(jobs.daily_activity(stream), jobs.update_log(counted), tmp_path, "update")
    run(jobs.daily_arrivals(stream), jobs.update_log(every), tmp_path, "update", name="arrivals")
    made = {r.date.day: (r.attempts, r.late) for r in jobs.late_attempts(spark, counted, every).collect()}
    assert made == {1: (0, 1), 2: (0, 1), 9: (1, 0), 10: (2, 0)}


def test_import_deduplication(spark, rows, arriving, tmp_path):
    batches = [[(1, "x"), (2, "x")], [(3, "y"), (4, "x")], [(5, "y"), (6, None), (7, None)], [(9, "z"), (8, "z"), (10, "x")]]
    out = str(tmp_path / "out")
    arrived = arriving("i", "file_id bigint, file_hash string", batches)
    before = {name: spark.conf.get(name, None) for name in jobs.KEYED}
    run(jobs.import_deduplication(arrived), jobs.update_log(out), tmp_path, "append", jobs.KEYED)
    made = rows(spark.read.parquet(out), "file_id", "file_hash", "duplicate_of")
    assert made == sorted([(1, "x", None), (2, "x", 1), (3, "y", None), (4, "x", 1), (5, "y", 3), (6, None, None), (7, None, None), (8, "z", None), (9, "z", 8), (10, "x", 1)], key=repr)
    # Each batch wrote its own rows; the state, not what was written, knows the files before.
    assert spark.read.parquet(out).groupBy("batch").count().count() == 4
    assert all(spark.conf.get(name, None) == value for name, value in before.items())


def test_rolling_window(spark, rows, arriving, tmp_path):
    batches = [[(i,) for i in range(b * 40, b * 40 + 40)] for b in range(4)]
    out = str(tmp_path / "out")
    run(arriving("r", "id bigint", batches), jobs.rolling_window(out, [F.desc("id")]), tmp_path, "append")
    assert sorted(r.id for r in jobs.last_window(spark, out).collect()) == list(range(60, 160))


def test_stored_tables_stream_from_a_folder(spark, rows, small, tmp_path):
    """A table may be one file or a folder of files."""
    for name in ("documents", "events"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in ("streaming_import_dedup", "streaming_daily_activity"):
        of_file, of_folder = (rows(ingest.QUERIES[query](spark, d)) for d in (small, str(tmp_path)))
        assert of_file == of_folder and of_file


def test_office_rows_of_a_few_files_at_a_time():
    """A task gives the rows of a few files, then those of the next; unreadable files have none."""
    texts = ingest._docx(pd.Series([f"one\ntwo {i}" for i in range(200)]))
    batch = pd.DataFrame({"book_id": range(201), "file_type": "docx", "content": [*texts, b"no archive"]})
    frames = list(files._office_frames(iter([batch])))
    assert [len(f) for f in frames] == [128, 128, 128, 16]
    last = frames[-1].iloc[-1]
    assert (last.book_id, last.idx, last.text) == (199, 1, "two 199") and pd.isna(last.page)
