import numpy as np
from pyspark.sql import functions as F

from quire.llm import ann
from quire.llm.common import stored


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.0) for i, v in rows], "vec_id long, embedding array<float>, list string, score double")


def brute(rows, queries, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and i is not None and None not in v and np.isfinite(v).all() and any(v)]
    size = max({len(v) for _, v in good}, key=lambda n: sum(len(v) == n for _, v in good))
    good = [(i, v) for i, v in good if len(v) == size]
    result = {}
    for q in sorted(set(queries)):
        own = [v for i, v in good if i == q]
        if own:
            near = {}
            for i, v in good:
                if i != q:
                    d = float(np.sqrt(((v - own[0]) ** 2).sum()))
                    near[i] = min(d, near.get(i, d))
            result[q] = sorted((d, i) for i, d in near.items())[:k]
    return result


def test_small_tables_are_exact(spark):
    chance = np.random.default_rng(1)
    rows = [(k, chance.standard_normal(8).tolist()) for k in range(300)]
    rows += [(300 + k, [1.0] * 8) for k in range(30)] + [(200, [1.0] * 8)[:1] + ([2.0] * 8,)]  # a group of copies
    rows += [(401, None), (402, [0.0] * 8), (403, [float("nan")] + [1.0] * 7), (404, [1.0] * 7 + [None]), (405, [float("inf")] * 8), (406, [1.0] * 3), (None, [1.0] * 8), (7, rows[7][1])]
    data = table(spark, rows)
    found = {}
    for r in ann.nearest(data, data.filter("vec_id % 10 = 0"), 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    expected = brute([r for r in rows if r[0] != 200] + [(200, rows[200][1]), (200, [2.0] * 8)], [r[0] for r in rows if r[0] is not None and r[0] % 10 == 0 and r[0] != 200], 5)
    found.pop(200)
    assert {q: [(s, v) for _, s, v in sorted(x)] for q, x in found.items()} == expected
    assert all([r for r, _, _ in sorted(x)] == [1, 2, 3, 4, 5] for x in found.values())


def test_few_candidates_and_none(spark):
    data = table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(data, data.filter("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert ann.nearest(data.limit(0), data).count() == 0
    assert ann.nearest(table(spark, [(0, [1.0])]), data.limit(0)).count() == 0


def test_recall(spark):
    chance = np.random.default_rng(2)
    vectors = chance.standard_normal((4000, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    data = table(spark, rows)
    found = {(r.query_id, r.vec_id) for r in ann.nearest(data, data.filter("vec_id % 100 = 0"), 10).collect()}
    expected = {(q, i) for q, x in brute(rows, range(0, 4000, 100), 10).items() for _, i in x}
    assert len(found & expected) / len(expected) >= 0.9


def test_outliers_and_copies_find_k(spark):
    chance = np.random.default_rng(3)
    vectors = chance.standard_normal((2000, 16))
    vectors[100] *= 50
    vectors[201:203] = vectors[200] = vectors[200] * 10
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(300, [90.0] * 16)] * 400 + [(301, [-90.0] * 16)] * 3  # ids with lists of their own
    data = table(spark, rows)
    asked = table(spark, [r for r in rows if r[0] in (100, 200, 201, 202, 5)] + [rows[-1], rows[-4]])
    for k in (10, 700):
        found = {}
        for r in ann.nearest(data, asked, k).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
        assert set(found) == {5, 100, 200, 201, 202, 300, 301}
        for q, own in found.items():
            assert [r for r, _, _ in sorted(own)] == list(range(1, k + 1))
            assert len({i for _, _, i in own} - {q}) == k
        assert {i for _, s, i in found[200] if s == 0} == {201, 202}
    # No list near the copies of 300 holds another id: searched exactly.
    true = brute([(i, v) for i, v in rows if i != 300] + [(300, [90.0] * 16)], [300], 10)[300]
    got = sorted((r["rank"], r.score, r.vec_id) for r in ann.nearest(data, table(spark, [rows[-4]]), 10).collect())
    assert [(s, i) for _, s, i in got] == true


def test_only_the_sample_reaches_the_driver(spark, monkeypatch):
    """Forty parts of 500 vectors, half of them of one id, which comes first; the driver takes 2 MB of results and no more."""
    monkeypatch.setattr(ann, "SAMPLE", 500)
    own, hot = F.col("id") % 2 == 0, spark.range(0, 20_000, 2).orderBy(F.xxhash64("id")).first().id
    embedding = F.array(*[F.when(own, F.rand(k)).otherwise(0.5).cast("float") for k in range(64)])
    data = spark.range(0, 20_000, 1, 40).select(F.when(own, F.col("id")).otherwise(hot).alias("vec_id"), embedding.alias("embedding"))
    expected = sorted(tuple(r.v) for r in ann.clean(data).distinct().orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(500).collect())
    conf = spark.sparkContext._conf
    most = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "2m")
    try:
        sample = ann.sampled(ann.clean(data), 10_000)
        found = ann.nearest(data, data.filter("vec_id % 1000 = 0"), 10).collect()
    finally:
        conf.set("spark.driver.maxResultSize", most)
    assert sorted(map(tuple, sample)) == expected
    assert len(found) == 20 * 10 and len({(r.query_id, r.vec_id) for r in found}) == 200


def test_repeats_take_what_room_is_left(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 6)
    rows = spark.createDataFrame([(k, [float(k)]) for k in (1, 2, 2, 2, 2, 2, 3)], "vec_id long, v array<double>")
    assert sorted(ann.sampled(rows, 3).ravel()) == [1, 2, 2, 2, 2, 3]
    assert sorted(ann.sampled(rows.filter("vec_id <> 2"), 2).ravel()) == [1, 3]


def test_queries_are_not_broadcast_once_for_each_part(spark):
    vectors = stored(table(spark, [(k, [float(k), 1.0]) for k in range(40)]), "vectors")
    found = ann.searched_exactly(ann.clean(vectors), ann.clean(vectors.filter("vec_id % 20 = 0")), 2)
    assert [(r.query_id, r.vec_id) for r in found.orderBy("query_id", "rank").collect()] == [(0, 1), (0, 2), (20, 19), (20, 21)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
