import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import codes
from quire.llm.queries import op13_vector_codes


def plain(rows, parts, entries, rounds):
    """Rows ``(vec_id, vector, label)`` by the definition, in Python's whole numbers alone."""

    def number(x):
        a, b = float(x).as_integer_ratio()
        return a * 1024 // b

    taken = [(i, [number(x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    taken.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = len(taken[0][1]) // parts
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for _, v, _ in taken]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    small = max(abs(x) for _, v, _ in taken for x in v) < 1 << 20

    def assigned(c, book):
        d = ((np.array(book, np.int64 if small else object) - np.array(c, np.int64 if small else object)) ** 2).sum(axis=1).tolist()
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(assigned(c[p], books[p])[0], []).append(c[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e], strict=True)] if e in members else old for e, old in enumerate(books[p])]
    out = []
    for (i, _, label), c in zip(taken, cut, strict=True):
        found = [assigned(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def compared(spark, rows, kind="float", parts=4, entries=256, rounds=4):
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").coalesce(2)
    found, books = codes.compressed(vectors.withColumn("code", F.lit("x")), parts, entries, rounds)
    expected, digest = plain([(r.vec_id, r.embedding, r.label) for r in vectors.collect()], parts, entries, rounds)
    got = codes.with_label_errors(found).select("vec_id", F.lower(F.hex("code")), "error", "label", "label_error").collect()
    total = {}
    for _, _, e, label in expected:
        total[label] = total.get(label, 0) + e

    def fits(x):
        return x if x is not None and x < 1 << 63 else None

    lost = {label for _, _, e, label in expected if fits(e) is None}
    assert sorted(map(tuple, got), key=repr) == sorted(((i, c, fits(e), label, None if label in lost else fits(total[label])) for i, c, e, label in expected), key=repr)
    assert codes.digest(books) == digest
    return found, books


def made(seed, count, width=16, scale=1.0):
    chance = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in chance.normal(0, scale, width)], int(chance.integers(3)) if i % 7 else None) for i in chance.permutation(count)]


def test_as_by_definition_with_special_rows(spark):
    rows = made(1, 400)
    rows += [(5, None, 1), (6, [], 1), (7, [1.0, None] * 8, 1), (8, [float("nan")] * 16, 2), (9, [float("-inf")] * 16, 2)]
    rows += [rows[0], rows[1], rows[1], (None, rows[2][1], 1), (3, [0.0] * 16, None)] + [(1000 + k, rows[5][1], 2) for k in range(200)]
    compared(spark, rows)
    compared(spark, rows, "double", parts=2, entries=16, rounds=2)


def test_few_rows_and_none(spark):
    compared(spark, made(2, 5))
    found, books = codes.compressed(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert codes.with_label_errors(found).count() == 0 and [len(b) for b in books] == [0] * 4


def test_numbers_of_several_limbs_and_beyond_int64(spark):
    compared(spark, made(4, 60, scale=30_000.0), entries=8, rounds=2)
    rows = made(5, 40, scale=1e5) + [(1000 + k, [1e30 * (-1) ** k] * 16, k) for k in range(4)]
    compared(spark, rows, entries=8, rounds=2)
    compared(spark, [*rows, (2000, [1.7e308] * 16, 3)], "double", entries=4)


def test_limbs_give_exact_products():
    chance = np.random.default_rng(6)
    for width in (1, 16, 300):
        large = codes.limit(width) - 1
        a, b = chance.integers(-large, large, (50, width)), chance.integers(-large, large, (40, width))
        a[0], b[0] = large, -large
        assert len(codes.limbs(a, 12)) > 1
        assert (codes.products(a, b).astype(object) == a.astype(object) @ b.astype(object).T).all()
        code, far = codes.nearest(a, b)
        d = ((a.astype(object)[:, None] - b.astype(object)[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_other_lengths_take_no_part_and_uneven_parts_are_an_error(spark):
    rows = made(7, 30, width=8)
    longer = [(0, [1.0] * 12, 1), (100, [], 1), (101, [1.0] * 9, 1)]
    frame = spark.createDataFrame(rows[1:] + longer[1:], "vec_id long, embedding array<float>, label int")
    assert codes.compressed(frame)[0].count() == 29
    with pytest.raises(ValueError):
        codes.compressed(spark.createDataFrame([(1, [1.0] * 6, 1)], frame.schema))


def test_decoded_vectors_are_near(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    found, books = codes.compressed(vectors)
    back = codes.decoded(found, books).join(vectors.select("vec_id", F.col("embedding").alias("v")), "vec_id")
    far = F.aggregate(F.zip_with("embedding", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    for r in back.select("error", far.alias("far")).collect():
        # The error counts whole 1024ths, so each component is off by less than one of them.
        assert abs(math.sqrt(r.far) - math.sqrt(r.error) / 1024) < math.sqrt(64) / 1024


def test_query_against_the_definition(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    expected, digest = plain(rows, 4, 256, 4)
    total = {}
    for _, _, e, label in expected:
        total[label] = total.get(label, 0) + e
    got = op13_vector_codes(spark, small).collect()
    assert sorted(map(tuple, got)) == sorted((i, c, e, total[label], digest) for i, c, e, label in expected)
