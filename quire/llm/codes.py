"""Vectors compressed to codes of a product quantiser, in exact whole numbers.

A vector is cut into equal parts; each part position has a codebook, and a part is replaced by the number
of the nearest entry. Components are whole numbers, and so are all distances and sums: results do not
depend on the order of rows or on how they are dealt to tasks.

Distances come from matrix products. Numbers are broken into limbs, so small that every product and sum
of a float64 product stays below 2**53 and is exact; the dot products of the limbs are put together again
in int64. How many limbs there are follows from the largest component. Where int64 itself would not do
(components from ``limit`` on), the same sums are taken in Python's whole numbers.

A round is one pass over the stored vectors: each task sums its parts per entry before anything is
shuffled, and the sums, a fixed number of rows, make the next codebooks on the driver. Sums are shuffled
in limbs as well, so that they do not overflow.

Result for special cases: vectors that are null, empty or hold null or non-finite components take no part,
nor do those whose length is not that of the smallest ``vec_id`` kept (codebooks are of one length). A
length that parts do not divide is an error. Null ids come last. Repeated rows are rows; fewer than
``ENTRIES`` rows make smaller codebooks, and an empty table gives no rows. An error beyond a long is null,
and so is a sum that has one. Other columns are not carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import stored, tidied
from quire.session import ship_with_tasks

#: Parts of a vector, entries of a codebook, rounds of fitting, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to a codebook are held at a time.
ROWS = 4096
#: Bits of a limb of the sums that are shuffled.
SHUFFLED = 30


def kept(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding, label)`` of the rows that take part."""
    good = F.forall("embedding", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return vectors.select("vec_id", "embedding", "label").filter(good & (F.size("embedding") > 0))


def limit(width: int) -> int:
    """Components below this: the squared distance of two vectors of ``width`` components fits into int64."""
    return 1 << (61 - width.bit_length()) // 2


def whole(values: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``: int64 below the limit, else Python's whole numbers.

    Scaling by a power of two and rounding down are exact in float64.
    """
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(values) == 0 or np.abs(scaled).max() < limit(values.shape[1]):
        return scaled.astype(np.int64)
    exact = [int(y) if np.isfinite(y) else int(x) * SCALE for x, y in zip(values.ravel().tolist(), scaled.ravel().tolist(), strict=True)]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


def limbs(numbers: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 arrays of which ``sum(limb[k] << k * bits)`` is ``numbers``; the last one has the sign."""
    out, rest = [], numbers
    while True:
        if rest.size == 0 or np.abs(rest).max() < 1 << bits:
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact ``left @ right.T`` in int64, by float64 products of limbs."""
    bits = (53 - int(left.shape[1]).bit_length()) // 2
    out = np.zeros((len(left), len(right)), np.int64)
    others = limbs(right, bits)
    for i, a in enumerate(limbs(left, bits)):
        for j, b in enumerate(others):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and the squared distance."""
    code, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), object if object in (parts.dtype, entries.dtype) else np.int64)
    square = (entries**2).sum(axis=1)
    for first in range(0, len(parts), ROWS):
        x = parts[first : first + ROWS]
        if far.dtype == object:
            for k, row in enumerate(x.astype(object)):
                d = ((entries.astype(object) - row) ** 2).sum(axis=1)
                code[first + k] = best = min(range(len(d)), key=d.__getitem__)
                far[first + k] = d[best]
            continue
        d = (entries**2).sum(axis=1) - 2 * products(x, entries)
        best = d.argmin(axis=1)
        code[first : first + ROWS] = best
        far[first : first + ROWS] = d[np.arange(len(x)), best] + (x**2).sum(axis=1)
    return code, far


def blocks(batch: pa.RecordBatch, width: int):
    """Places and whole components of the vectors of a batch that have ``width`` components.

    Vectors with components too large for int64 come apart from the others."""
    column = batch.column("embedding")
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == width)
    vectors = values[column.offsets.to_numpy()[right][:, None] + np.arange(width)]
    large = (np.abs(vectors.astype(np.float64)) >= limit(width) / SCALE - 1).any(axis=1)
    for some in (~large, large):
        if some.any():
            yield right[some], whole(vectors[some])


def _sums(books: list[np.ndarray], width: int, count: int, schema: pa.Schema):
    """Per part position and entry: rows, and the sum of their components, ``count`` limbs for each."""
    step = width // len(books)

    def run(batches):
        rows = np.zeros((len(books), len(books[0])), np.int64)
        total = np.zeros((len(books), len(books[0]), step), object)
        for batch in batches:
            for _, vectors in blocks(batch, width):
                for p, book in enumerate(books):
                    part = vectors[:, p * step : (p + 1) * step]
                    code = nearest(part, book)[0]
                    order = np.argsort(code, kind="stable")
                    used, first = np.unique(code[order], return_index=True)
                    total[p, used] += np.add.reduceat(part[order], first, axis=0).astype(object)
                    rows[p] += np.bincount(code, minlength=len(book))
        p, e = np.nonzero(rows)
        if len(p):
            mask = (1 << SHUFFLED) - 1
            lists = [[(x >> (SHUFFLED * k)) & mask if k < count - 1 else x >> (SHUFFLED * k) for x in total[i, j] for k in range(count)] for i, j in zip(p, e, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(rows[p, e]), pa.array(lists, schema.field(3).type)], schema=schema)

    return run


def fitted(rows: DataFrame, first: np.ndarray, parts: int, rounds: int) -> list[np.ndarray]:
    """Codebooks after ``rounds`` rounds, which start as the parts of ``first``."""
    width = first.shape[1]
    step = width // parts
    books = [first[:, p * step : (p + 1) * step] for p in range(parts)]
    largest = rows.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x))))).first()[0] or 0
    # A sum of 2**40 numbers, with its sign.
    count = ((int(largest + 1) * SCALE).bit_length() + 41) // SHUFFLED + 1
    out = "part int, entry int, rows long, sums array<long>"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], out).schema)
    for _ in range(rounds):
        summed = rows.select("embedding").mapInArrow(tidied(_sums(books, width, count, schema)), out)
        at = [F.sum(F.element_at("sums", k + 1)).alias(f"s{k}") for k in range(step * count)]
        new = [book.copy() for book in books]
        for part, entry, n, *limb in summed.groupBy("part", "entry").agg(F.sum("rows"), *at).collect():
            sums = [sum(limb[k * count + j] << (SHUFFLED * j) for j in range(count)) for k in range(step)]
            means = [s // n for s in sums]
            if max(map(abs, means)) >= limit(width):
                new[part] = new[part].astype(object)
            new[part][entry] = means
        books = new
    return books


def _codes(books: list[np.ndarray], width: int, schema: pa.Schema):
    step = width // len(books)

    def run(batches):
        for batch in batches:
            for places, vectors in blocks(batch, width):
                found = [nearest(vectors[:, p * step : (p + 1) * step], book) for p, book in enumerate(books)]
                codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
                errors = sum(far for _, far in found)
                if errors.dtype == object:
                    errors = [int(e) if e < 1 << 63 else None for e in errors]
                some = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.int64())], schema=schema)

    return run


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error)`` of all rows that take part, and the codebooks.

    ``code`` has a byte per part, so ``entries`` is 256 at most; ``error`` is the squared distance.
    """
    rows = stored(kept(vectors), "vectors")
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    vec, label = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    out = f"vec_id {vec}, label {label}, code binary, error long"
    if not seeds:
        return rows.sparkSession.createDataFrame([], out), [np.zeros((0, 0), np.int64)] * parts
    width = len(seeds[0][0])
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    # As many rows of the right length as there are entries: those of another length take no part.
    if any(len(s[0]) != width for s in seeds):
        rows = rows.filter(F.size("embedding") == width)
        seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    books = fitted(rows, whole(np.array([s[0] for s in seeds], np.float64)), parts, rounds)
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], out).schema)
    return rows.mapInArrow(tidied(_codes(books, width, schema)), out), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the sum of errors over equal labels, nulls together.

    Summed before it is shuffled; the sums are one row per label and joined back, broadcast if they are small.
    """
    codes = stored(codes, "codes")
    whole_sum = F.when(F.count("error") == F.count("*"), F.try_sum("error"))
    sums = stored(codes.groupBy("label").agg(whole_sum.alias("label_error")), "label-errors")
    joined = codes.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return joined.select("c.*", "s.label_error")


def digest(books: list[np.ndarray]) -> str:
    """Digest of all components of the codebooks in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``codes`` with ``embedding``, the vector that each code stands for, back in its own scale."""
    codes = codes.drop("embedding")
    names, tables = codes.columns, [book.astype(np.float64) / SCALE for book in books]
    out = T.StructType([*codes.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    schema = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            number = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(tables))
            found = np.concatenate([t[number[:, p]] for p, t in enumerate(tables)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists.cast(schema.field("embedding").type)], schema=schema)

    return codes.mapInArrow(tidied(run), out)


ship_with_tasks(__name__)
