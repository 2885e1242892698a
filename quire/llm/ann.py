"""Approximate nearest neighbours in balanced posting lists.

Centroids come from a bounded sample. Every vector is posted to its nearest centroid and, near a border,
to others that are not much farther. Centroids are
searched by a graph held in memory: from a few entry points, the best nodes of a beam are expanded by
their neighbours. A query takes the lists whose centroid is not farther than a ratio of its nearest one's,
and as many more as hold enough vectors of the sample; one that finds too few then is searched exactly.
Lists are cut into blocks of at most ``PER_BLOCK`` vectors, queries of a list likewise, and blocks meet in
an equi-join on the list, so a list of any size is many small pieces of work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import stored
from quire.session import ship_with_tasks

#: Vectors that centroids are fitted on, at most; those whose id has the smallest hash.
SAMPLE = 16_384
#: Vectors per list that are aimed at; there are at most ``SAMPLE / 8`` lists.
PER_LIST = 200
#: Lists that hold a vector, at most, and how much farther than the nearest they may be.
REPLICAS, BORDER = 6, 1.2
#: Lists that a query searches, at most (and a sixth of all lists, if that is more), and how much farther
#: than the nearest they may be.
PROBES, RATIO = 24, 1.35
PER_BLOCK = 1024
DEGREE, BEAM = 24, 16


def clean(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` in double precision, without vectors that are null, zero or hold null, NaN or infinity."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(good)


def sampled(vectors: DataFrame, ids: int) -> np.ndarray:
    """Vectors of the ids with the smallest hashes, at most ``SAMPLE``; ``ids`` is about how many ids there are.

    Only ids below a hash that leaves half as many again are sorted, and repeated rows meet in one before that,
    so tasks hand on as much for a table of any size, and the sample alone goes to the driver. There,
    repeats take what room is left.
    """
    share = 1.5 * SAMPLE / max(ids, 1)
    if share < 1:
        vectors = vectors.filter(F.xxhash64("vec_id") < int((share - 0.5) * 2**64))
    first = vectors.groupBy("vec_id", "v").count().orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v", "count").toArrow()
    distinct, repeats = vectors_in(first["v"].combine_chunks()), np.cumsum(first["count"].to_numpy() - 1)
    room = min(SAMPLE - len(distinct), int(repeats[-1]))
    return np.concatenate((distinct, distinct[np.searchsorted(repeats, np.arange(room), "right")]))


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means on the sample; a centre that loses its vectors takes the ones farthest from theirs."""
    chance = np.random.default_rng(11)
    distinct = np.unique(sample, axis=0)
    lists = min(lists, len(distinct))
    centres = distinct[chance.choice(len(distinct), lists, replace=False)]
    for _ in range(rounds):
        square = (centres**2).sum(axis=1)
        near = np.concatenate([(square - 2 * part @ centres.T).argmin(axis=1) for part in np.array_split(sample, len(sample) // 2048 + 1)])
        count = np.bincount(near, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        lost = np.flatnonzero(count == 0)
        if len(lost):
            far = np.argsort(-((sample - centres[near]) ** 2).sum(axis=1))[: len(lost)]
            centres[lost[: len(far)]] = sample[far]
    return centres


def graph_of(centres: np.ndarray) -> dict:
    """Each centroid's nearest ones and a few far ones, which keep the graph in one piece."""
    n = len(centres)
    square = (centres**2).sum(axis=1)
    near = np.empty((n, min(DEGREE, n)), np.int32)
    for part in np.array_split(np.arange(n), n // 1024 + 1):
        d = square - 2 * centres[part] @ centres.T
        near[part] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
    ring = np.stack([(np.arange(n) + s) % n for s in (1, n // 2, n // 3)], axis=1).astype(np.int32)
    return {"centres": centres, "near": np.concatenate((near, ring), axis=1), "entries": np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))}


def searched(graph: dict, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` nearest centroids found for each row of ``x``, nearest first, and their distances."""
    centres, near = graph["centres"], graph["near"]
    n, rows = len(centres), len(x)
    beam = min(2 * want + BEAM, n)

    def distance(nodes):
        return ((centres[nodes] - x[:, None, :]) ** 2).sum(axis=2)

    nodes = np.broadcast_to(graph["entries"], (rows, len(graph["entries"]))).copy()
    known, opened = np.zeros((rows, n), bool), np.zeros((rows, n), bool)
    line = np.arange(rows)[:, None]
    known[line, nodes] = True
    far = distance(nodes)
    while True:
        waiting = np.where(opened[line, nodes], np.inf, far)
        step = np.argsort(waiting, axis=1)[:, : min(3, nodes.shape[1])]
        ready = np.isfinite(np.take_along_axis(waiting, step, axis=1))
        if not ready.any():
            break
        chosen = np.take_along_axis(nodes, step, axis=1)
        opened[line, chosen] = True  # those that are not ready are opened already
        fresh = near[chosen].reshape(rows, -1)
        order = np.argsort(fresh, axis=1, kind="stable")
        fresh = np.take_along_axis(fresh, order, axis=1)
        new = ~known[line, fresh]
        new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        d = np.where(new, distance(fresh), np.inf)
        row, place = np.nonzero(new)
        known[row, fresh[row, place]] = True
        nodes, far = np.concatenate((nodes, fresh), axis=1), np.concatenate((far, d), axis=1)
        best = np.argsort(far, axis=1, kind="stable")[:, :beam]
        nodes, far = np.take_along_axis(nodes, best, axis=1), np.take_along_axis(far, best, axis=1)
    found = min(want, nodes.shape[1])
    return nodes[:, :found], np.sqrt(far[:, :found])


def held(centres: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """For each centroid, how many of the sample are nearest to it: at least so many are posted to it."""
    square = (centres**2).sum(axis=1)
    near = [(square - 2 * part @ centres.T).argmin(axis=1) for part in np.array_split(sample, len(sample) // 2048 + 1)]
    return np.bincount(np.concatenate(near), minlength=len(centres))


def probed(graph: dict, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and list of each probe: lists by ratio, and along the ranked lists until they hold more than ``k`` vectors."""
    centres, counts = graph["centres"], graph["held"]
    lists, far = searched(graph, x, max(PROBES, len(centres) // 6))

    def near(lists, far):
        before = np.cumsum(counts[lists], axis=1) - counts[lists]
        return np.nonzero(np.isfinite(far) & ((far <= far[:, :1] * RATIO) | (before <= k)))

    row, place = near(lists, far)
    chosen = lists[row, place]
    short = np.flatnonzero(np.where(np.isfinite(far), counts[lists], 0).sum(axis=1) <= k)
    if len(short):  # these rank all lists
        own = np.sqrt(np.stack([((centres - v) ** 2).sum(axis=1) for v in x[short]]))
        ranked = np.argsort(own, axis=1, kind="stable")
        more, place = near(ranked, np.take_along_axis(own, ranked, axis=1))
        rest = ~np.isin(row, short)
        row, chosen = np.concatenate((row[rest], short[more])), np.concatenate((chosen[rest], ranked[more, place]))
    return row, chosen


def vectors_in(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _assign(shared, k: int | None = None):
    """Posts vectors or, with ``k``, queries to lists."""

    def run(batches):
        graph = shared.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                x = vectors_in(part.column("v"))
                if k is None:
                    lists, far = searched(graph, x, REPLICAS)
                    keep = np.isfinite(far) & ((far <= far[:, :1] * BORDER) | (np.arange(far.shape[1]) == 0))
                    row, place = np.nonzero(keep)
                    chosen = lists[row, place]
                else:
                    row, chosen = probed(graph, x, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chosen.astype(np.int32)), part.column("vec_id").take(pa.array(row)), part.column("v").take(pa.array(row))],
                    names=["list", "vec_id", "v"],
                )

    return run


def _pack(batches):
    """Rows sorted by list to blocks: ids and vectors of one list in two binaries."""
    kept: list = []

    def block(rows):
        ids, vectors = zip(*[(r[1], r[2]) for r in rows], strict=True)
        return rows[0][0], np.array(ids, np.int64).tobytes(), np.array(vectors, np.float64).tobytes()

    def out(blocks):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["list", "ids", "vectors"])

    for batch in batches:
        lists, ids, vectors = batch.column("list").to_pylist(), batch.column("vec_id").to_pylist(), vectors_in(batch.column("v"))
        for row in zip(lists, ids, vectors, strict=True):
            if kept and (kept[0][0] != row[0] or len(kept) == PER_BLOCK):
                yield out([block(kept)])
                kept = []
            kept.append(row)
    if kept:
        yield out([block(kept)])


def blocks(assigned: DataFrame, salt: int) -> DataFrame:
    """``assigned(list, vec_id, v)`` as blocks. Lists are dealt with a salt, so a hot one has many tasks."""
    dealt = assigned.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salt)))
    partitions = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(partitions, "list", "salt").sortWithinPartitions("list", "vec_id").drop("salt").mapInArrow(_pack, "list int, ids binary, vectors binary")


def nearest_in(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` nearest rows of a block to each query: exact distances, ties to the smaller id."""
    rough = (vectors**2).sum(axis=1) - 2 * queries @ vectors.T + (queries**2).sum(axis=1)[:, None]
    own = query_ids[:, None] == ids
    rough[own] = np.inf
    # Repeated ids count once: as many more rows are taken as there are repeats in the block.
    last = min(k + len(ids) - len(np.unique(ids)), len(ids)) - 1
    kth = np.partition(rough, last, axis=1)[:, last]
    scale = np.abs(vectors).max() ** 2 * vectors.shape[1] + np.abs(queries).max() ** 2 * vectors.shape[1]
    row, column = np.nonzero((rough <= kth[:, None] + scale * 1e-11) & ~own)
    exact = np.sqrt(((queries[row] - vectors[column]) ** 2).sum(axis=1))
    order = np.lexsort((ids[column], exact, row))
    row, column, exact = row[order], column[order], exact[order]
    same = np.concatenate(([False], (row[1:] == row[:-1]) & (ids[column][1:] == ids[column][:-1]))) if len(row) else np.zeros(0, bool)
    row, column, exact = row[~same], column[~same], exact[~same]
    first = np.searchsorted(row, row)
    best = np.arange(len(row)) - first < k
    return query_ids[row[best]], ids[column[best]], exact[best]


def _meet(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                query_ids, ids = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                queries = np.frombuffer(r["queries"], np.float64).reshape(len(query_ids), -1)
                vectors = np.frombuffer(r["vectors"], np.float64).reshape(len(ids), -1)
                found = nearest_in(queries, query_ids, vectors, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return run


def best_of(met: DataFrame, k: int) -> DataFrame:
    """``met(query_id, vec_id, score)`` as the ``k`` nearest ids of each query."""
    one = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return one.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched_exactly(usable: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of all vectors: vectors are dealt to parts, and every part sees all queries.

    The planner takes the queries for as few bytes as before they were given to all parts, and would broadcast them.
    """
    parts = int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = usable.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int").alias("list"), "vec_id", "v")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("list"), "vec_id", "v")
    wanted = blocks(every, 1).select("list", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    return best_of(blocks(dealt, 1).join(wanted.hint("merge"), "list").mapInArrow(_meet(k), "query_id long, vec_id long, score double"), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest of ``vectors(vec_id, embedding)`` to each of ``queries(vec_id, embedding)``.

    ``(query_id, rank, vec_id, score)``, score the Euclidean distance in double precision, ties to the
    smaller id; fewer rows only if there are fewer ids; a query never finds its own id, and each id at most once (its nearest row). Vectors
    that are null, zero or not finite take no part, nor do those of another length than most have
    (ties: the shorter). A query id with several vectors has the smallest. Without any vector there is
    no row.
    """
    spark = vectors.sparkSession
    counts = F.count("*").alias("count"), F.approx_count_distinct("vec_id")
    sizes = clean(vectors).groupBy(F.size("v").alias("n")).agg(*counts).orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, rows, ids = sizes[0]
    usable = clean(vectors).filter(F.size("v") == width)
    asked = clean(queries).filter(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = sampled(usable, ids)
    lists = int(max(1, min(rows // PER_LIST, len(sample) // 8)))
    centres = centroids_of(sample, lists)
    graph = spark.sparkContext.broadcast(graph_of(centres) | {"held": held(centres, sample)})
    kind = "list int, vec_id long, v array<double>"
    salt = max(1, int(rows * REPLICAS // max(lists, 1) // (PER_BLOCK * 8)))
    posted = blocks(usable.mapInArrow(_assign(graph), kind), salt)
    wanted = blocks(asked.mapInArrow(_assign(graph, k), kind), salt).select("list", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    met = posted.join(wanted.hint("merge"), "list").mapInArrow(_meet(k), "query_id long, vec_id long, score double")
    found = stored(best_of(met, k), "nearest")
    enough = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stored(asked.join(enough, "vec_id", "left_anti"), "nearest-short")
    if short.isEmpty():
        return found
    rest = searched_exactly(usable, short, k)
    return found.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(rest)



ship_with_tasks(__name__)
