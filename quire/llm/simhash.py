"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance ``radius`` or less have a number between them that is at most half the
radius (rounded up) from either. So each distinct fingerprint emits all its variants within that half
radius, and those that meet in a variant are compared. The number of variants of a fingerprint depends
on the radius alone (65 for radius 2), and so does the number of fingerprints that can meet in one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BLOCK, slices, stored, tidied, utf8, words_of
from quire.llm.components import components
from quire.session import ship_with_tasks

SEED = 42


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """Fingerprint of each text (unsigned): the majority of the bits of the hashes of its shingles."""
    texts = len(offsets) - 1
    result = np.zeros(texts, np.uint64)
    packed, starts, ends, first = words_of(data, offsets)
    whole = packed.tobytes().lower()  # of bytes: A-Z only
    words = np.diff(first)
    last = np.repeat(first[1:], words)
    place = np.arange(len(starts))
    # A shingle begins where enough words follow, or at the first word of a shorter text.
    begins = (place + shingle <= last) | (place == np.repeat(first[:-1], words))
    begin = place[begins]
    end = np.minimum(begin + shingle, last[begins]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[begin].tolist(), ends[end].tolist(), strict=True)], np.uint64)
    edges = np.searchsorted(begin, first)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for text in np.flatnonzero(np.diff(edges)).tolist():
        own = hashes[edges[text] : edges[text + 1]]
        bits = np.zeros(64, np.int64)
        for at in range(0, len(own), 4096):
            part = np.unpackbits(own[at : at + 4096].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            bits += part.sum(axis=0, dtype=np.int64)
        result[text] = weights[2 * bits > len(own)].sum(dtype=np.uint64)
    return result


def _fingerprint(names: list[str], text_col: str, shingle: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(text_col))
            parts = [fingerprints_of(data, offsets[a : b + 1], shingle) for a, b in slices(offsets, BLOCK)]
            values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values)], schema=schema)

    return run


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (signed 64 bits).

    A-Z count as lower case; words are what stands between ASCII white space; a text of fewer words
    than a shingle is one shingle, and one without words (or null) has fingerprint zero.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in docs.columns if c not in (text_col, "fingerprint")]
    out = T.StructType([*docs.select(names).schema.fields, T.StructField("fingerprint", T.LongType())])
    return docs.select(*names, text_col).mapInArrow(tidied(_fingerprint(names, text_col, shingle, to_arrow_schema(out))), out)


def variants(radius: int, bits: int = 64) -> list[int]:
    """Masks of at most ``radius`` bits, as signed numbers."""
    masks = [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``distinct(fingerprint)`` to links ``(a, b)`` of fingerprints at distance ``radius`` or less.

    For an even radius any two fingerprints of a variant are near enough, so each is linked to the
    smallest one there: what is connected stays connected, and a dense group costs no pairs. For an
    odd radius all pairs of a variant are compared. A variant is met by fingerprints of its own ball
    only, so its list is bounded by the number of variants.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in variants((radius + 1) // 2)])
    # Few bytes become many rows: they are spread first, by number and not by size. By the hash, as the
    # planner leaves out a repartition by the column that the input is grouped by.
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (
        distinct.select("fingerprint")
        .repartition(partitions, F.xxhash64("fingerprint"))
        .select("fingerprint", F.explode(masks).alias("mask"))
        .select(F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"), "fingerprint")
        .groupBy("variant")
        .agg(F.array_sort(F.collect_set("fingerprint")).alias("near"))
        .filter(F.size("near") > 1)
    )
    if radius % 2 == 0:
        pairs = met.select(F.col("near")[0].alias("b"), F.explode(F.slice("near", 2, (1 << 31) - 1)).alias("a"))
    else:
        pairs = met.select(F.posexplode("near").alias("at", "b"), "near").select(
            "b", F.explode(F.expr("slice(near, at + 2, size(near))")).alias("a")
        )
    return pairs.distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fingerprint, component_id)``, one row per row.

    Copies share a fingerprint and are never compared with each other. ``component_id`` is the
    smallest ``doc_id`` that links lead to; ids that are null don't count, and a component without
    any other has null. An empty table gives an empty one.
    """
    marked = stored(fingerprints(docs.select("doc_id", "text"), "text", shingle), "fingerprints")
    classes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fingerprint"), radius), "simhash")
    rooted = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(least, "root").select("fingerprint", "component_id")
    return marked.join(of_class, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest ``doc_id``.

    Of several rows with that id, the one whose row hash is smallest stays; rows without an id have
    no place in a group and all stay.
    """
    from pyspark.sql.window import Window

    groups = near_duplicates(docs, radius, shingle)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith("map")]))
    one = docs.join(kept, "doc_id", "left_semi").withColumn("__first", F.row_number().over(first))
    one = one.filter(F.col("__first") == 1).select(*docs.columns)
    return one.unionByName(docs.filter(F.col("doc_id").isNull()))


ship_with_tasks(__name__)
