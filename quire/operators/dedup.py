"""Exact and near duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import simhash as H
from quire.functions.tokens import index_tokens, term_counts
from quire.operators.ranking import global_row_number
from quire.session import checkpointed, ship_with_tasks


def exact_duplicates(files: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """``files(file_id, content)``: hash of each file and the first file with the same bytes.

    The first copy is found by an aggregate that combines before the shuffle, so a hash shared by a
    third of all files is no hot group. Files whose hash is in ``library(file_hash)`` are left out.
    """
    hashed = files.select("file_id", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"))
    if library is not None:
        hashed = hashed.join(library.select("file_hash").distinct(), "file_hash", "left_anti")
    first = hashed.groupBy("file_hash").agg(F.min("file_id").alias("original"))
    return hashed.join(first, "file_hash").select(
        "file_id", "file_hash", F.when(F.col("original") != F.col("file_id"), F.col("original")).alias("duplicate_of")
    )


def fingerprints(texts: DataFrame) -> DataFrame:
    """``texts(doc_id, text)`` to ``(doc_id, fingerprint)`` from tokens of two characters or more.

    Bit counts are packed in pairs and combined before the shuffle: one row of 32 numbers per
    document leaves a task. A text without tokens has fingerprint 0.
    """
    counted = texts.select("doc_id", F.explode_outer(term_counts(index_tokens(F.col("text"), [], keep_bare=False))).alias("t"))
    low, high = H.token_halves(F.col("token"))
    weighted = counted.select(
        "doc_id",
        F.col("t.token").alias("token"),
        F.when(F.length("t.token") >= 2, F.col("t.tf").cast("bigint")).otherwise(0).alias("w"),
    ).select("doc_id", "w", low.alias("low"), high.alias("high"))
    lanes = weighted.groupBy("doc_id").agg(
        F.sum("w").alias("votes"),
        *[H.lane_sum(F.col("low"), F.col("high"), F.col("w"), b).alias(f"b{b}") for b in range(32)],
    )
    return lanes.select("doc_id", H.fingerprint([F.col(f"b{b}") for b in range(32)], F.col("votes")).alias("fingerprint"))


#: Members by leaders that are compared at a time: what fits into the cache of a core.
MEMBERS, LEADERS = 1024, 64


def _smallest_matches(max_distance: int):
    """For a pair of blocks of fingerprints, each in the order of its ids: the smallest earlier leader of each
    member within the distance. A member that has one leaves, as later leaders have larger ids."""

    def search(pair: pd.DataFrame) -> pd.DataFrame:
        block = dict(zip(pair["block"], zip(pair["ids"], pair["prints"])))
        leader, leader_print = (np.asarray(x, np.int64) for x in block[min(block)])
        member, member_print = (np.asarray(x, np.int64) for x in block[max(block)])
        xor, bits = np.empty((MEMBERS, LEADERS), np.int64), np.empty((MEMBERS, LEADERS), np.uint8)
        match = np.full(len(member), -1)
        active = np.arange(len(member))
        for low in range(0, len(leader), LEADERS):
            some, ids = leader_print[low : low + LEADERS], leader[low : low + LEADERS]
            for at in range(0, len(active), MEMBERS):
                who = active[at : at + MEMBERS]
                shape = np.s_[: len(who), : len(some)]
                np.bitwise_xor(member_print[who][:, None], some[None, :], out=xor[shape])
                # Of signed numbers numpy counts the bits of the absolute value.
                np.bitwise_count(xor[shape].view(np.uint64), out=bits[shape])
                if bits[shape].min() > max_distance:
                    continue
                close = (bits[shape] <= max_distance) & (ids[None, :] < member[who][:, None])
                hit = close.any(axis=1)
                match[who[hit]] = low + close[hit].argmax(axis=1)
            active = active[match[active] < 0]
        found = match >= 0
        return pd.DataFrame({"first_id": member[found], "match": leader[match[found]]})

    return search


def near_duplicates_of(texts: DataFrame, max_distance: int = 10) -> DataFrame:
    """``texts(doc_id, text)`` with blank texts left out: near duplicates by the fingerprints of the others."""
    return near_duplicates(fingerprints(texts.filter(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))), max_distance)


def near_duplicates(prints: DataFrame, max_distance: int = 10, group_limit: int = 32768) -> DataFrame:
    """``(doc_id, duplicate_of)``: the smallest earlier document within ``max_distance`` bits.

    Equal fingerprints are collapsed first, so a group of exact copies, however large, is one row. At ten of
    64 bits the keys that a pair within the distance must share (pigeonhole) are so short that most unlike
    pairs share one, too; so the distinct fingerprints, in the order of their ids, are cut into blocks of at
    most ``group_limit``, and each pair of blocks is compared as two arrays of numbers. No task holds
    more than two blocks of a pair at once, and no match is missed. The number of comparisons is half the
    square of the number of distinct fingerprints.
    """
    spark = prints.sparkSession
    prints = checkpointed(prints)
    one = checkpointed(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    n = one.count()
    # A small table has blocks enough for all cores.
    size = max(1, min(group_limit, -(-n // 16)))
    last = max(0, (n - 1) // size)
    numbered = global_row_number(one, ["first_id"], "rank").withColumn("block", F.floor((F.col("rank") - 1) / size).cast("int"))
    members = F.sort_array(F.collect_list(F.struct("first_id", "fingerprint")))
    packed = numbered.groupBy("block").agg(members.alias("m"))
    packed = checkpointed(packed.select("block", F.col("m.first_id").alias("ids"), F.col("m.fingerprint").alias("prints")))
    # A block meets each block once, the one of smaller ids as leaders.
    sides = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(last))))
    sides = sides.withColumns({"early": F.least("block", "other"), "late": F.greatest("block", "other")}).drop("other")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min((last + 1) * (last + 2) // 2, 2000))
    pairs = sides.repartition(tasks, "early", "late").groupBy("early", "late")
    matched = pairs.applyInPandas(_smallest_matches(max_distance), "first_id bigint, match bigint")
    matched = checkpointed(matched.groupBy("first_id").agg(F.min("match").alias("match")))
    of_first = one.join(matched, "first_id", "left")
    return prints.join(of_first, "fingerprint").select(
        "doc_id",
        F.when(F.col("match").isNotNull(), F.col("match"))
        .when(F.col("doc_id") != F.col("first_id"), F.col("first_id"))
        .alias("duplicate_of"),
    )


ship_with_tasks(__name__)
