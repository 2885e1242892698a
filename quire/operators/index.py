"""Inverted index over chunks.

A chunk's postings are made inside its row, so building needs no shuffle. ``operators.blocks`` stores an
index and searches it; what is here is the plain table of postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import let
from quire.functions.tokens import index_tokens, term_counts


@dataclass
class Index:
    """``postings(chunk_id, book_id, token, tf, dl)``, ``frequency(token, df)`` and one row of
    ``stats(n_docs, avgdl)``."""

    postings: DataFrame
    frequency: DataFrame
    stats: DataFrame


def build_index(chunks: DataFrame, terms: list[str] = P.SUBJECT_TERMS) -> Index:
    tokens = index_tokens(F.col("content"), terms)
    entry = let(
        tokens, lambda t: F.struct(F.size(t).cast("bigint").alias("dl"), term_counts(t).alias("terms"))
    )
    entries = chunks.select("chunk_id", "book_id", entry.alias("e"))
    postings = entries.select("chunk_id", "book_id", F.col("e.dl").alias("dl"), F.explode("e.terms").alias("t")).select(
        "chunk_id", "book_id", "t.token", F.col("t.tf").cast("bigint").alias("tf"), "dl"
    )
    stats = chunks.select(F.size(tokens).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    frequency = postings.groupBy("token").agg(F.count("*").alias("df"))
    return Index(postings, frequency, stats)
