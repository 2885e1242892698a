"""Concept graph over the analysis records of all books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import strip


def _valid(name: Column) -> Column:
    stop = F.lit(P.CONCEPT_STOP_WORDS)
    return (F.length(name) > 1) & ~name.rlike("^[0-9]+$") & ~F.array_contains(stop, name)


def concepts(analysis: DataFrame) -> DataFrame:
    """Distinct ``(book_id, name)`` from the keywords and theorem types of each book."""
    named = F.array_union("keywords", F.transform("theorems", lambda t: t["type"]))
    cleaned = F.array_distinct(F.filter(F.transform(named, strip), _valid))
    return analysis.select("book_id", F.explode(cleaned).alias("name")).distinct()


def nodes(found: DataFrame, limit: int = 200) -> DataFrame:
    """The ``limit`` concepts found in most books, with those books.

    The ranking runs on counts alone; book lists are collected for the ranked names only.
    """
    top = (
        found.groupBy("name").agg(F.count("*").alias("n_books")).orderBy(F.desc("n_books"), "name").limit(limit)
    )
    return found.join(top, "name").groupBy("name", "n_books").agg(F.sort_array(F.collect_list("book_id")).alias("books"))


def edges(analysis: DataFrame, top: DataFrame, undirected: bool = False) -> DataFrame:
    """Weights of keyword pairs of the same book, both ends in ``top``, in keyword order.

    The names are filtered before they are paired; a book has at most 30 keywords, and the pairs of
    one book are made inside its row.
    """
    kept = (
        analysis.select("book_id", F.posexplode("keywords").alias("at", "name"))
        .join(top.select("name"), "name", "left_semi")
        .groupBy("book_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda k: k["name"]).alias("names"))
    )
    pairs = F.flatten(
        F.transform(
            "names",
            lambda a, i: F.transform(
                F.slice(F.col("names"), i + 2, F.size("names")), lambda b: F.struct(a.alias("source"), b.alias("target"))
            ),
        )
    )
    made = kept.select(F.explode(pairs).alias("p")).select("p.source", "p.target")
    if undirected:
        made = made.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return made.groupBy("source", "target").agg(F.count("*").alias("weight"))
