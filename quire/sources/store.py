"""Stored tables keyed by book: replace and purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpointed

BUCKET = "book_bucket"


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create_store(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Write a table in folders by book bucket, a fixed number however many books there are."""
    _write(_bucketed(df, buckets), path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def replace_books(spark: SparkSession, path: str, rows: DataFrame, ids: DataFrame, buckets: int = 64) -> None:
    """Replace all rows of the books in ``ids(book_id)`` by ``rows``; repeating it changes nothing.

    Only the buckets of those books are read and rewritten. The rows kept are checkpointed before
    the write, because they come from the folders it replaces. A book in ``ids`` without new rows is
    deleted; a bucket left without any row keeps a row-less file.
    """
    wanted = _bucketed(ids.select("book_id").distinct(), buckets)
    touched = wanted.select(BUCKET).distinct()
    numbers = [r[0] for r in touched.collect()]  # at most ``buckets`` numbers
    kept = spark.read.parquet(path).filter(F.col(BUCKET).isin(numbers)).join(
        wanted.select("book_id"), "book_id", "left_anti"
    )
    kept = checkpointed(kept)
    fresh = _bucketed(rows.join(wanted.select("book_id"), "book_id", "left_semi"), buckets)
    written = checkpointed(kept.unionByName(fresh))
    _write(written, path)
    # A dynamic overwrite leaves a folder alone when no row falls into it.
    filled = {r[0] for r in written.select(BUCKET).distinct().collect()}
    for number in set(numbers) - filled:
        kept.drop(BUCKET).limit(0).write.mode("overwrite").parquet(f"{path}/{BUCKET}={number}")


def purge_books(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the books in ``ids(book_id)``."""
    gone = ids.select("book_id").distinct()
    return {name: df.join(gone, "book_id", "left_anti") for name, df in tables.items()}
