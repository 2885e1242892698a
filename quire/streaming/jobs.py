"""Structured Streaming jobs: import de-duplication, activity, quiz state, retrieval metrics.

Late data: rows up to one day late update the result, later ones are dropped by the watermark and counted.
Each micro-batch writes a folder of its own number, so a batch that is run again replaces its own
output, and readers take the newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quire.functions.numbers import round_half_even
from quire.session import ship_with_tasks

BATCH = "batch"


def _folder(path: str, number: int) -> str:
    return f"{path}/{BATCH}={number}"


#: Settings of a query that keeps state by key.
KEYED = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", conf: dict[str, str] | None = None) -> StreamingQuery:
    """Run ``write`` on all data available now, then stop. A query takes the settings it starts with."""
    session = stream.sparkSession
    before = {name: session.conf.get(name, None) for name in conf or {}}
    for name, value in (conf or {}).items():
        session.conf.set(name, value)
    try:
        return _started(stream, write, checkpoint, mode)
    finally:
        for name, value in before.items():
            session.conf.unset(name) if value is None else session.conf.set(name, value)


def _started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def update_log(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for update mode: the changed rows of every batch."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(_folder(path, number))


def newest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written row per key of an update log."""
    log = spark.read.parquet(path)
    values = [c for c in log.columns if c not in (*keys, BATCH)]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("v"))
    return newest.select(*keys, "v.*")


def daily_activity(attempts: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Attempts per calendar day; each change of a day's count is an update."""
    counted = attempts.withWatermark("answered_at", lateness).groupBy(F.window("answered_at", "1 day")).agg(
        F.count("*").alias("attempts")
    )
    return counted.select(F.to_date("window.start").alias("date"), "attempts")


def daily_arrivals(attempts: DataFrame) -> DataFrame:
    """All attempts per calendar day, however late; its state is one number per day."""
    return attempts.groupBy(F.to_date("answered_at").alias("date")).agg(F.count("*").alias("arrived"))


def late_attempts(spark: SparkSession, activity: str, arrivals: str) -> DataFrame:
    """Attempts per day that were counted and that came too late for it, from the logs of both streams."""
    counted, arrived = newest_rows(spark, activity, ["date"]), newest_rows(spark, arrivals, ["date"])
    attempts = F.coalesce("attempts", F.lit(0))
    return arrived.join(counted, "date", "left").select("date", attempts.alias("attempts"), (F.col("arrived") - attempts).alias("late"))


def quiz_state(attempts: DataFrame) -> DataFrame:
    """Latest result and share of correct attempts per quiz after each batch."""
    return attempts.groupBy("quiz_id").agg(
        F.max_by("is_correct", F.struct("answered_at", "attempt_id")).alias("is_correct"),
        round_half_even(F.avg("is_correct"), 2).alias("correct_rate"),
    )


class FirstFile(StatefulProcessor):
    """Per file hash, the file that brought it first; that is all the state an import needs.

    Of the files of one hash in one batch, the smallest id is the first. They are held as numbers while the
    batch lasts; how large a batch is, the source's options say.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "file_id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ids = np.fromiter((row.file_id for row in rows), np.int64)
        state = self.first.get()
        original = int(ids.min()) if state is None else state[0]
        if state is None:
            self.first.update((original,))
        for file_id in ids.tolist():
            yield Row(file_id=file_id, key=key[0], duplicate_of=None if state is None and file_id == original else original)

    def close(self) -> None:
        pass


def import_deduplication(files: DataFrame) -> DataFrame:
    """Arriving files ``(file_id, file_hash)`` with the first file of the same hash, in this batch or any before.

    The state is keyed by hash and lives in the state store of the query (``start`` with ``KEYED``), so a
    batch looks up its own hashes and reads nothing else. A file without a hash has no duplicates.
    """
    # No hash begins like this.
    keyed = files.select("file_id", F.coalesce("file_hash", F.concat(F.lit("#"), F.col("file_id"))).alias("key"))
    out = "file_id bigint, key string, duplicate_of bigint"
    found = keyed.groupBy("key").transformWithState(FirstFile(), out, outputMode="Append", timeMode="None")
    return found.select("file_id", F.when(~F.startswith("key", F.lit("#")), F.col("key")).alias("file_hash"), "duplicate_of")


def rolling_window(state: str, order: list[Column], size: int = 100) -> Callable[[DataFrame, int], None]:
    """Keep the last ``size`` rows of a stream: each batch writes them from its own rows and the
    state before it. Both inputs are cut to ``size`` rows inside the tasks."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.orderBy(*order).limit(size)
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(_folder(state, number - 1))).orderBy(*order).limit(size)
        rows.write.mode("overwrite").parquet(_folder(state, number))

    return write


def last_window(spark: SparkSession, state: str) -> DataFrame:
    log = spark.read.parquet(state)
    return log.filter(F.col(BATCH) == log.agg(F.max(BATCH).alias("m")).scalar()).drop(BATCH)


ship_with_tasks(__name__)
