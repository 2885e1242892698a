"""What the operators of this package share: tables, intermediate storage, and words in numpy.

The functions on bytes work on a slice of an Arrow string column, many texts at a time. Memory is a
small multiple of the slice, which holds at least one text and about ``BLOCK`` bytes.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.session import fresh_path, ship_with_tasks

#: Bytes of text that one numpy step takes.
BLOCK = 2 << 20
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = bytes([32, 9, 10, 11, 12, 13])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a lost executor costs no rerun."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidied(run):
    """``run`` over batches, and then freed memory goes back to the system: workers outlive their tasks."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return whole


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is the empty text."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, size: int = BLOCK):
    """Ranges of rows of about ``size`` bytes, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Words of the texts that lie at ``offsets``: the bytes of all words, each followed by one
    space; where each word begins and ends there; the number of the first word of each text (one
    more entry than texts)."""
    begin = int(offsets[0])
    text = data[begin : int(offsets[-1])]
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    gap = space[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets - begin] = True
    before = np.concatenate(([True], gap[:-1])) | edge[:-1] if len(text) else gap
    after = np.concatenate((gap[1:], [True])) | edge[1:] if len(text) else gap
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    first = np.searchsorted(starts, offsets - begin)
    long = ends - starts
    to = np.cumsum(long + 1)
    narrow = np.int32 if len(text) < 1 << 30 else np.int64
    at = np.arange(int(to[-1]) if len(to) else 0, dtype=narrow)
    at -= np.repeat((to - (long + 1) - starts).astype(narrow), long + 1)
    packed = text[np.minimum(at, max(len(text) - 1, 0), out=at)]
    packed[to - 1] = 32
    return packed, to - long - 1, to - 1, first


def mixed(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """64-bit hashes of spans of a byte array, by prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self.up):
            inverse = pow(self.BASE, -1, 1 << 64)
            for name, base in (("up", self.BASE), ("down", inverse)):
                powers = np.full(len(data) + 1, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


ship_with_tasks(__name__)
