"""Sequences for training, packed along a space-filling curve.

Each document is a vector of its hashed tokens, projected to a few dimensions; its place is the Hilbert key
of that point, so documents of like content are neighbours along the curve. The curve is cut into ranges of
about equal size, one task each, and the tokens of all documents are laid out along it without a gap:
sequence ``s`` holds the tokens ``s * length`` to ``(s + 1) * length`` of the whole. Only the last sequence
of the corpus is padded. The bounds of the ranges are quantiles and their sums of tokens one number per
range; nothing else passes the driver. Below the key, a place has bits of a hash, so a group of copies of
any size is cut into ranges like everything else.

Words, the stretches between ASCII white space, are encoded once per task; the pattern drops white space
and no normal form reaches across it, so the ids of a text are those of its words.

Result for special cases: a null text is the empty text, which is the end id alone. The strings of special
tokens in a text become their ids, as the library does by default. Rows are kept as they are, repeated
ones too; a null ``doc_id`` stays null. Other columns are not carried along.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from quire.llm.common import Numbers, mixed, slices, stored, tidied, utf8
from quire.llm.vocabulary import LETTERS, cut_at, gathered, plain, ranks_of
from quire.session import ship_with_tasks

#: Tokens of a sequence, and the id that follows each document.
LENGTH, END = 2048, 1
#: Dimensions of a hashed document vector, of its projection, and bits of each projected number.
HASHED, DIMENSIONS, BITS = 256, 4, 8
#: Tokens of a range of the curve that are aimed at.
RANGE = 8 << 20
#: Distinct words that a task remembers before it starts anew, and bytes of text that it takes at a time.
REMEMBERED, BATCH = 1_000_000, 8 << 20
#: Between words, and after each piece of a word, in what goes to the fast encoder. No word holds them.
BETWEEN, AFTER = "\r", "\n"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{BETWEEN}{LETTERS}0-9]+")


class Encoder:
    """Ids of texts; remembers those of distinct words. ``shared``: the file's text, ranks and their ids."""

    def __init__(self, shared: tuple[str, dict[bytes, int], np.ndarray]) -> None:
        self.file, ranks, self.of_rank = shared
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{AFTER}{BETWEEN}]+{AFTER}|{BETWEEN}", mergeable_ranks=ranks, special_tokens={})
        self.between = ranks[BETWEEN.encode()]
        self.plain = plain()
        self.library: Tokenizer | None = None
        self.reset()

    def reset(self) -> None:
        self.number = Numbers()
        self.ids, self.edges = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def by_library(self, word: str) -> list[int]:
        if self.library is None:
            self.library = Tokenizer.from_str(self.file)
        return self.library.encode(word, add_special_tokens=False).ids

    def learn(self) -> None:
        """Encode the words that have numbers but no ids yet."""
        new = [w.decode("utf-8", "replace") for w in list(self.number)[len(self.edges) - 1 :]]
        if not new:
            return
        fast = np.fromiter((bool(self.plain.fullmatch(w)) and "<|" not in w for w in new), bool, len(new))
        parts = []
        easy = [w for w, good in zip(new, fast.tolist(), strict=True) if good]
        if easy:
            text = SPLIT.sub(rf"\g<0>{AFTER}", BETWEEN.join(easy).lower())
            found, edges = cut_at(np.array(self.fast.encode_ordinary(text), np.int32), self.between)
            parts.append((np.flatnonzero(fast), self.of_rank[found], edges))
        hard = [self.by_library(w) for w, good in zip(new, fast.tolist(), strict=True) if not good]
        if hard:
            parts.append((np.flatnonzero(~fast), np.array([i for x in hard for i in x], np.int32), np.cumsum([0, *map(len, hard)])))
        ids, edges = gathered(parts, len(new))
        self.edges = np.concatenate((self.edges, len(self.ids) + edges[1:]))
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins in it (one more entry)."""
        if len(self.number) > REMEMBERED:
            self.reset()
        words, counts, number = [], [], self.number.__getitem__
        for text in texts:
            parts = text.split()
            words.append(np.fromiter(map(number, parts), np.int32, len(parts)))
            counts.append(len(parts))
        self.learn()
        words = np.concatenate(words) if words else np.zeros(0, np.int32)
        start = self.edges[words]
        long = self.edges[words + 1] - start
        to = np.concatenate(([0], np.cumsum(long)))
        at = np.arange(int(to[-1]))
        at -= np.repeat(to[:-1] - start, long)
        return self.ids[at], to[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]


def projection() -> np.ndarray:
    """The fixed directions that hashed vectors are projected to."""
    return np.random.default_rng(5).standard_normal((HASHED, DIMENSIONS)).astype(np.float32)


def points(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A point of ``DIMENSIONS`` numbers from 0 to ``2**BITS - 1`` for each document.

    A vector counts hashed ids with signs, dampened by the root, and has length one; then a projected number
    is about normal, and its cell follows the normal distribution (by a logistic curve that is close to it).
    """
    known = np.arange(int(ids.max(initial=0)) + 1, dtype=np.uint64)
    scattered = mixed(known + np.uint64(1))
    bucket = (scattered % np.uint64(HASHED)).astype(np.int32)
    sign = np.where(scattered >> np.uint64(63), 1.0, -1.0).astype(np.float32)
    out = np.zeros((len(edges) - 1, DIMENSIONS), np.int64)
    directions = projection()
    for first in range(0, len(out), 2048):
        last = min(first + 2048, len(out))
        part = ids[edges[first] : edges[last]]
        place = np.repeat(np.arange(last - first, dtype=np.int32) * HASHED, np.diff(edges[first : last + 1])) + bucket[part]
        vector = np.bincount(place, sign[part], minlength=(last - first) * HASHED).reshape(-1, HASHED)
        vector = np.sign(vector) * np.sqrt(np.abs(vector))
        vector /= np.maximum(np.sqrt((vector**2).sum(axis=1, keepdims=True)), 1e-9)
        normal = 1 / (1 + np.exp(-1.702 * (vector @ directions)))
        out[first:last] = np.clip((normal * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return out


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each row of ``cells``: neighbours along the curve differ by one in one dimension.

    Level by level from the top, the bit of each dimension turns the rest of the walk: where it is set, the
    first dimension is mirrored below that level, else the two are swapped. A Gray code orders the rest.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for k in range(n):
            mirrored = (x[:, k] >> level) & 1 == 1
            exchange = np.where(mirrored, 0, (x[:, 0] ^ x[:, k]) & below)
            x[:, 0] ^= np.where(mirrored, below, exchange)
            x[:, k] ^= exchange
    for k in range(1, n):
        x[:, k] ^= x[:, k - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | ((x[:, k] >> level) & 1)
    return key


def _encoded(shared, end: int, wide: str, schema: pa.Schema):
    """``(doc_id, place, tokens, ids)`` per document; ids as little-endian numbers of kind ``wide``."""
    low = 63 - DIMENSIONS * BITS

    def run(batches):
        encoder, seen = Encoder(shared.value), 0
        task = mixed(np.array([TaskContext.get().partitionId() + 1], np.uint64))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in slices(offsets, BATCH):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[first:last], offsets[first + 1 : last + 1], strict=True)]
                ids, edges = encoder.encode(texts)
                rows = np.arange(seen, seen + last - first, dtype=np.uint64)
                seen += last - first
                spread = mixed(rows ^ task) >> np.uint64(64 - low)
                place = (hilbert(points(ids, edges)) << low) | spread.astype(np.int64)
                ended = np.insert(ids, edges[1:], end).astype(wide)
                to = edges + np.arange(len(edges))
                packed = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer((to * ended.itemsize).astype(np.int64)), pa.py_buffer(ended)])
                columns = [batch.column("doc_id").slice(first, last - first), pa.array(place), pa.array(np.diff(to)), packed.cast(schema.field(3).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def encoded(docs: DataFrame, path: str, end: int = END) -> tuple[DataFrame, str]:
    """``(doc_id, place, tokens, ids)`` of every document, stored; and how an id is written in ``ids``."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    ranks, of_rank = ranks_of(path, AFTER.encode())
    shared = docs.sparkSession.sparkContext.broadcast((text, ranks, of_rank))
    wide = "<u2" if max(Tokenizer.from_str(text).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    docs = docs.select("doc_id", "text")
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, place long, tokens long, ids binary"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    return stored(docs.mapInArrow(tidied(_encoded(shared, end, wide, schema)), out), "encoded"), wide


def ranged(rows: DataFrame, size: int = RANGE) -> tuple[DataFrame, np.ndarray]:
    """``rows`` with ``range``, the part of the curve that holds ``place``; and the tokens before each range."""
    tokens = rows.agg(F.sum("tokens")).first()[0] or 0
    count = int(tokens // size) + 1
    if count == 1:
        return rows.withColumn("range", F.lit(0)), np.zeros(1, np.int64)
    inner = [k / count for k in range(1, count)]
    bounds = np.unique(rows.agg(F.percentile_approx("place", inner, 20 * count)).first()[0])

    @F.pandas_udf("int")
    def place_in(place):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, place.to_numpy(), "right").astype(np.int32))

    rows = rows.withColumn("range", place_in("place"))
    total = np.zeros(len(bounds) + 1, np.int64)
    for k, n in rows.groupBy("range").agg(F.sum("tokens")).collect():
        total[k] = n
    return rows, np.cumsum(total) - total


def _pieces(before: np.ndarray, length: int, wide: str, schema: pa.Schema):
    """Pieces of the documents of ranges, which come in the order of the curve."""

    def run(batches):
        current, at = -1, 0
        for batch in batches:
            for row in range(0, len(batch), 1024):
                part = batch.slice(row, 1024)
                names, ranges, lists = part.column("doc_id").to_pylist(), part.column("range").to_pylist(), part.column("ids").to_pylist()
                found = []
                for name, k, packed in zip(names, ranges, lists, strict=True):
                    if k != current:
                        current, at = k, int(before[k])
                    ids = np.frombuffer(packed, wide)
                    start = 0
                    while start < len(ids):
                        sequence, offset = divmod(at, length)
                        piece = ids[start : start + length - offset]
                        found.append((name, start, len(piece), len(ids), sequence, offset, piece.astype("<u4").tobytes()))
                        start, at = start + len(piece), at + len(piece)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    return run


def packed(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, size: int = RANGE) -> DataFrame:
    """The pieces of all sequences: ``doc_id``, ``start`` and ``length`` of the piece in its document of
    ``doc_tokens`` tokens (with the end id), ``sequence_id``, ``offset`` there, and ``ids``, the tokens as
    little-endian unsigned 32-bit numbers. ``size``: tokens of a task, about."""
    rows, wide = encoded(docs, path, end)
    rows, before = ranged(rows, size)
    name = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {name}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    dealt = rows.drop("tokens").repartitionById(len(before), "range").sortWithinPartitions("range", "place", "doc_id")
    return dealt.mapInArrow(tidied(_pieces(before, length, wide, schema)), out)


def digests(pieces: DataFrame) -> DataFrame:
    """``packed`` with the checksum of the ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: ``sequence_id``, its token ids, and the documents of its pieces in order.

    A sequence has at most ``length`` tokens, so its group is bounded.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    joined = F.aggregate("inside", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    grouped = pieces.groupBy("sequence_id").agg(inside.alias("inside"))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("inside", lambda x: x.dropFields("ids")).alias("pieces"))


ship_with_tasks(__name__)
