"""Removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the smallest hash of ``MINIMISER``
consecutive words in it. Consecutive windows of a document that share the minimiser travel as one
packed string to the bucket of that minimiser; equal windows have equal minimisers and so meet in one
bucket, where the windows are sorted and counted and the smallest document of each is found. What goes
back to a document are ranges of its words.

Before the shuffle a task packs its equal strings into one: only the occurrences in the smallest
document of the task travel, the others are repeats whatever the bucket says. So a passage that a third
of all rows share costs each bucket one string per piece of input, and no bucket holds a row per copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BLOCK, Hasher, SPACES, mixed, slices, utf8, words_of
from quire.session import ship_with_tasks

WINDOW = 13
#: Words of a minimiser: enough that no frequent phrase is the minimiser of a large part of the text.
MINIMISER = 4
#: Bytes of text whose strings a task packs together.
PACKED = 6 << 20
#: Buckets that a shuffle partition takes one after the other.
SHARE = 16
#: Of a row's text hash, what tells rows with equal ids apart.
TAG = 0xFFFF

_PACKETS = "bucket int, kind int, strings binary, docs binary, tags binary, starts binary, ends binary"
_RANGES = "doc_id long, tag int, starts binary, ends binary"


def windows_of(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window by its first word; where a window of one text begins."""
    count = max(len(words) - size + 1, 0)
    total = np.zeros(count, np.uint64)
    factor = 1
    for k in range(size):
        total += words[k : k + count] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    last = np.repeat(first[1:], np.diff(first))
    return mixed(total), np.flatnonzero(np.arange(count) + size <= last[:count])


def super_kmers(words: np.ndarray, first: np.ndarray, size: int, minimiser: int):
    """Runs of windows with one minimiser: minimiser, first word, word behind the last one."""
    small, _ = windows_of(words, first, minimiser)
    within = size - minimiser + 1
    # A minimum over a window, by doubling.
    low, width = small, 1
    while width * 2 <= within:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < within:
        low = np.minimum(low[: len(low) - (within - width)], low[within - width :])
    last = np.repeat(first[1:], np.diff(first))
    count = max(len(words) - size + 1, 0)
    inside = np.flatnonzero(np.arange(count) + size <= last[:count])
    if not len(inside):
        return np.zeros(0, np.uint64), inside, inside
    value, text_end = low[inside], last[inside]
    change = np.concatenate(([True], (value[1:] != value[:-1]) | (text_end[1:] != text_end[:-1])))
    begin = np.flatnonzero(change)
    final = np.concatenate((begin[1:], [len(inside)])) - 1
    return value[begin], inside[begin], inside[final] + size


class _Packer:
    """The super-k-mers of about ``PACKED`` bytes of text."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.hasher = buckets, Hasher()
        self.squeeze = zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self) -> None:
        self.strings, self.parts, self.size = [], [], 0

    def add(self, data, offsets, docs, tags) -> None:
        packed, starts, ends, first = words_of(data, offsets)
        words = self.hasher.spans(packed, starts, ends)
        value, begin, end = super_kmers(words, first, WINDOW, MINIMISER)
        whole = packed.tobytes()
        self.strings += [whole[a:b] for a, b in zip(starts[begin].tolist(), ends[end - 1].tolist(), strict=True)]
        row = np.searchsorted(first, begin, "right") - 1
        bucket = (value % np.uint64(self.buckets)).astype(np.int32)
        self.parts.append((bucket, docs[row], tags[row], (begin - first[row]).astype(np.int32), (end - first[row]).astype(np.int32)))
        self.size += len(whole)

    def packets(self):
        if not self.strings:
            return
        bucket, docs, tags, starts, ends = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        number: dict[bytes, int] = {}
        same = np.fromiter((number.setdefault(s, len(number)) for s in self.strings), np.int64, len(self.strings))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, same, docs)
        travels = docs == least[same]
        squeeze = self.squeeze.compress
        rows = []
        order = np.flatnonzero(travels)
        order = order[np.argsort(bucket[order], kind="stable")]
        key = bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for part in np.split(order, cuts[1:]) if len(order) else []:
            text = b"\n".join([self.strings[i] for i in part.tolist()])
            rows.append((int(bucket[part[0]]), 0, squeeze(text), *(squeeze(x[part].tobytes()) for x in (docs, tags, starts)), b""))
        repeats = np.flatnonzero(~travels)
        place = (docs[repeats] % self.buckets).astype(np.int64)
        repeats = repeats[np.argsort(place, kind="stable")]
        place = docs[repeats] % self.buckets
        for part in np.split(repeats, np.flatnonzero(place[1:] != place[:-1]) + 1) if len(repeats) else []:
            rows.append((int(docs[part[0]] % self.buckets), 1, b"", *(squeeze(x[part].tobytes()) for x in (docs, tags, starts, ends))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), *[pa.binary()] * 5], strict=True)],
            names=["bucket", "kind", "strings", "docs", "tags", "starts", "ends"],
        )
        self.clear()


def _pack(buckets: int):
    def run(batches):
        packer = _Packer(buckets)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            docs, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy().astype(np.uint16)
            for a, b in slices(offsets, BLOCK // 2):
                packer.add(data, offsets[a : b + 1], docs[a:b], tags[a:b])
                if packer.size >= PACKED:
                    yield from packer.packets()
        yield from packer.packets()

    return run


def repeated_windows(strings: list[bytes], docs: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """String and place in it of every window whose words also stand in a smaller document's string."""
    whole = b"\n".join(strings)
    data = np.frombuffer(whole, np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))
    offsets[-1] -= 1
    parts = []
    for a, b in slices(offsets, BLOCK // 2):
        # Words are one byte apart already: their places in the packed bytes are those in the text.
        packed, starts, ends, first = words_of(data, offsets[a : b + 1])
        hashes, begin = windows_of(hasher.spans(packed, starts, ends), first, WINDOW)
        own = np.searchsorted(first, begin, "right") - 1
        parts.append((hashes[begin], own + a, begin - first[own], starts[begin] + offsets[a], ends[begin + WINDOW - 1] + offsets[a]))
    key, string, place, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((docs[string], key))
    key, doc = key[order], docs[string[order]]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    later = np.flatnonzero(doc > doc[head[group]])
    # Equal hashes are compared word by word with the smallest document's window.
    mine, heads = order[later], order[head[group[later]]]
    places = (x.tolist() for x in (low[mine], high[mine], low[heads], high[heads]))
    equal = np.fromiter((whole[a:b] == whole[c:d] for a, b, c, d in zip(*places, strict=True)), bool, len(later))
    repeated = np.zeros(len(order), bool)
    repeated[later[equal]] = True
    for bad in np.unique(group[later[~equal]]).tolist():  # different words with one hash
        least: dict[bytes, int] = {}
        for x in np.flatnonzero(group == bad).tolist():  # by document
            words = whole[low[order[x]] : high[order[x]]]
            repeated[x] = least.setdefault(words, int(doc[x])) < doc[x]
    at = np.sort(order[repeated])
    return string[at], place[at]


def _ranges(batches):
    """Packets of one partition, sorted by bucket: ranges of repeated words, by document."""
    plain = zstandard.ZstdDecompressor().decompress
    hasher = Hasher()

    def grouped(docs, tags, starts, ends):
        order = np.lexsort((starts, tags, docs))
        docs, tags, starts, ends = docs[order], tags[order], starts[order], ends[order]
        cuts = np.flatnonzero((docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])) + 1
        edges = [0, *cuts.tolist(), len(docs)]
        spans = list(zip(edges[:-1], edges[1:], strict=True)) if len(docs) else []
        low, high = starts.astype("<i4").tobytes(), ends.astype("<i4").tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(docs[[a for a, _ in spans]], pa.int64()),
                pa.array(tags[[a for a, _ in spans]].astype(np.int32), pa.int32()),
                pa.array([low[4 * a : 4 * b] for a, b in spans], pa.binary()),
                pa.array([high[4 * a : 4 * b] for a, b in spans], pa.binary()),
            ],
            names=["doc_id", "tag", "starts", "ends"],
        )

    def judged(strings, parts):
        docs, tags, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
        string, place = repeated_windows(strings, docs, hasher)
        begin = starts[string] + place
        joined = np.concatenate(([False], (string[1:] == string[:-1]) & (begin[1:] == begin[:-1] + 1))) if len(string) else np.zeros(0, bool)
        head = np.flatnonzero(~joined)
        tail = np.concatenate((head[1:], [len(string)])) - 1 if len(head) else head
        return grouped(docs[string[head]], tags[string[head]], begin[head], begin[tail] + WINDOW)

    bucket, strings, parts = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            docs = np.frombuffer(plain(row["docs"]), np.int64)
            tags = np.frombuffer(plain(row["tags"]), np.uint16)
            starts = np.frombuffer(plain(row["starts"]), np.int32)
            if row["kind"]:
                yield grouped(docs, tags, starts, np.frombuffer(plain(row["ends"]), np.int32))
                continue
            if row["bucket"] != bucket and strings:
                yield judged(strings, parts)
                strings, parts = [], []
            bucket = row["bucket"]
            strings += plain(row["strings"]).split(b"\n")
            parts.append((docs, tags, starts))
    if strings:
        yield judged(strings, parts)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, tag, starts, ends)``: lists of word ranges to remove.

    ``tag`` tells rows with one id apart (16 bits of the hash of the text). Lists are little-endian
    32-bit integers; ranges may overlap. Rows without an id neither repeat nor are repeated.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packets = docs.filter("doc_id IS NOT NULL").select("doc_id", _tag(), "text").mapInArrow(_pack(partitions * SHARE), _PACKETS)
    return packets.repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_ranges, _RANGES)


def _tag():
    return F.xxhash64("text").bitwiseAND(F.lit(TAG).cast("long")).cast("int").alias("tag")


def _removed(words: int, ranges: list[tuple[bytes, bytes]]) -> np.ndarray:
    marks = np.zeros(words + 1, np.int32)
    for low, high in ranges:
        np.add.at(marks, np.frombuffer(low, "<i4"), 1)
        np.add.at(marks, np.frombuffer(high, "<i4"), -1)
    return np.cumsum(marks[:-1]) > 0


def _keep(batches):
    for batch in batches:
        for row in range(0, len(batch), 256):
            part = batch.slice(row, 256)
            texts, ranges = part.column("text").to_pylist(), part.column("ranges").to_pylist()
            counts, removed, kept = [], [], []
            for text, own in zip(texts, ranges, strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space only
                counts.append(len(words))
                if own:
                    gone = _removed(len(words), [(x["starts"], x["ends"]) for x in own])
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_words, n_removed, kept)``, one row per row.

    A word goes if a window over it also begins in a document with a smaller id; windows are judged
    on the texts as given. ``kept`` has the other words with one space between (UTF-8 bytes). A null
    text has no words; a text shorter than a window keeps all of them; repeated rows with one id keep
    theirs, as no id is smaller.
    """
    ranges = (
        repeated_ranges(docs)
        .groupBy("doc_id", "tag")
        .agg(F.collect_list(F.struct("starts", "ends")).alias("ranges"))  # of one document's own words
    )
    joined = docs.select("doc_id", _tag(), "text").join(ranges, ["doc_id", "tag"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept binary")


def twin() -> str:
    """The result in SQL: every window as a list of words, grouped."""
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(len(w) - {WINDOW - 1})) AS pos FROM d),
k AS (SELECT doc_id, pos, w[pos + 1:pos + {WINDOW}] AS own FROM i),
m AS (SELECT own, min(doc_id) AS least FROM k GROUP BY own),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range({WINDOW})) AS pos FROM k JOIN m USING (own) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


assert SPACES.split() == []
ship_with_tasks(__name__)
