"""Token ids of two tokenizers brought together: which tokens cover the same bytes of a text.

Tokenizer A is a byte-level BPE, B a sentencepiece model with byte fallback. Both see a space and the text.
The ends of their tokens, in bytes, are two dictionaries from end to index; the ends that are in both, in
order, cut both lists of ids into groups, and within a group the tokens whose bytes overlap are linked.

A text is taken apart into words, each with the white space before it. No token of either tokenizer crosses
such a place, so both end there, and groups and links are those of the words. A task encodes and aligns each
distinct word once. What counts how often two ids are linked in the whole corpus is summed per block of
documents first; blocks are a few megabytes of text. Their pairs get the sums of the corpus back, block by
block, and meet the documents of the block there: no link travels alone, and nothing is broadcast.

Result for special cases: a text that is null or empty, or that one of the tokenizers does not give back
byte for byte (the mark U+2581 in it becomes a space), has no tokens: zeros and the empty text. Strings of
special tokens are ordinary text. Rows are kept as they are, repeated ones and those without id too. Other
columns are not carried along.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from quire.llm.common import Numbers, slices, stored, tidied, utf8
from quire.llm.vocabulary import LETTERS, cut_at, plain, ranks_of, read
from quire.session import ship_with_tasks

#: Bytes of text of a block, and distinct words that a task remembers before it starts anew.
BLOCK, REMEMBERED = 8 << 20, 600_000
#: Between words in what goes to the fast encoder. No word holds it.
BETWEEN = "\0"
#: The pattern of A, for words of plain characters (fixed value but for ``BETWEEN``).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{BETWEEN}{LETTERS}0-9]+|\s|{BETWEEN}"
#: B's mark of a space.
MARK = "\u2581"
#: A word ends where one space or line feed stands between two characters that are no white space to anyone.
SOLID = rf"[^\s{MARK}\u180e\u200b-\u200f\u2060\ufeff]"
CUT = re.compile(rf"(?<={SOLID})(?=[ \n]{SOLID})")
#: White space other than space and line feed, and what else is not ``SOLID``.
OTHER = re.compile(rf"[^\S \n]|[{MARK}\u180e\u200b-\u200f\u2060\ufeff]")
#: Those of them that are ASCII.
CONTROL = re.compile("[\t\v\f\r\x1c-\x1f]")
#: Beside another blank, a blank is no such place; nor is it at the ends of a text.
BLANKS = ("  ", "\n\n", " \n", "\n ")


def words_of(text: str) -> list[str]:
    """The words of a space and the text. A word's one leading space is left out; if white space follows
    it, or a word begins with a line feed, it is kept as it is."""
    if text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in BLANKS) and (text.isascii() and not CONTROL.search(text) or not OTHER.search(text)):
        return text.replace("\n", " \n").split(" ")
    return [w[1:] if w[0] == " " and w[1:2] not in ("", " ", "\n") else w for w in CUT.split(" " + text)]


def spelled(word: str) -> str:
    """A word of ``words_of`` with its leading white space."""
    return word if word[0] in " \n" else " " + word


def groups(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """The groups of two lists of tokens with these ends: ranges of A's and of B's list."""
    index_a = {end: k for k, end in enumerate(ends_a, 1)}
    index_b = {end: k for k, end in enumerate(ends_b, 1)}
    found, i, j = [], 0, 0
    for end in sorted(index_a.keys() & index_b.keys()):
        found.append((i, index_a[end], j, index_b[end]))
        i, j = index_a[end], index_b[end]
    return found


def links(found: list[tuple[int, int, int, int]], ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of A and B whose bytes overlap, expanded group by group."""
    out = []
    for i, to, j, end in found:
        while i < to and j < end:
            out.append((i, j))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
    return out


class Aligner:
    """Aligns texts of one task; remembers its distinct words. ``shared``: A's file, its ranks, their ids
    and the bytes of its ids; B's model."""

    def __init__(self, shared) -> None:
        self.file, ranks, self.of_rank, self.bytes_a, model = shared
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.between = ranks[BETWEEN.encode()]
        self.plain = plain("\n?")
        self.library: Tokenizer | None = None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.lone = self.b.piece_to_id(MARK)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.sizes = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.names = [str(k) for k in range(max(map(len, self.sizes)))]
        # Words may be taken apart if no piece goes on after a space or holds a line feed.
        self.apart = not any(re.search(rf"[^{MARK}]{MARK}|\n", p) for p in pieces)
        self.reset()

    def reset(self) -> None:
        self.number, self.pair = Numbers(), Numbers()
        self.texts: list[str | None] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.pairs, self.edges = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids_a(self, words: list[str]) -> tuple[list[list[int]], list[bool]]:
        """A's ids of words as they are spelled, and which of them are plain."""
        easy = [self.plain.fullmatch(w) is not None for w in words]
        chosen = [w for w, good in zip(words, easy, strict=True) if good]
        found = []
        if chosen:
            ids, edges = cut_at(np.array(self.fast.encode_ordinary(BETWEEN.join(map(spelled, chosen))), np.int32), self.between)
            ids, edges = self.of_rank[ids].tolist(), edges.tolist()
            found = [ids[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
        if len(chosen) == len(words):
            return found, easy
        if self.library is None:
            self.library = Tokenizer.from_str(self.file)
            self.library.encode_special_tokens = True
        ready = iter(found)
        return [next(ready) if good else self.library.encode(spelled(w), add_special_tokens=False).ids for w, good in zip(words, easy, strict=True)], easy

    def ids_b(self, words: list[str]) -> list[list[int]]:
        """B's ids of words as they are spelled; B puts a space before what it gets."""
        bodies = [s[1:] if (s := spelled(w))[0] == " " else s for w in words]
        found = self.b.encode(bodies, num_threads=1)
        return [x[1:] if w[0] == "\n" and x[:1] == [self.lone] else x for w, x in zip(words, found, strict=True)]

    def learn(self) -> None:
        """Encode and align the words that have numbers but no results yet."""
        new = list(self.number)[len(self.texts) :]
        if not new:
            return
        size_a, size_b = self.sizes
        name = self.names.__getitem__
        counts, pairs, edges = [], [], [len(self.pairs)]
        number = self.pair.__getitem__
        for word, a, good, b in zip(new, *self.ids_a(new), self.ids_b(new), strict=True):
            raw = spelled(word).encode("utf-8", "surrogatepass")
            # A gives plain words back by its rules; of the others, and of B, it is checked.
            if b"".join([self.bytes_b[x] for x in b]) != raw or not good and b"".join([self.bytes_a[x] for x in a]) != raw:
                self.texts.append(None)
                counts.append((0, 0, 0, 0))
                edges.append(edges[-1])
                continue
            if len(a) == 1 or len(b) == 1:  # one group, all linked
                found, linked = 1, [number((x, y)) for x in a for y in b]
                self.texts.append(",".join(map(name, a)) + "|" + ",".join(map(name, b)))
            else:
                ends_a, ends_b, at = [], [], 0
                for x in a:
                    at += size_a[x]
                    ends_a.append(at)
                at = 0
                for y in b:
                    at += size_b[y]
                    ends_b.append(at)
                cut = groups(a, b, ends_a, ends_b)
                found, linked = len(cut), [number((a[i], b[j])) for i, j in links(cut, ends_a, ends_b)]
                self.texts.append(";".join([",".join(map(name, a[i:x])) + "|" + ",".join(map(name, b[j:y])) for i, x, j, y in cut]))
            counts.append((len(a), len(b), found, len(linked)))
            pairs += linked
            edges.append(edges[-1] + len(linked))
        self.counts = np.concatenate((self.counts, np.array(counts, np.int64)))
        self.pairs = np.concatenate((self.pairs, np.array(pairs, np.int32)))
        self.edges = np.concatenate((self.edges, np.array(edges[1:], np.int64)))

    def align(self, texts: list[str]):
        """Per text: groups as text (none: the empty text), four counts, the numbers of its linked pairs
        and how often each is linked; and the pairs of the numbers."""
        if len(self.number) > REMEMBERED:
            self.reset()
        sequence, lengths, number = [], [], self.number.__getitem__
        for text in texts:
            words = (words_of(text) if self.apart else [" " + text]) if text else []
            sequence.append(np.fromiter(map(number, words), np.int32, len(words)))
            lengths.append(len(words))
        self.learn()
        written, rows = [], np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
        for k, some in enumerate(sequence):
            parts = [self.texts[x] for x in some.tolist()]
            if None in parts:
                parts, sequence[k] = [], some[:0]
            written.append(";".join(parts))
        bad = np.array([n > 0 and len(s) == 0 for n, s in zip(lengths, sequence, strict=True)], bool)
        rows = rows[~bad[rows]]
        words = np.concatenate(sequence) if sequence else np.zeros(0, np.int32)
        counts = np.zeros((len(texts), 4), np.int64)
        for c in range(4):
            counts[:, c] = np.bincount(rows, self.counts[words, c], minlength=len(texts))
        start = self.edges[words]
        long = self.edges[words + 1] - start
        to = np.cumsum(long)
        at = np.arange(int(to[-1]) if len(to) else 0)
        at -= np.repeat(to - long - start, long)
        key = np.repeat(rows, long) * len(self.pair) + self.pairs[at]
        key, times = np.unique(key, return_counts=True)
        owner = np.searchsorted(key, np.arange(len(texts) + 1) * max(len(self.pair), 1))
        return written, counts, (key % max(len(self.pair), 1)).astype(np.int32), times.astype(np.int32), owner


#: Rows of documents and, apart from them, of the linked pairs of each block.
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>, number int, a int, b int, links long"


def _aligned(shared, digest: bool, schema: pa.Schema):
    def lists(values, owner, kind):
        return pa.ListArray.from_arrays(pa.array(owner.astype(np.int32)), pa.array(values)).cast(kind)

    def rows(count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(count, f.type)) for f in schema], schema=schema)

    def run(batches):
        aligner, block = Aligner(shared.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column("text")
            for first, last in slices(utf8(column)[1], BLOCK):
                texts = column.slice(first, last - first).to_pylist()
                written, counts, pairs, times, owner = aligner.align(texts)
                if digest:
                    written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
                n = last - first
                yield rows(
                    n,
                    block=pa.array(np.full(n, block)),
                    doc_id=batch.column("doc_id").slice(first, n),
                    **{name: pa.array(counts[:, k]) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                    groups=pa.array(written, pa.string()),
                    pairs=lists(pairs, owner, schema.field("pairs").type),
                    times=lists(times, owner, schema.field("times").type),
                )
                total = np.bincount(pairs, times, minlength=len(aligner.pair)).astype(np.int64)
                used = np.flatnonzero(total)
                if len(used):
                    named = list(aligner.pair)
                    ab = np.array([named[k] for k in used.tolist()], np.int32)
                    yield rows(len(used), block=pa.array(np.full(len(used), block)), number=pa.array(used.astype(np.int32)), a=pa.array(ab[:, 0]), b=pa.array(ab[:, 1]), links=pa.array(total[used]))
                block += 1

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """Stored rows of two kinds: a document (``number`` null) with its groups (as text, or its digest) and
    its pairs; and each pair of a block, with the number it has there and how often the block links it."""
    with open(path_a, encoding="utf-8") as file:
        text = file.read()
    with open(path_b, "rb") as file:
        model = file.read()
    tokens = read(path_a)["tokens"]
    shared = docs.sparkSession.sparkContext.broadcast((text, *ranks_of(path_a), [tokens.get(k, b"") for k in range(max(tokens) + 1)], model))
    docs = docs.select("doc_id", "text")
    out = f"block long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ALIGNED}"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    return stored(docs.mapInArrow(tidied(_aligned(shared, digest, schema)), out), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(a, b, links, best)``: how often the corpus links each pair of ids, and whether no id of A is linked
    with that id of B more often. There are at most as many rows for one ``b`` as A has ids."""
    counts = rows.filter("number IS NOT NULL").groupBy("a", "b").agg(F.sum("links").alias("links"))
    return counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def counted(rows: DataFrame) -> DataFrame:
    """The documents of ``aligned`` with ``n_best``, their links with a best pair, and ``count_sum``, the sum
    of the corpus counts over their links."""
    counts = pair_counts(rows).select("a", "b", F.col("links").alias("count"), "best")
    known = rows.filter("number IS NOT NULL").select("block", "number", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "number", "count", "best")
    documents = rows.filter("number IS NULL").drop("number", "a", "b", "links")
    names = [c for c in documents.columns if c not in ("block", "pairs", "times")]
    out = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in names) + ", n_best long, count_sum long"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], out).schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, number = left.combine_chunks(), right["number"].to_numpy()
        count = np.zeros(int(number.max(initial=-1)) + 2, np.int64)
        best = np.zeros(len(count), np.int64)
        count[number], best[number] = right["count"].to_numpy(), right["best"].to_numpy()
        pairs, times = left["pairs"].combine_chunks(), left["times"].combine_chunks()
        edges = pairs.offsets.to_numpy()
        which = pairs.values.to_numpy()[edges[0] : edges[-1]] if len(pairs) else np.zeros(0, np.int32)
        offsets = times.offsets.to_numpy()
        often = times.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
        sums = []
        for weight in (best, count):
            total = np.concatenate(([0], np.cumsum(weight[which] * often)))
            sums.append(pa.array(np.diff(total[edges - edges[0]])))
        return pa.Table.from_arrays([*(left[n] for n in names), *sums], schema=schema)

    return documents.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(meet, out)


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Counts of every document, and the digest of its groups."""
    rows = counted(aligned(docs, path_a, path_b, digest=True))
    return rows.withColumnRenamed("groups", "groups_sha256")


ship_with_tasks(__name__)
