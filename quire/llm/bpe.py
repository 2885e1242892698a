"""Byte-level BPE: all distinct words of a piece of the corpus are encoded together by merge replay.

The unit of encoding is the pre-token, a match of the pattern. A task keeps the distinct chunks of its
texts, so each distinct pre-token of a task is encoded once. Their bytes lie in one array; an inverted
index leads from the rank of a token pair to the positions where that pair stands now. Merges are
applied in rank order, all positions of a rank at once, and only the pairs that touch a merged
position are looked up again and enter the index. Texts are then put together from the ids of their
chunks. No shuffle is needed: the vocabulary of a task is part of the vocabulary of the corpus, and a
pre-token has the same ids everywhere.

Result for special cases: a null text is the empty text; it has no ids. Text that looks like a special
token is ordinary text. Rows are kept as they are, repeated ones too; other columns are carried along.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import Numbers, slices, tidied, utf8
from quire.llm.vocabulary import LETTERS
from quire.session import ship_with_tasks

#: Distinct chunks that a task remembers before it starts anew; bounds its memory.
REMEMBERED = 200_000
#: Bytes of text whose new chunks are encoded together.
LEARNT = 8 << 20
#: Bytes of text whose ids are put together at a time.
BATCH = 4 << 20


def members(kind: str, below: int = 0x110000) -> str:
    """The characters of a class such as ``\\p{L}``, as ranges of a regular expression.

    Which characters are letters depends on the version of Unicode, so the library is asked itself: what the
    pattern does not match has no ids.
    """
    probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(chr(c) for c in range(below) if not 0xD800 <= c < 0xE000)
    found = np.array([ord(c) for c in bytes(probe.encode_ordinary(every)).decode()])
    cuts = np.flatnonzero(np.diff(found) != 1) + 1
    return "".join(f"\\U{part[0]:08x}-\\U{part[-1]:08x}" for part in np.split(found, cuts))


def explicit(pattern: str) -> tuple[str, str, str, str]:
    """``pattern`` with the classes of letters, numbers and white space written out; what ``Encoder`` cuts
    texts by: a space before another character, and a space before white space or the end; and the pattern
    for texts of ASCII, where the classes are short."""
    kinds = (r"\p{L}", r"\p{N}", r"\s")
    every, ascii_ = ({kind: members(kind, below) for kind in kinds} for below in (0x110000, 128))

    def written(some: str, known: dict[str, str] = every) -> str:
        out, inside = "", False
        for part in re.findall(r"\\p\{\w\}|\\.|.", some):
            if part in known:
                part = known[part] if inside else f"[{known[part]}]"
            elif part == r"\S" and not inside:
                part = "[^" + known[r"\s"] + "]"
            inside = part == "[" or inside and part != "]"
            out += part
        return out

    return written(pattern), written(r" (?=\S)"), written(r" (?=\s|$)"), written(pattern, ascii_)


class Ranks:
    """A vocabulary: bytes of each id, and the id that each mergeable pair of ids becomes.

    Any two tokens whose joined bytes are a token may merge, not only the two it was learnt from.
    """

    def __init__(self, tables: dict) -> None:
        self.__dict__.update(tables)

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Ranks:
        self = cls({})
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.becomes = np.array([pairs[k] for k in keys.tolist()] + [-1], np.int64)
        # Tokens that can merge further into a token of lower rank: there, one merge at a time.
        made = self.becomes[:-1]
        lower = np.unique(np.concatenate([part[part > made] for part in (keys // self.size, keys % self.size)]))
        self.steps_back = np.zeros(self.size, bool)
        self.steps_back[lower] = True
        return self

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged token, -1 if the two don't merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.becomes[at], -1)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file of lines ``base64 rank``; a vocabulary is small and bounded."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def replay(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and where each word begins in it (one more entry)."""
    data = np.frombuffer(b"".join(words), np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    n = len(data)
    token = ranks.single[data]
    after = np.arange(1, n + 1, dtype=np.int64)
    before = np.arange(-1, n - 1, dtype=np.int64)
    filled = edges[:-1][np.diff(edges) > 0]
    before[filled] = -1
    after[np.concatenate((filled[1:], [n]))[: len(filled)] - 1] = -1
    alive = np.ones(n, bool)
    merged = np.zeros(n + 1, bool)
    rank = np.full(n, -1, np.int64)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = ranks.pair(token[inner], token[after[inner]])
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(positions: np.ndarray) -> None:
        positions = positions[rank[positions] >= 0]
        if not len(positions):
            return
        order = np.argsort(rank[positions], kind="stable")
        positions = positions[order]
        key = rank[positions]
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for r, part in zip(key[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts) if len(cuts) else [positions], strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(waiting, r)

    enter(inner)
    while waiting:
        r = heapq.heappop(waiting)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[rank[at] == r]
        if not len(at):
            continue
        at = np.sort(at)
        if len(parts) > 1:
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        if ranks.steps_back[r]:
            # The leftmost one of each word now, the others after what follows from it.
            word = np.searchsorted(edges, at, "right")
            leftmost = np.concatenate(([True], word[1:] != word[:-1]))
            at, rest = at[leftmost], at[~leftmost]
        else:
            rest = at[:0]
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            if chained.any():
                # Overlapping pairs: every second one of a run, from its left end.
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - run) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        token[at] = r
        alive[gone] = False
        rank[gone] = -1
        after[at] = beyond
        follows = beyond >= 0
        before[beyond[follows]] = at[follows]
        rank[at] = -1
        right = at[follows]
        rank[right] = ranks.pair(token[right], token[after[right]])
        left = before[at]
        merged[at] = True
        left = left[(left >= 0) & ~merged[left]]  # those that merged too are in right
        merged[at] = False
        rank[left] = ranks.pair(token[left], token[after[left]])
        if len(rest):
            rest = rest[rank[rest] == r]
        enter(np.concatenate((right, left, rest)))
    at = np.flatnonzero(alive)
    return token[at], np.searchsorted(at, edges)


class Encoder:
    """Encodes texts of one task; remembers the ids of distinct chunks.

    A chunk begins at the start of a text and at every space that stands before a character other
    than white space. No match of the pattern crosses such a place, and what it matches on one side
    does not depend on the other, so chunks are encoded alone.
    """

    def __init__(self, ranks: Ranks, patterns: tuple[str, str, str, str]) -> None:
        """``patterns``: those of ``explicit``."""
        self.ranks = ranks
        self.pattern, self.cut, self.spaced, self.ascii = map(re.compile, patterns)
        self.letters = re.compile(f"[{LETTERS}]+")
        self.reset()

    def reset(self) -> None:
        self.number = Numbers()
        self.ids = np.zeros(0, np.int32)
        self.edges = np.zeros(1, np.int64)

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the chunks of all texts, and how many chunks each text has."""
        sequence, counts, number = [], [], self.number.__getitem__
        for text in texts:
            if not text:
                counts.append(0)
                continue
            parts = text.split(" ") if not self.spaced.search(text) else self.cut.split(text)
            # Kept without their leading space. The first one has none: what no other chunk can
            # begin with keeps it apart from them.
            parts[0] = " \n" + parts[0]
            sequence.append(np.fromiter(map(number, parts), np.int32, len(parts)))
            counts.append(len(parts))
        return np.concatenate(sequence) if sequence else np.zeros(0, np.int32), np.array(counts, np.int64)

    def learn(self) -> None:
        """Encode the chunks that have numbers but no ids yet."""
        new = list(self.number)[len(self.edges) - 1 :]
        if not new:
            return
        number, sequence, counts = Numbers(), [], []
        get = number.__getitem__
        for chunk in new:
            if self.letters.fullmatch(chunk):
                sequence.append(get(" " + chunk))
                counts.append(1)
            else:
                found = (self.ascii if chunk.isascii() else self.pattern).findall(chunk[2:] if chunk.startswith(" \n") else " " + chunk)
                counts.append(len(found))
                sequence += map(get, found)
        ids, edges = replay(self.ranks, [w.encode("utf-8", "surrogatepass") for w in number])
        ids, lengths = joined(ids, edges, np.array(sequence, np.int64))
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts, dtype=np.int64)]
        self.edges = np.concatenate((self.edges, len(self.ids) + ends))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))

    def ids_of(self, sequence: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered texts in one array, and the number of ids of each text."""
        ids, lengths = joined(self.ids, self.edges, sequence)
        total = np.concatenate(([0], np.cumsum(lengths)))
        return ids, np.diff(total[np.concatenate(([0], np.cumsum(counts)))])


def joined(values: np.ndarray, edges: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``values[edges[i]:edges[i + 1]]`` for each i of ``sequence``, and their lengths."""
    start = edges[sequence]
    lengths = edges[sequence + 1] - start
    to = np.cumsum(lengths)
    total = int(to[-1]) if len(to) else 0
    return values[np.arange(total) - np.repeat(to - lengths - start, lengths)], lengths


def _mapper(ranks, pattern: str, text_col: str, names: list[str], schema: pa.Schema):
    patterns = explicit(pattern)

    def run(batches):
        encoder = Encoder(Ranks(ranks.value), patterns)
        for whole in batches:
            for low, high in slices(utf8(whole.column(text_col))[1], LEARNT):
                batch = whole.slice(low, high - low)
                column = batch.column(text_col)
                if len(encoder.number) > REMEMBERED:
                    encoder.reset()
                parts = []
                for first, last in slices(utf8(column)[1], BATCH):
                    parts.append((first, last, *encoder.numbered(column.slice(first, last - first).to_pylist())))
                encoder.learn()
                for first, last, sequence, counts in parts:
                    ids, long = encoder.ids_of(sequence, counts)
                    offsets = np.concatenate(([0], np.cumsum(long))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                    part = batch.slice(first, last - first)
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists], schema=schema)

    return run


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids_col``, the token ids of ``text_col``; a column of that name is replaced."""
    spark = docs.sparkSession
    docs = docs.drop(ids_col)
    shared = spark.sparkContext.broadcast(vars(Ranks.of(read_ranks(path))))
    out = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    return docs.mapInArrow(tidied(_mapper(shared, pattern, text_col, docs.columns, to_arrow_schema(out))), out)


def _decoder(tokens, names: list[str], ids_col: str, schema: pa.Schema):
    def run(batches):
        get = tokens.value.__getitem__
        for batch in batches:
            lists = batch.column(ids_col)
            for row in range(0, len(batch), 256):
                decoded = [b"".join(map(get, x or ())) for x in lists.slice(row, 256).to_pylist()]
                part = batch.slice(row, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(decoded, pa.binary())], schema=schema)

    return run


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with ``bytes_col``, the bytes that the ids of ``ids_col`` stand for (null: no ids)."""
    spark = docs.sparkSession
    docs = docs.drop(bytes_col)
    shared = spark.sparkContext.broadcast({i: t for t, i in read_ranks(path).items()})
    out = T.StructType([*docs.schema.fields, T.StructField(bytes_col, T.BinaryType())])
    return docs.mapInArrow(tidied(_decoder(shared, docs.columns, ids_col, to_arrow_schema(out))), out)


def _checker(tokens, text_col: str, ids_col: str, names: list[str], schema: pa.Schema):
    def run(batches):
        get = tokens.value.__getitem__
        for batch in batches:
            for row in range(0, len(batch), 256):
                part = batch.slice(row, 256)
                texts, ids = part.column(text_col).to_pylist(), part.column(ids_col).to_pylist()
                same = [b"".join(map(get, x)) == (t or "").encode("utf-8", "surrogatepass") for t, x in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(same, pa.bool_())], schema=schema)

    return run


def encode_and_check(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with ``token_ids`` of ``text``, and ``round_trip``: whether they decode to it again.

    Both are one Python step, so that a task has one worker.
    """
    docs = docs.drop("token_ids", "round_trip")
    ranks = read_ranks(path)
    context = docs.sparkSession.sparkContext
    tables, tokens = context.broadcast(vars(Ranks.of(ranks))), context.broadcast({i: t for t, i in ranks.items()})
    coded = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))])
    out = T.StructType([*coded.fields, T.StructField("round_trip", T.BooleanType())])
    encoded = _mapper(tables, pattern, "text", docs.columns, to_arrow_schema(coded))
    checked = _checker(tokens, "text", "token_ids", coded.names, to_arrow_schema(out))
    return docs.mapInArrow(tidied(lambda batches: checked(encoded(batches))), out)


def _digest(ids, decoded):
    def hexes(batches):
        for batch in batches:
            for row in range(0, len(batch), 256):
                part = batch.slice(row, 256)
                lists = part.column(ids)
                values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array([hashlib.sha256(values[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in part.column(decoded).to_pylist()]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return hexes


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, text)`` encoded and decoded: number and digest of the ids, digest of the decoded bytes.

    Encoder, decoder and digests are one Python step, so that ids and bytes stay where they are made.
    """
    ranks = read_ranks(path)
    context = docs.sparkSession.sparkContext
    tables, tokens = context.broadcast(vars(Ranks.of(ranks))), context.broadcast({i: t for t, i in ranks.items()})
    kind = pa.schema([("doc_id", to_arrow_schema(docs.select("doc_id").schema).field(0).type), ("token_ids", pa.list_(pa.int32()))])
    encoded = _mapper(tables, pattern, "text", ["doc_id"], kind)
    decoded = _decoder(tokens, ["doc_id", "token_ids"], "token_ids", kind.append(pa.field("decoded", pa.binary())))
    digest = _digest("token_ids", "decoded")
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(tidied(lambda batches: digest(decoded(encoded(batches)))), columns)


ship_with_tasks(__name__)
