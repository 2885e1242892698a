"""A stored full-text index in blocks, searched without summing every posting.

Chunks are numbered as they are stored; 64 neighbours are a slot. A block holds the postings of one token
in one slot: which of the 64 chunks have it, as the bits of one long, the largest weight that any of them
gives it, and the postings themselves. Blocks are stored packed, many slots of a token in a row (a span), and
made from the spans of the tokens asked for. From the first two alone, without a posting, a search knows how many
chunks a query hits, which of them lie in its scope, and what a slot can score at most. It scores the most
promising slots of each query first; the k-th best score found there is a threshold, and blocks of slots
that cannot reach it are never read.

The same slots serve searches for substrings: each run of word characters or of others has a row per slot
with the bits of its chunks, and the character pairs of the distinct runs lead from a phrase to the runs
that hold it. Only a phrase of several runs is looked up in the texts, and only in those it may be in.

Tables lie in folders by a hash of what they are looked up by; a search collects the few folder numbers it
needs and reads no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import patterns as P
from quire.functions.text import let
from quire.functions.tokens import LATIN_RUN, index_tokens, longest, query_tokens
from quire.operators.retrieval import K1, RUNS, B, fallback_phrases
from quire.session import exists, ship_with_tasks, written

#: Bits of a slot: 64 chunks, so that a set of them is one long.
SLOT_BITS = 6
#: Postings that a file of the index holds, about; folders there are at least, and slots per query that are
#: scored to find its threshold.
ROWS_PER_FILE, LEAST_PARTS, AHEAD = 1_000_000, 8, 12
#: Characters of text for each posting, about, and postings after which a row of ``spans`` ends.
CHARS_PER_POSTING, SPAN = 8, 1024
#: Distinct phrases, words and others, up to which a search for substrings makes no tables of its own: a word
#: is compared with every distinct token, another phrase with every text.
FEW_WORDS, FEW_OTHERS = 2048, 32
#: Scores are rounded to six digits; what may round up to the threshold is kept.
MARGIN = 2e-6
#: Stands after the last character of a run, so that each character begins a pair.
END = "\x00"


#: Blocks as a search sees them: made from spans, whose rows hold the postings of many slots.
BLOCKS = "token string, slot bigint, mask bigint, top double, postings array<bigint>"
#: The stored tables: chunks, spans of tokens, chunks and places per token, ends of the slots, blocks of runs,
#: character pairs.
SCHEMAS = {
    "entries": "number bigint, chunk_id bigint, book_id bigint, chapter_id bigint, content string, chars int, piece bigint",
    "spans": "token string, first bigint, places array<int>, postings array<bigint>, n bigint, part int",
    "frequency": "token string, df bigint, cf bigint",
    "slots": "slot bigint, low bigint, high bigint, chunks array<struct<place: int, chunk_id: bigint, book_id: bigint>>, piece bigint",
    "runs": "run string, slot bigint, mask bigint, part int",
    "pairs": "pair string, run string, part int",
}


@dataclass
class BlockIndex:
    """The tables of ``SCHEMAS`` below ``path``."""

    spark: SparkSession
    path: str
    parts: int
    n_docs: int
    avgdl: float
    postings: int
    phrases: bool = False

    def table(self, name: str) -> DataFrame:
        if name == "blocks":
            return self.blocks(self.table("spans"))
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def blocks(self, spans: DataFrame) -> DataFrame:
        """The rows of ``BLOCKS`` in some rows of ``spans``."""
        return spans.select("token", "first", "places", "postings").mapInArrow(_unpacked(self.avgdl), BLOCKS)

    def of(self, name: str, keys: DataFrame, key: Column) -> DataFrame:
        """The rows of a table in the folders of ``key``, at most ``parts`` numbers that are collected."""
        needed = [r[0] for r in keys.select(part_of(key, self.parts)).distinct().collect()]
        return self.table(name).filter(F.col("part").isin(needed)).drop("part")

    def near(self, name: str, slots: DataFrame) -> DataFrame:
        """The rows of ``entries`` or ``slots`` among which those of ``slots(slot)`` are, by the folders of the
        tasks that wrote them."""
        needed = [r[0] for r in slots.select(F.shiftright("slot", 33 - SLOT_BITS)).distinct().collect()]
        return self.table(name).filter(F.col("piece").isin(needed)).drop("piece")

    def scope(self, scopes: DataFrame, books: DataFrame, links: DataFrame) -> Scope:
        return Scope.of(self, scopes, books, links)

    def search(self, queries: DataFrame, k: int, scope: Scope | None = None) -> Found:
        return search(queries, self, k, scope)

    def substrings(self, queries: DataFrame, limit: int = P.TOP_K, scope: Scope | None = None) -> DataFrame:
        return substrings(queries, self, limit, scope)


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def slot() -> Column:
    return F.shiftright("number", SLOT_BITS)


def bit() -> Column:
    """The bit of a chunk in its slot."""
    return F.expr(f"shiftleft(1L, CAST(number & {(1 << SLOT_BITS) - 1} AS INT))")


def has(mask: str, place: str) -> Column:
    return F.expr(f"(shiftright({mask}, {place}) & 1) = 1")


#: A posting is one number: six bits of place, 26 of how often the token occurs, the rest the length of the chunk.
PLACE, TF, DL = "CAST(p & 63 AS INT)", "(shiftright(p, 6) & 67108863)", "shiftright(p, 32)"


def weight(tf: Column | np.ndarray, dl: Column | np.ndarray, avgdl: float) -> Column | np.ndarray:
    """What a posting adds to a score, but for the rarity of its token."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _dealt(df: DataFrame, key: Column, spread: Column, rows: int, parts: int) -> DataFrame:
    """Deal rows to folders by ``key``, each in pieces by ``spread``, so that a key of most rows is no single
    task."""
    pieces = rows // (parts * ROWS_PER_FILE) + 1
    placed = df.withColumn("part", part_of(key, parts)).withColumn("piece", F.pmod(F.xxhash64(spread), F.lit(pieces)))
    return placed.repartition(parts * pieces, "part", "piece")


def _store(df: DataFrame, path: str, *order: str) -> None:
    df.sortWithinPartitions("part", *order).write.mode("overwrite").partitionBy("part").parquet(path)


def _blocks(names: list[str], avgdl: float | None = None, postings: bool = False):
    """Blocks of the chunks of a task, ``(number, keys)`` as they are stored: per key and slot its bits and, with
    ``avgdl``, its largest weight and its postings, or with ``postings`` those alone.

    The chunks of a slot lie side by side, so what leaves the task is a block and not a posting.
    """
    least = (1 << SLOT_BITS) - 1

    def grouped(table: pa.Table) -> pa.RecordBatch:
        number, lists = table["number"].to_numpy(), table["keys"].combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        keys = pc.dictionary_encode(lists.flatten())
        slots, of = np.unique(number >> SLOT_BITS, return_inverse=True)
        cell, n_keys = (of << SLOT_BITS) | (number & least), max(len(keys.dictionary), 1)
        at_cell = np.repeat(cell, lengths)
        posting = (((at_cell >> SLOT_BITS) * n_keys + keys.indices.to_numpy()) << SLOT_BITS) | (at_cell & least)
        each, tf = np.unique(posting, return_counts=True)
        place, block = each & least, each >> SLOT_BITS
        at = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
        columns = [keys.dictionary.take(pa.array(block[at] % n_keys)), pa.array(slots[block[at] // n_keys])]
        columns.append(pa.array(np.bitwise_or.reduceat(np.left_shift(np.int64(1), place), at) if len(at) else place))
        if avgdl is not None or postings:
            size = np.zeros(len(slots) << SLOT_BITS, np.int64)
            size[cell] = lengths
            dl = size[((block // n_keys) << SLOT_BITS) | place]
            p = place | (tf.astype(np.int64) << 6) | (dl << 32)
            if avgdl is not None:
                weight_ = weight(tf, dl, avgdl)
                columns.append(pa.array(np.maximum.reduceat(weight_, at) if len(at) else weight_))
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(p)).astype(np.int32)), pa.array(p)))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            # The last slot may go on in the next batch.
            slots = table["number"].to_numpy() >> SLOT_BITS
            before = np.flatnonzero(slots != slots[-1]) if len(slots) else slots
            end = before[-1] + 1 if len(before) else 0
            if end:
                yield grouped(table.slice(0, end))
            rest = table.slice(end)
        if rest is not None and len(rest):
            yield grouped(rest)

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task packed by token: one row for all slots of a batch, cut after ``SPAN`` postings.

    Most blocks hold one posting. A row for each would be ten times as many rows to shuffle and sort.
    """
    for batch in _blocks(["token", "slot", "mask", "postings"], postings=True)(batches):
        tokens = batch["token"].dictionary_encode()
        order = np.argsort(tokens.indices.to_numpy(), kind="stable")
        token, slots = tokens.indices.to_numpy()[order], batch["slot"].to_numpy()[order]
        lists = batch["postings"].take(pa.array(order))
        lengths, p = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
        if not len(p):
            continue
        ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
        new = np.append(True, token[1:] != token[:-1])
        begin = ends[:-1][new][np.cumsum(new) - 1]
        # Numbers of another piece lie too far away for a place.
        cut = np.stack([token, slots >> (33 - SLOT_BITS), (ends[:-1] - begin) // SPAN])
        at = np.flatnonzero(np.append(True, (cut[:, 1:] != cut[:, :-1]).any(axis=0)))
        first = slots[at]
        away = slots - np.repeat(first, np.diff(np.append(at, len(slots))))
        places = ((np.repeat(away, lengths) << SLOT_BITS) | (p & 63)).astype(np.int32)
        offsets = np.append(ends[at], len(p)).astype(np.int32)
        n = np.add.reduceat((p >> 6) & 67108863, offsets[:-1])
        columns = [tokens.dictionary.take(pa.array(token[at])), pa.array(first), pa.ListArray.from_arrays(offsets, pa.array(places)),
                   pa.ListArray.from_arrays(offsets, pa.array(p)), pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "first", "places", "postings", "n"])


def _unpacked(avgdl: float):
    """The blocks in rows of ``spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch["places"]).to_numpy()
            p, places = batch["postings"].flatten().to_numpy(), batch["places"].flatten().to_numpy().astype(np.int64)
            if not len(p):
                continue
            row = np.repeat(np.arange(len(lengths)), lengths)
            slots = batch["first"].to_numpy()[row] + (places >> SLOT_BITS)
            at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (slots[1:] != slots[:-1])))
            mask = np.bitwise_or.reduceat(np.left_shift(np.int64(1), p & 63), at)
            top = np.maximum.reduceat(weight((p >> 6) & 67108863, p >> 32, avgdl), at)
            postings = pa.ListArray.from_arrays(np.append(at, len(p)).astype(np.int32), pa.array(p))
            columns = [batch["token"].take(pa.array(row[at])), pa.array(slots[at]), pa.array(mask), pa.array(top), postings]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "slot", "mask", "top", "postings"])

    return run


def write_index(chunks: DataFrame, path: str, terms: list[str] = P.SUBJECT_TERMS) -> BlockIndex:
    """Store the index of ``chunks(chunk_id, book_id, content)`` and, if they have it, their ``chapter_id``.

    The corpus is read once and its words are found once, in the stored chunks. Folders and their pieces follow
    from the number of characters. What searches for substrings need is added by the first one that has many
    phrases, or by ``write_phrases``.
    """
    spark = chunks.sparkSession
    if "chapter_id" not in chunks.columns:
        chunks = chunks.withColumn("chapter_id", F.lit(None).cast("bigint"))
    numbered = chunks.select(F.monotonically_increasing_id().alias("number"), "chunk_id", "book_id", "chapter_id", "content", F.length("content").alias("chars"))
    numbered.withColumn("piece", F.shiftright("number", 33)).write.mode("overwrite").partitionBy("piece").parquet(f"{path}/entries")
    entries = spark.read.schema(SCHEMAS["entries"]).parquet(f"{path}/entries")
    n_docs, chars = entries.agg(F.count("*"), F.sum("chars")).first()
    expected = (chars or 0) // CHARS_PER_POSTING
    parts = max(LEAST_PARTS, min(4096, expected // ROWS_PER_FILE))

    each = entries.select("number", index_tokens(F.col("content"), terms).alias("keys"))
    made = each.mapInArrow(_spans, SCHEMAS["spans"].removesuffix(", part int"))
    _store(_dealt(made, F.col("token"), F.col("first"), expected, parts).drop("piece"), f"{path}/spans", "token", "first")
    counts = spark.read.schema(SCHEMAS["spans"]).parquet(f"{path}/spans").groupBy("token").agg(F.sum(F.size("postings")).alias("df"), F.sum("n").alias("cf"))
    counts.write.mode("overwrite").parquet(f"{path}/frequency")
    tokens, postings = spark.read.schema(SCHEMAS["frequency"]).parquet(f"{path}/frequency").agg(F.sum("cf"), F.sum("df")).first()
    avgdl = (tokens or 0) / n_docs if n_docs else 0.0
    index = BlockIndex(spark, path, parts, n_docs, avgdl, postings or 0)
    place = F.expr(f"CAST(number & {(1 << SLOT_BITS) - 1} AS INT)").alias("place")
    members = F.array_sort(F.collect_list(F.struct(place, "chunk_id", "book_id")))
    ends = entries.groupBy("piece", slot().alias("slot")).agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"), members.alias("chunks"))
    ends.write.mode("overwrite").partitionBy("piece").parquet(f"{path}/slots")
    stats = spark.createDataFrame([(parts, n_docs, avgdl, postings or 0)], "parts int, n_docs bigint, avgdl double, postings bigint")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return index


def write_phrases(index: BlockIndex) -> None:
    """Store what searches for substrings need: the runs of characters and the pairs in them."""
    found = F.regexp_extract_all(F.lower("content"), F.lit(RUNS), F.lit(0))
    each = index.table("entries").select("number", found.alias("keys"))
    bits = each.mapInArrow(_blocks(["run", "slot", "mask"]), SCHEMAS["runs"].removesuffix(", part int"))
    _store(_dealt(bits, F.col("run"), F.col("slot"), index.postings, index.parts).drop("piece"), f"{index.path}/runs", "run")
    vocabulary = index.table("runs").select("run").distinct()
    closed = F.concat("run", F.lit(END))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.substring(closed, i, 2)))
    each = vocabulary.select("run", F.explode(pairs).alias("pair"))
    _store(_dealt(each, F.substring("pair", 1, 1), F.col("run"), index.postings, index.parts).drop("piece"), f"{index.path}/pairs", "pair")
    index.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/phrases")  # all are there
    index.phrases = True


def read_index(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(spark, path, *spark.read.parquet(f"{path}/stats").first(), exists(spark, f"{path}/phrases"))


def scope_masks(index: BlockIndex, scopes: DataFrame, books: DataFrame, links: DataFrame) -> DataFrame:
    """``(query_id, slot, allowed)``: the chunks in the scope of each query that has one, as bits.

    ``scopes(query_id, book_ids, category, tag_id)`` and perhaps ``chapter_id``; null leaves a dimension
    open, an empty list or intersection has no row. Each category, tag and chapter that is asked for is
    one set of bits, whoever asks; the sets of a query's dimensions are cut with each other.
    """
    placed = index.table("entries").select("book_id", "chapter_id", slot().alias("slot"), bit().alias("bit"))
    asked = {
        "book_ids": (F.explode("book_ids"), placed.withColumnRenamed("book_id", "wanted")),
        "category": (F.col("category"), placed.join(books.select("book_id", F.col("category").alias("wanted")), "book_id")),
        "tag_id": (F.col("tag_id"), placed.join(links.select("book_id", F.col("tag_id").alias("wanted")).distinct(), "book_id")),
        "chapter_id": (F.col("chapter_id"), placed.withColumnRenamed("chapter_id", "wanted")),
    }
    sets = None
    for name, (value, members) in asked.items():
        if name not in scopes.columns:
            continue
        wanted = written(scopes.filter(F.col(name).isNotNull()).select("query_id", value.alias("wanted")).distinct(), f"scope-{name}")
        bits = members.join(wanted.select("wanted").distinct(), "wanted", "left_semi").groupBy("wanted", "slot").agg(F.bit_or("bit").alias("bits"))
        one = wanted.join(bits, "wanted").groupBy("query_id", "slot").agg(F.bit_or("bits").alias("bits"))
        sets = one if sets is None else sets.unionByName(one)
    cut = sets.groupBy("query_id", "slot").agg(F.bit_and("bits").alias("allowed"), F.count("*").alias("n"))
    return cut.join(_dimensions(scopes), "query_id").filter((F.col("n") == F.col("dimensions")) & (F.col("allowed") != 0)).select("query_id", "slot", "allowed")


def _dimensions(scopes: DataFrame) -> DataFrame:
    given = sum(F.col(c).isNotNull().cast("int") for c in ("book_ids", "category", "tag_id", "chapter_id") if c in scopes.columns)
    return scopes.select("query_id", given.alias("dimensions"))


@dataclass
class Scope:
    """Scopes of queries, made bits once for all searches of a batch."""

    masks: DataFrame
    limited: DataFrame

    @classmethod
    def of(cls, index: BlockIndex, scopes: DataFrame, books: DataFrame, links: DataFrame) -> Scope:
        limited = written(_dimensions(scopes).filter("dimensions > 0").select("query_id"), "limited")
        return cls(written(scope_masks(index, scopes, books, links), "scope"), limited)

    def cut(self, hits: DataFrame) -> DataFrame:
        """``hits(query_id, slot, mask)`` without chunks out of scope."""
        open_ = hits.join(self.limited, "query_id", "left_anti")
        inside = hits.join(self.masks, ["query_id", "slot"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("allowed"))).drop("allowed")
        return open_.unionByName(inside).filter("mask <> 0")


@dataclass
class Found:
    """Results of a search: the best hits, how many there are, the slots with hits, and those that were scored."""

    top: DataFrame
    totals: DataFrame
    slots: DataFrame
    scored: DataFrame


def search(queries: DataFrame, index: BlockIndex, k: int, scope: Scope | None = None) -> Found:
    """The ``k`` best chunks of each query by BM25, ``(query_id, chunk_id, book_id, score, rank)``; ties to
    the smaller id."""
    wanted = queries.select("query_id", F.explode(query_tokens(F.col("text"))).alias("token"))
    rarity = F.greatest(F.log((index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighted = written(wanted.join(index.table("frequency"), "token").select("query_id", "token", rarity.alias("idf")), "weights")
    # Blocks of the tokens asked for are read once; joined by token and slot, every block of their folders would move.
    asked = weighted.select("token").distinct()
    blocks = written(index.blocks(index.of("spans", weighted, F.col("token")).join(asked, "token", "left_semi")), "asked-blocks")
    heads = blocks.select("token", "slot", "mask", "top").join(weighted, "token")
    slots = heads.groupBy("query_id", "slot").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"), F.bit_or("mask").alias("mask"))
    slots = written(scope.cut(slots) if scope else slots, "slots")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "slot"))
    ahead = slots.withColumn("n", order).filter(F.col("n") <= max(AHEAD, k)).drop("n")

    def scored(some: DataFrame) -> DataFrame:
        tokens = written(some.select("query_id", "slot", F.col("mask").alias("kept")).join(weighted, "query_id"), "tokens")
        wanted = blocks.select("token", "slot", "postings").join(tokens, ["token", "slot"])
        hits = wanted.select("query_id", "slot", "kept", "idf", F.explode("postings").alias("p")).filter(has("kept", PLACE))
        value = F.col("idf") * weight(F.expr(TF), F.expr(DL), index.avgdl)
        return hits.groupBy("query_id", "slot", F.expr(PLACE).alias("place")).agg(F.round(F.sum(value), 6).alias("score"))

    first = written(scored(ahead), "first")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    least = first.withColumn("n", best).filter(F.col("n") == k).select("query_id", F.col("score").alias("least"))
    rest = slots.join(ahead.select("query_id", "slot"), ["query_id", "slot"], "left_anti").join(least, "query_id", "left")
    rest = rest.filter(F.col("least").isNull() | (F.col("bound") + MARGIN >= F.col("least"))).select("query_id", "slot", "mask")
    every = first.unionByName(scored(rest)).join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("score") >= F.col("least")))
    # Numbers follow each other without a gap within a task, so the places of a slot are 0, 1, 2 and so on.
    chunk = F.element_at("chunks", F.col("place") + 1)
    named = index.near("slots", slots).select("slot", "chunks").join(every, "slot").select("query_id", "score", chunk.alias("c"))
    named = named.select("query_id", "c.chunk_id", "c.book_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return Found(
        named.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k),
        slots.groupBy("query_id").agg(F.sum(F.bit_count("mask")).alias("total")),
        slots,
        ahead.select("query_id", "slot").unionByName(rest.select("query_id", "slot")),
    )


def substrings(queries: DataFrame, index: BlockIndex, limit: int = P.TOP_K, scope: Scope | None = None) -> DataFrame:
    """Chunks that contain a fallback phrase of the query, lowest chunk ids first.

    A few phrases are looked up among the tokens and in the texts. For many, or once the tables for it are stored:
    every run of characters of a phrase lies inside one run of the text, so a phrase of one run is looked
    up among the distinct runs, through the rarest of its character pairs, and has its chunks from their
    bits. Of longer phrases, the texts that hold all of their runs are read.
    """
    found = fallback_phrases(queries)
    if not index.phrases:
        found = written(found, "phrases")
        is_word = F.col("phrase").rlike(rf"\A{LATIN_RUN}\z")
        each = found.select("phrase", is_word.alias("is_word")).distinct()
        words, others = each.agg(F.count_if("is_word"), F.count_if(~F.col("is_word"))).first()
        if words <= FEW_WORDS and others <= FEW_OTHERS:
            hits = found.select("query_id", "phrase", F.lit(1).alias("n_pieces")).join(_few(each, index, others), "phrase")
            return _first_chunks(hits, index, limit, scope)
        write_phrases(index)
    cut = F.regexp_extract_all("phrase", F.lit(RUNS), F.lit(0))
    phrases = found.select("query_id", "phrase", F.array_distinct(cut).alias("pieces"))
    phrases = written(phrases.withColumn("n_pieces", F.size("pieces")), "phrases")
    pieces = written(phrases.select(F.explode("pieces").alias("piece")).distinct(), "pieces")
    at = F.sequence(F.lit(1), F.greatest(F.length("piece") - 1, F.lit(1)))
    asked = written(pieces.select("piece", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("piece", i, 2)))).alias("key")), "asked")
    table = index.of("pairs", asked, F.substring("key", 1, 1))
    # A piece of one character is found by the pairs that begin with it.
    matching = table.join(asked.select("key").distinct(), (F.col("pair") == F.col("key"))).select("key", "run").unionByName(
        table.join(asked.filter("length(key) = 1").select("key").distinct(), F.substring("pair", 1, 1) == F.col("key")).select("key", "run")
    )
    sizes = matching.groupBy("key").agg(F.count("*").alias("n"))
    rarest = asked.join(sizes, "key").groupBy("piece").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    runs = written(rarest.join(matching, "key").filter(F.contains("run", "piece")).select("piece", "run").distinct(), "found-runs")
    bits = index.of("runs", runs, F.col("run")).join(runs, "run").groupBy("piece", "slot").agg(F.bit_or("mask").alias("mask"))
    bits = written(bits, "piece-bits")
    each = phrases.select("query_id", "phrase", "n_pieces", F.explode("pieces").alias("piece")).join(bits, "piece")
    hits = each.groupBy("query_id", "phrase", "n_pieces", "slot").agg(F.bit_and("mask").alias("mask"), F.count("*").alias("n")).filter("n = n_pieces AND mask <> 0")
    return _first_chunks(hits, index, limit, scope)


def _few(phrases: DataFrame, index: BlockIndex, others: int) -> DataFrame:
    """``(phrase, slot, mask)`` of a few ``phrases(phrase, is_word)``, without the tables of ``write_phrases``.

    A word stands where a token holds it, so it is looked up among the distinct tokens and has its chunks from
    their blocks. Any other phrase is looked up in every text.
    """
    words = F.broadcast(phrases.filter("is_word").select("phrase"))
    tokens = written(index.table("frequency").select("token").join(words, F.contains("token", "phrase")), "found-tokens")
    spans = index.of("spans", tokens, F.col("token")).join(tokens.select("token").distinct(), "token", "left_semi")
    bits = index.blocks(spans).select("token", "slot", "mask").join(tokens, "token").select("phrase", "slot", "mask")
    if others:
        rest = F.broadcast(phrases.filter("NOT is_word").select("phrase"))
        texts = index.table("entries").select(slot().alias("slot"), bit().alias("mask"), F.lower("content").alias("text"))
        bits = bits.unionByName(texts.join(rest, F.contains("text", "phrase")).select("phrase", "slot", "mask"))
    return bits.groupBy("phrase", "slot").agg(F.bit_or("mask").alias("mask"))


def _first_chunks(hits: DataFrame, index: BlockIndex, limit: int, scope: Scope | None) -> DataFrame:
    """The chunks of lowest ids in ``hits(query_id, phrase, n_pieces, slot, mask)``; texts decide on phrases of
    several runs."""
    hits = written((scope.cut(hits) if scope else hits).select("query_id", "phrase", "n_pieces", "slot", "mask"), "phrase-hits")
    hits = hits.join(index.near("slots", hits).select("slot", "low", "high"), "slot")
    # The chunks of a phrase of one run, or of one found, are hits for sure: none beyond the slots that surely hold the first ones.
    so_far = F.sum(F.bit_count("mask")).over(Window.partitionBy("query_id", "phrase").orderBy("high").rangeBetween(Window.unboundedPreceding, 0))
    enough = F.min(F.when(F.col("so_far") >= limit, F.col("high"))).over(Window.partitionBy("query_id", "phrase"))
    first = hits.withColumn("so_far", so_far).withColumn("enough", enough).filter("n_pieces > 1 OR enough IS NULL OR low <= enough")
    # Of each slot, the chunks whose bits are set.
    first = written(first.select("query_id", "phrase", "n_pieces", "slot", "mask"), "phrase-slots")
    first = first.join(index.near("slots", first).select("slot", "chunks"), "slot")
    held = F.expr("explode(filter(chunks, c -> (shiftright(mask, c.place) & 1) = 1)) AS c")
    chunks = written(first.select("query_id", "phrase", "n_pieces", "slot", held).select("query_id", "phrase", "n_pieces", "slot", "c.chunk_id"), "phrase-chunks")
    whole = chunks.filter("n_pieces = 1").select("query_id", "chunk_id")
    several = chunks.filter("n_pieces > 1")
    if not several.isEmpty():
        texts = index.near("entries", several).select("chunk_id", "content").join(several, "chunk_id")
        whole = whole.unionByName(texts.filter(F.contains(F.lower("content"), F.col("phrase"))).select("query_id", "chunk_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    return whole.distinct().withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= limit)


ship_with_tasks(__name__)
