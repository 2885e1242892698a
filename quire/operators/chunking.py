"""Cutting books into chunks.

The pages of a chapter come in order to one task, a row at a time; what is kept of a book is the chunk that
is open. So no book and no chapter is put together in a row or in memory, whatever its size. Pages meet the
intervals of their chapters by book and page, and then travel once, to the order of their book.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import patterns as P
from quire.functions.text import strip
from quire.session import ship_with_tasks


def split_paragraphs(text: Column, limit: int = P.PARAGRAPH_LIMIT) -> Column:
    """Paragraphs at blank lines; longer ones are cut after sentence marks and packed greedily."""

    def pack(acc: Column, part: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when(F.length(last) + F.length(part) > limit, F.concat(acc, F.array(part))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, part)))
        )

    def cut(paragraph: Column) -> Column:
        parts = F.split(paragraph, rf"(?<=[。！？；])[{P.SPACE}]*")
        return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(
            F.aggregate(parts, F.array(F.lit("")), pack)
        )

    raw = F.filter(F.transform(F.split(text, rf"\n[{P.SPACE}]*\n"), strip), lambda p: p != "")
    return F.filter(F.transform(F.flatten(F.transform(raw, cut)), strip), lambda p: p != "")


#: First page, last page and text of a chunk.
Chunk = tuple[int, int, str]


class Paragraphs:
    """Adds paragraphs while the sum of their lengths stays within the limit."""

    def __init__(self, limit: int = P.PARAGRAPH_LIMIT) -> None:
        self.limit, self.texts, self.size, self.first, self.last = limit, [], 0, 0, 0

    def add(self, page: int, text: str) -> list[Chunk]:
        closed = self.end() if self.texts and self.size + len(text) > self.limit else []
        if not self.texts:
            self.first, self.size = page, 0
        self.texts.append(text)
        self.size, self.last = self.size + len(text), page
        return closed

    def end(self) -> list[Chunk]:
        closed = [(self.first, self.last, "\n\n".join(self.texts))] if self.texts else []
        self.texts = []
        return closed


class Windows:
    """Adds whole pages while they fit into the size, and begins the next chunk with the end of the last;
    a page that is longer is cut into overlapping windows."""

    def __init__(self, size: int = P.WINDOW_SIZE, overlap: int = P.WINDOW_OVERLAP) -> None:
        self.size, self.overlap = size, overlap
        self.step = max(size - overlap, 50)
        self.text, self.length, self.first, self.last = "", 0, 0, 0

    def add(self, page: int, text: str) -> list[Chunk]:
        if not text:
            return []
        if len(text) > self.size:
            return self.end() + self.windows(page, text)
        if self.text and self.length + len(text) + 2 > self.size:
            kept = self.text[-self.overlap :] if self.overlap > 0 else ""
            begins = self.last if self.overlap > 0 else page
            closed = self.end()
            self.text = f"{kept}\n\n{text}" if self.overlap > 0 else text
            self.length, self.first, self.last = len(kept) + len(text) + 2, begins, page
            return closed
        if not self.text:
            self.text, self.length, self.first = text, 0, page
        else:
            self.text += "\n\n" + text
        self.length, self.last = self.length + len(text) + 2, page
        return []

    def windows(self, page: int, text: str) -> list[Chunk]:
        out = []
        for at in range(0, len(text), self.step):
            cut = text[at : at + self.size].strip(P.SPACE_CHARS)
            if cut and at and len(cut) < self.step * 0.5:
                break
            if cut:
                out.append((page, page, cut))
        return out

    def end(self) -> list[Chunk]:
        closed = [(self.first, self.last, self.text)] if self.text else []
        self.text, self.length = "", 0
        return closed


@dataclass(frozen=True)
class Packer:
    """``items`` cuts the text of a page into what ``fold`` packs, one object for each chapter."""

    items: Callable[[Column], Column]
    fold: Callable[[], Paragraphs | Windows]


pack_paragraphs = Packer(split_paragraphs, Paragraphs)
window_chunks = Packer(lambda text: F.array(strip(text)), Windows)


def _folded(fold: Callable, schema: pa.Schema):
    """Chunks of items that come in the order of book, chapter and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, chapter, state, index, found = None, None, None, 0, []

        def close(chunks: list[Chunk]) -> None:
            nonlocal index
            for first, last, text in chunks:
                found.append((book, index, chapter[2], first, last, text, len(text)))
                index += 1

        def batch_of() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [()] * len(schema)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
            found.clear()
            return made

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("book_id", "start_page", "end_page", "chapter_index", "page", "text")]
            for of, start, end, part, page, text in zip(*names, strict=True):
                if (of, (start, end, part)) != (book, chapter):
                    if state:
                        close(state.end())
                    index = index if of == book else 0
                    book, chapter, state = of, (start, end, part), fold()
                close(state.add(page, text))
            yield batch_of()
        if state:
            close(state.end())
            yield batch_of()

    return run


def chunk_pages(pages: DataFrame, intervals: DataFrame, packer: Packer = pack_paragraphs) -> DataFrame:
    """Chunks of all books with page range, length and a running index per book.

    ``pages(book_id, page, text)``; ``intervals(book_id, chapter_index, start_page, end_page)``, of which
    equal ones count once. Pages shared by a chapter and its section are cut for both. Chunks are numbered
    in the order of their chapters' first pages.
    """
    spans = intervals.select("book_id", "chapter_index", "start_page", "end_page").distinct()
    each = spans.filter("start_page <= end_page").withColumn("page", F.explode(F.sequence("start_page", "end_page")))
    items = pages.select("book_id", "page", F.posexplode(packer.items(F.col("text"))).alias("i", "text"))
    keys = ["book_id", "start_page", F.coalesce("chapter_index", F.lit(-1)), "end_page", "page", "i"]
    ordered = items.join(each, ["book_id", "page"]).repartition("book_id").sortWithinPartitions(*keys)
    book, part = (f.schema[c].dataType.simpleString() for f, c in ((pages, "book_id"), (intervals, "chapter_index")))
    out = f"book_id {book}, chunk_index bigint, chapter_index {part}, page_start bigint, page_end bigint, content string, word_count bigint"
    schema = to_arrow_schema(pages.sparkSession.createDataFrame([], out).schema)
    return ordered.mapInArrow(_folded(packer.fold, schema), out)


def chunk_books(page_arrays: DataFrame, intervals: DataFrame, packer: Packer = pack_paragraphs) -> DataFrame:
    """``chunk_pages`` for books that come with their pages in order as an array."""
    pages = page_arrays.select("book_id", F.posexplode("pages").alias("at", "text"))
    return chunk_pages(pages.select("book_id", (F.col("at") + 1).cast("bigint").alias("page"), "text"), intervals, packer)


ship_with_tasks(__name__)
