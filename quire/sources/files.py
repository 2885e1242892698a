"""Files: routing by type, upload checks, Office text.

The size checks here bound what counts as one book downstream: 200 MB as stored, 500 MB unpacked.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.session import ship_with_tasks

ship_with_tasks(__name__)

# Accepted types and limits.
FILE_TYPES = ["pdf", "docx", "pptx"]
MAX_FILE_BYTES = 200 * 1024 * 1024
MAX_UNPACKED_BYTES = 500 * 1024 * 1024

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content, length)`` of all files below a folder.

    Files above the size limit come without content, which is not read for them; ``check_uploads``
    gives them their verdict.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fitting = files.filter(F.col("length") <= MAX_FILE_BYTES).select("path", "content", "length")
    larger = files.filter(F.col("length") > MAX_FILE_BYTES).select("path", F.lit(None).cast("binary").alias("content"), "length")
    return fitting.unionByName(larger)


def file_type(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route_files(files: DataFrame) -> DataFrame:
    """Add the file type and whether there is a reader for it."""
    return files.withColumn("file_type", file_type(F.col("path"))).withColumn(
        "accepted", F.col("file_type").isin(FILE_TYPES)
    )


def _unpacked_size(content: pd.Series) -> pd.Series:
    def size(data: bytes | None) -> int | None:
        if data is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                return sum(item.file_size for item in archive.infolist())
        except zipfile.BadZipFile:
            return None

    return content.map(size).astype("Int64")


def check_uploads(files: DataFrame) -> DataFrame:
    """Verdict on each routed file: ``ok`` or the reason for its rejection.

    Only Office files with the right first bytes are handed to Python, for their unpacked size.
    """
    office = F.col("file_type").isin("docx", "pptx")
    head = F.hex(F.substring("content", 1, 16))
    is_zip = head.rlike("^504B(0304|0506|0708)")
    # White space before the signature is allowed, as far as the first 16 bytes go.
    is_pdf = head.rlike("^(?:09|0A|0B|0C|0D|20)*255044462D")
    unpacked = F.pandas_udf(_unpacked_size, "bigint")(F.when(office & is_zip, F.col("content")))
    verdict = (
        F.when(~F.col("accepted"), "unsupported type")
        .when(F.col("length") > MAX_FILE_BYTES, "too large")
        .when(F.col("length") == 0, "empty")
        .when(~office, F.when(is_pdf, "ok").otherwise("no PDF signature"))
        .when(~is_zip, "no ZIP signature")
        .when(F.col("unpacked").isNull(), "broken archive")
        .when(F.col("unpacked") > MAX_UNPACKED_BYTES, "unpacks too large")
        .otherwise("ok")
    )
    return files.withColumn("unpacked", unpacked).withColumn("verdict", verdict)


def _run_text(paragraph: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_A}br": "\n"}
    parts = []
    for node in paragraph.iter():
        if node.tag in (f"{_W}t", f"{_A}t"):
            parts.append(node.text or "")
        elif node.tag in marks:
            parts.append(marks[node.tag])
    return "".join(parts)


def _docx_paragraphs(archive: zipfile.ZipFile) -> list[dict]:
    styles = {}
    if "word/styles.xml" in archive.namelist():
        for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
            name = style.find(f"{_W}name")
            styles[style.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None
    body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    rows = []
    for idx, paragraph in enumerate(body.findall(f"{_W}p")):
        mark = paragraph.find(f"{_W}pPr/{_W}pStyle")
        style = "Normal" if mark is None else mark.get(f"{_W}val")
        rows.append({"page": None, "idx": idx, "style": styles.get(style) or style, "text": _run_text(paragraph)})
    return rows


def _slide_text(slide: ElementTree.Element) -> str:
    texts = []
    for shape in slide.iter():
        if shape.tag == f"{_P}sp":
            text = "\n".join(_run_text(p) for p in shape.iter(f"{_A}p")).strip()
            if text:
                texts.append(text)
        elif shape.tag == f"{_A}tr":
            cells = ["\n".join(_run_text(p) for p in cell.iter(f"{_A}p")).strip() for cell in shape.findall(f"{_A}tc")]
            texts.append(" | ".join(cells))
    return "\n".join(texts)


def _pptx_pages(archive: zipfile.ZipFile) -> list[dict]:
    links = {
        item.get("Id"): item.get("Target")
        for item in ElementTree.fromstring(archive.read("ppt/_rels/presentation.xml.rels"))
    }
    order = ElementTree.fromstring(archive.read("ppt/presentation.xml")).iter(f"{_P}sldId")
    rows = []
    for number, item in enumerate(order, 1):
        slide = ElementTree.fromstring(archive.read("ppt/" + links[item.get(f"{_R}id")].removeprefix("/ppt/")))
        rows.append({"page": number, "idx": number - 1, "style": None, "text": _slide_text(slide)})
    return rows


#: Files whose rows a task holds at once.
FILES_AT_ONCE = 64


def _office_rows(data: bytes | None, kind: str) -> list[dict]:
    if data is None:
        return []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return _docx_paragraphs(archive) if kind == "docx" else _pptx_pages(archive)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []


def _office_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), FILES_AT_ONCE):
            some = batch.iloc[at : at + FILES_AT_ONCE]
            found = [(i, k, r["page"], r["idx"], r["style"], r["text"]) for i, k, data in some.itertuples(index=False) for r in _office_rows(data, k)]
            frame = pd.DataFrame(found, columns=["book_id", "file_type", "page", "idx", "style", "text"])
            yield frame.astype({"page": "Int64", "idx": "Int64"})


def office_text(files: DataFrame) -> DataFrame:
    """``(book_id, file_type, page, idx, style, text)`` of DOCX paragraphs and PPTX slides.

    A file that cannot be read gives no rows. A task holds the rows of a few files at a time.
    """
    office = files.filter(F.col("file_type").isin("docx", "pptx")).select("book_id", "file_type", "content")
    schema = f"book_id {files.schema['book_id'].dataType.simpleString()}, file_type string, page bigint, idx bigint, style string, text string"
    return office.mapInPandas(_office_frames, schema)


def scanned_books(books: DataFrame, pages: DataFrame, threshold: int = 30) -> DataFrame:
    """Books without a text layer: fewer than ``threshold`` characters per page, or no pages."""
    average = pages.groupBy("book_id").agg(F.avg(F.length(strip(F.col("text")))).alias("chars"))
    return books.select("book_id").join(average, "book_id", "left").select(
        "book_id", (F.coalesce("chars", F.lit(0.0)) < threshold).alias("scanned")
    )


def pages_from_chunks(chunks: DataFrame) -> DataFrame:
    """Page texts put together from chunks; pages without a chunk are empty."""
    page = F.coalesce("page_start", F.lit(1).cast("bigint"))
    pairs = F.sort_array(F.collect_list(F.struct("chunk_index", "content")))
    texts = chunks.groupBy("book_id", page.alias("page")).agg(
        F.array_join(F.transform(pairs, lambda p: p["content"]), "\n").alias("text")
    )
    every = texts.groupBy("book_id").agg(F.max("page").alias("last")).select(
        "book_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "last")).alias("page")
    )
    return every.join(texts, ["book_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
