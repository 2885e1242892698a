"""Prompts, citations, retrieval metrics and checks of model answers, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import patterns as P
from quire.functions.numbers import round_half_even
from quire.functions.text import let, strip

# The instructions that go with the sources.
ASK_WITH_SOURCES = (
    "你是专业课学习助手，基于下方提供的书籍内容回答问题。"
    "要求：1) 优先完整引用资料内容，力求完整输出文献原文相关段落；"
    "2) 回答末尾用 [资料N] 标注依据来源；"
    "3) 若资料已覆盖问题，不要以'资料不足'推脱；仅在资料确实未涉及时才说明。"
)
ASK_WITH_OUTLINE = (
    "你是专业课学习助手。以下是书籍的目录结构与章节关键词，正文检索未直接命中。"
    "请基于目录线索，说明该主题可能位于哪一章节，并给出书中相关概念的整体框架；"
    "不要编造具体公式或原文，明确提示用户可提供更多关键词。"
)
ASK_WITHOUT_SOURCES = (
    "你是一个专业课学习助手。用户正在复习专业书籍。"
    "如果资料中没有相关内容，请直接说明'资料中未找到相关内容'，不要编造。"
)


def assemble_prompts(queries: DataFrame, sources: DataFrame, limit: int = 12000) -> DataFrame:
    """System and user message of every query.

    ``sources`` is the result of retrieval; a row with chunk id 0 is an outline.
    """
    pages = (
        F.when(F.col("page_start").isNull(), "")
        .when(F.col("page_end") != F.col("page_start"),
              F.concat(F.lit(" 第"), F.col("page_start"), F.lit("-"), F.col("page_end"), F.lit("页")))
        .otherwise(F.concat(F.lit(" 第"), F.col("page_start"), F.lit("页")))
    )
    place = F.concat(
        F.when(F.col("book_title") != "", F.concat(F.lit("《"), F.col("book_title"), F.lit("》"))).otherwise(""),
        F.when(F.coalesce("chapter_title", F.lit("")) != "", F.concat(F.lit(" "), F.col("chapter_title"))).otherwise(""),
        pages,
    )
    text = F.when(F.coalesce("context", F.lit("")) != "", F.col("context")).otherwise(F.col("snippet"))
    block = F.concat(F.lit("[资料"), F.col("rank"), F.lit("]（"), place, F.lit("）\n"), text)
    grouped = sources.select("query_id", "rank", "chunk_id", "snippet", block.alias("block")).groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n\n").alias("blocks"),
        F.max(F.when(F.col("chunk_id") == 0, F.col("snippet"))).alias("outline"),
    )
    cut = F.when(
        F.length("blocks") > limit, F.concat(F.substring("blocks", 1, limit), F.lit("\n…（内容过长已截断）"))
    ).otherwise(F.col("blocks"))
    question = F.concat(F.lit("\n\n问题："), F.col("text"))
    return queries.join(grouped, "query_id", "left").select(
        "query_id",
        F.when(F.col("blocks").isNull(), ASK_WITHOUT_SOURCES)
        .when(F.col("outline").isNotNull(), ASK_WITH_OUTLINE)
        .otherwise(ASK_WITH_SOURCES)
        .alias("system"),
        F.when(F.col("blocks").isNull(), F.col("text"))
        .when(F.col("outline").isNotNull(), F.concat(F.lit("书籍目录：\n"), F.col("outline"), question))
        .otherwise(F.concat(F.lit("书籍资料：\n"), cut, question))
        .alias("user"),
    )


def verify_citations(answers: DataFrame) -> DataFrame:
    """``answers(chat_id, answer, n_sources)``: cited numbers, those out of range, verdict.

    A number too long for 64 bits counts as the largest one, so it is out of range.
    """
    cited = F.transform(
        F.regexp_extract_all("answer", F.lit(P.CITATION), F.lit(1)),
        lambda n: F.coalesce(n.try_cast("bigint"), F.lit((1 << 63) - 1)),
    )
    checked = answers.withColumn("cited", cited)
    wrong = F.filter("cited", lambda n: (n < 1) | (n > F.col("n_sources")))
    return checked.select(
        "chat_id", "cited", wrong.alias("mismatched"), "n_sources",
        ((F.size("cited") > 0) & (F.size(wrong) == 0)).alias("verified"),
    )


def retrieval_metrics(searches: DataFrame, checks: DataFrame, last: int = 100) -> DataFrame:
    """Over the last events of each kind: ``searches(ts, id, hits)``, ``checks(ts, id, verified)``."""
    recent = lambda df: df.orderBy(F.desc("ts"), F.desc("id")).limit(last)
    hits = recent(searches).select(F.col("hits").alias("hits"), F.lit(None).cast("int").alias("verified"))
    verdicts = recent(checks).select(F.lit(None).cast("bigint").alias("hits"), F.col("verified").cast("int").alias("verified"))
    return hits.unionByName(verdicts).agg(
        F.count("hits").alias("total_queries"),
        round_half_even(F.coalesce(F.avg("hits"), F.lit(0.0)), 1).alias("avg_retrieval_hits"),
        F.count("verified").alias("total_citation_checks"),
        round_half_even(F.coalesce(F.avg("verified"), F.lit(0.0)), 2).alias("citation_verify_rate"),
    )


def json_block(answer: Column) -> Column:
    """The JSON text inside a model answer: the whole of it, a fenced block, or the first
    ``[...]`` or ``{...}``; NULL when none of them parses."""
    bare = strip(answer)
    fenced = strip(F.regexp_replace(F.regexp_replace(bare, rf"^[{P.SPACE}]*```(?:json)?[{P.SPACE}]*", ""), rf"[{P.SPACE}]*```$", ""))
    candidates = [bare, fenced, F.regexp_extract(bare, r"(?s)\[.*?\]", 0), F.regexp_extract(bare, r"(?s)\{.*?\}", 0)]
    parses = lambda text: F.when((text != "") & F.try_parse_json(text).isNotNull(), text)
    return F.coalesce(*[parses(c) for c in candidates])


def validated_toc(answers: DataFrame, limit: int = 60) -> DataFrame:
    """``answers(book_id, answer, n_pages)``: table-of-contents items with a title and a real page."""
    items = F.from_json(json_block(F.col("answer")), "array<struct<title:string,page:bigint,level:bigint>>")
    return (
        answers.select("book_id", "n_pages", F.posexplode(F.slice(items, 1, limit)).alias("seq", "x"))
        .select("book_id", "n_pages", F.col("seq").cast("bigint").alias("seq"), strip(F.col("x.title")).alias("title"),
                F.coalesce("x.level", F.lit(1).cast("bigint")).alias("level"), F.col("x.page").alias("page"))
        .filter("title <> '' and page between 1 and n_pages")
        .drop("n_pages")
    )


def validated_split(answers: DataFrame) -> DataFrame:
    """``answers(chunk_id, content, answer)``: the pieces of a proposed split, or the chunk itself.

    A split counts with at least two pieces whose total length is near that of the chunk.
    """
    bare = F.regexp_replace(F.regexp_replace(strip(F.col("answer")), "^`+|`+$", ""), "^json", "")
    pieces = F.from_json(bare, "array<string>")
    total = F.aggregate("pieces", F.lit(0), lambda acc, p: acc + F.length(p))
    gap = F.abs(total - F.length(strip(F.col("content"))))
    good = (F.size("pieces") >= 2) & ~F.exists("pieces", lambda p: p.isNull()) & (
        gap <= F.greatest(F.size("pieces") * 10, F.lit(50))
    )
    kept = F.when(F.coalesce(good, F.lit(False)), F.filter("pieces", lambda p: strip(p) != "")).otherwise(F.array("content"))
    return answers.withColumn("pieces", pieces).select("chunk_id", F.posexplode(kept).alias("i", "content")).select(
        "chunk_id", F.col("i").cast("bigint").alias("i"), "content"
    )
