"""Registered queries: chunking, keywords, definitions, theorems, classes, tags, duplicates, concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import tokens as K
from quire.operators import chunking, dedup, graph, lexical, toc
from quire.plans import twin as S
from quire.session import checkpointed
from quire.sources import model as M

# Seed words of the classes used on the stored tables, whose text is in four languages.
LANGUAGE_SEEDS = {
    "english": ["the", "and", "of ", "with", " is "],
    "français": ["eux", "que", "tre", " les "],
    "deutsch": ["und", "sch", "ung", " der ", "keit"],
    "español": ["ción", "ado", " los ", "ñ"],
}
NON_ASCII = r"[^a-z]"


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """Pages with paragraphs: odd pages have blank lines, even pages are one long paragraph."""
    marked = lambda t: F.replace(t, F.lit(". "), F.lit("。"))
    return M.page_arrays(spark, d).select(
        "book_id",
        F.transform(
            "pages",
            lambda t, i: F.when(i % 2 == 0, F.replace(marked(t), F.lit("\n"), F.lit("\n \n"))).otherwise(
                F.replace(marked(t), F.lit("\n"), F.lit("； "))
            ),
        ).alias("pages"),
    )


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return toc.page_intervals(M.chapters(spark, d), M.books(spark, d))


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    pages = _paged(spark, d).select("book_id", F.posexplode("pages").alias("p", "text"))
    return pages.select(
        "book_id", (F.col("p") + 1).cast("bigint").alias("page"), F.posexplode(chunking.split_paragraphs(F.col("text"))).alias("i", "text")
    ).select("book_id", "page", (F.col("i") + 1).cast("bigint").alias("i"), "text")


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_books(_paged(spark, d), _intervals(spark, d))


def _window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_books(M.page_arrays(spark, d), _intervals(spark, d), chunking.window_chunks)


def _page_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Pages below their chapter and, for level-1 chapters, below the children's pages as well."""
    nested = M.chapters(spark, d).select(
        "book_id", F.col("order_index").alias("chapter_index"), "start_page",
        F.when(F.col("level") == 1, F.col("end_page") + 4).otherwise(F.col("end_page")).alias("end_page"),
    )
    return toc.assign_pages(M.pages(spark, d).select("book_id", "page"), nested)


def keyword_lists(spark: SparkSession, d: str, books: DataFrame | None = None) -> DataFrame:
    """Keywords in any script for every book, or for ``books(book_id)``."""
    texts = _only(M.documents(spark, d).select(F.col("doc_id").alias("book_id"), "text"), books)
    return texts.select("book_id", lexical.keywords(F.col("text"), script=None).alias("keywords"))


def _only(texts: DataFrame, books: DataFrame | None) -> DataFrame:
    return texts if books is None else texts.join(books.select("book_id").distinct(), "book_id", "left_semi")


def _fact_texts(spark: SparkSession, d: str) -> DataFrame:
    """Book texts with definition and theorem sentences."""
    dressed = F.transform(
        F.split("text", "\n"),
        lambda l, n: F.when(n % 5 == 0, F.concat(F.lit("定理 "), n.cast("string"), F.lit(".1：  "), l))
        .when(n % 5 == 1, F.concat(F.regexp_extract(l, "^[^ ]+", 0), F.lit("定理： "), l))
        .when(n % 5 == 2, F.concat(F.regexp_extract(l, "^[^ ]+", 0), F.lit("是指"), l, F.lit("。")))
        .when(n % 5 == 3, F.concat(F.regexp_extract(l, "^[^ ]+", 0), F.lit("的定义是： "), l, F.lit("；")))
        .otherwise(l),
    )
    return M.documents(spark, d).select(F.col("doc_id").alias("book_id"), F.array_join(dressed, "\n").alias("text"))


def analysis(spark: SparkSession, d: str, books: DataFrame | None = None) -> DataFrame:
    """Definitions and theorems of the dressed texts with keywords in any script of the plain ones.

    With ``books(book_id)``, of those books alone.
    """
    facts = _only(_fact_texts(spark, d), books).select(
        "book_id", lexical.definitions(F.col("text")).alias("definitions"), lexical.theorems(F.col("text")).alias("theorems")
    )
    return facts.join(keyword_lists(spark, d, books), "book_id")


def concept_sources(spark: SparkSession, d: str) -> DataFrame:
    """Keywords and theorems of all books, stored once for the several passes of the graph."""
    return checkpointed(analysis(spark, d).select("book_id", "keywords", "theorems"))


def _cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    stored = concept_sources(spark, d)
    return graph.edges(stored, graph.nodes(graph.concepts(stored)))


def _analysis_record(spark: SparkSession, d: str) -> DataFrame:
    return analysis(spark, d).select(
        "book_id",
        F.array_join("keywords", ",").alias("keywords"),
        F.array_join(F.transform("definitions", lambda x: F.concat(x["term"], F.lit("="), x["definition"])), "|").alias("definitions"),
        F.array_join(F.transform("theorems", lambda x: F.concat(x["type"], F.lit(" "), x["number"], F.lit(" "), x["statement"])), "|").alias("theorems"),
    )


def _classes(spark: SparkSession, d: str) -> DataFrame:
    features = lexical.classification_features(M.books(spark, d), keyword_lists(spark, d), M.chapters(spark, d))
    return features.select("book_id", lexical.classify(F.col("features"), LANGUAGE_SEEDS).alias("category"))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    books = M.books(spark, d).withColumn("category", F.when(F.col("book_id") % 3 != 0, F.col("category")))
    features = lexical.classification_features(books, keyword_lists(spark, d), M.chapters(spark, d))
    return lexical.fill_category(features, LANGUAGE_SEEDS).select("book_id", "category")


def library_tags(spark: SparkSession, d: str) -> DataFrame:
    """Existing tags: the languages, numbered by name."""
    names = M.documents(spark, d).select(F.col("lang").alias("name")).distinct()
    return lexical.global_row_number(names, ["name"], "tag_id")


def library_links(spark: SparkSession, d: str) -> DataFrame:
    """Existing links: documents labelled as good carry the tag of their language."""
    good = M.table(spark, d, "labels").filter("quality = 1").select("doc_id")
    docs = M.documents(spark, d).join(good, "doc_id", "left_semi")
    return docs.join(library_tags(spark, d), docs["lang"] == F.col("name")).select(
        F.col("doc_id").alias("book_id"), "tag_id"
    )


def _auto_tags(spark: SparkSession, d: str) -> DataFrame:
    wanted = lexical.wanted_tags(M.books(spark, d), keyword_lists(spark, d))
    tags = library_tags(spark, d)
    new_tags, new_links = lexical.assign_tags(wanted, tags, library_links(spark, d))
    names = tags.select("tag_id", "name").unionByName(new_tags)
    return new_links.join(names, "tag_id").select("book_id", "tag_id", "name")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return M.documents(spark, d).select("doc_id", "text")


def _exact(spark: SparkSession, d: str) -> DataFrame:
    files = M.documents(spark, d).select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    return dedup.exact_duplicates(files)


QUERIES = {
    "paragraph_split": _paragraphs,
    "semantic_chunk_packing": semantic_chunks,
    "window_chunking": _window_chunks,
    "chunk_metadata": lambda s, d: semantic_chunks(s, d).groupBy("book_id").agg(
        F.count("*").alias("chunks"), F.sum("word_count").alias("chars"), F.min("page_start").alias("first_page"),
        F.max("page_end").alias("last_page"), F.max("chunk_index").alias("last_index"),
    ),
    "page_chapter_assignment": lambda s, d: _page_chapters(s, d).select("book_id", "page", "chapter_index"),
    "index_tokenizer": lambda s, d: M.chunks(s, d).select(
        "chunk_id", F.explode(K.term_counts(K.index_tokens(F.col("content")))).alias("t")
    ).select("chunk_id", "t.token", F.col("t.tf").cast("bigint").alias("tf")),
    "query_tokenizer": lambda s, d: M.queries(s, d).select(
        "query_id", F.array_join(K.query_tokens(F.col("text")), " ").alias("tokens")
    ),
    "keyword_extraction": lambda s, d: M.documents(s, d).select(
        F.col("doc_id").alias("book_id"), F.array_join(lexical.keywords(F.col("text"), script=NON_ASCII), ",").alias("keywords")
    ),
    "definition_extraction": lambda s, d: _fact_texts(s, d).select(
        "book_id", F.posexplode(lexical.definitions(F.col("text"))).alias("i", "x")
    ).select("book_id", F.col("i").cast("bigint").alias("i"), "x.term", "x.definition"),
    "theorem_extraction": lambda s, d: _fact_texts(s, d).select(
        "book_id", F.posexplode(lexical.theorems(F.col("text"))).alias("i", "x")
    ).select("book_id", F.col("i").cast("bigint").alias("i"), "x.type", "x.number", "x.statement"),
    "book_analysis_record": _analysis_record,
    "subject_classifier": _classes,
    "missing_category_fill": _filled,
    "automatic_tags": _auto_tags,
    "exact_deduplication": _exact,
    "simhash_fingerprint": lambda s, d: dedup.fingerprints(_texts(s, d)),
    "near_duplicate_pairs": lambda s, d: dedup.near_duplicates_of(_texts(s, d)),
    "concept_collection": lambda s, d: graph.concepts(analysis(s, d)),
    "concept_nodes": lambda s, d: graph.nodes(graph.concepts(concept_sources(s, d))).select(
        "name", "n_books", F.array_join(F.transform("books", lambda b: b.cast("string")), ",").alias("books")
    ),
    "cooccurrence_edges": _cooccurrence,
}

_PAGED = S.PAGES + """, paged AS (SELECT book_id, page, CASE WHEN page % 2 = 1 THEN replace(replace(text, '. ', '。'), chr(10), chr(10) || ' ' || chr(10))
   ELSE replace(replace(text, '. ', '。'), chr(10), '； ') END AS text FROM pages_)"""
_PARTS = f"string_split({S.rr('p', f'([。！？；])[{P.SPACE}]*', chr(92) + '1' + chr(1))}, chr(1))"
_CUT = f"""CASE WHEN length(p) <= 900 THEN [p] ELSE list_reduce(list_transform({_PARTS}, lambda y: [y]), lambda acc, l:
   CASE WHEN length(acc[len(acc)]) + length(l[1]) > 900 THEN list_append(acc, l[1])
        ELSE list_append(acc[1:len(acc) - 1], acc[len(acc)] || l[1]) END, ['']) END"""
_SPLIT = f"regexp_split_to_array(text, {S.q(chr(10) + f'[{P.SPACE}]*' + chr(10))})"
_PARAGRAPHS = _PAGED + f""", listed AS (SELECT book_id, page, list_filter(list_transform(flatten(list_transform(
    list_filter(list_transform({_SPLIT}, lambda p: {S.strip('p')}), lambda p: p <> ''), lambda p: {_CUT})), lambda p: {S.strip('p')}), lambda p: p <> '') AS ps FROM paged),
  paragraphs AS (SELECT book_id, page, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM listed)"""
_ITEM = "{'ps': page, 'pe': page, 'content': text, 'size': length(text)}"
_SEMANTIC = _PARAGRAPHS + f""", {S.CHAPTERS}, folded AS (SELECT p.book_id, order_index, list_reduce(list([{_ITEM}] ORDER BY page, i), lambda acc, x:
    CASE WHEN len(acc) = 0 THEN x WHEN acc[len(acc)].size + x[1].size > 900 THEN list_append(acc, x[1])
    ELSE list_append(acc[1:len(acc) - 1], {{'ps': acc[len(acc)].ps, 'pe': x[1].pe, 'content': acc[len(acc)].content || chr(10) || chr(10) || x[1].content, 'size': acc[len(acc)].size + x[1].size}}) END) AS cs
    FROM paragraphs p JOIN chapters c ON p.book_id = c.book_id AND p.page BETWEEN c.start_page AND c.end_page GROUP BY 1, 2),
  cut_chunks AS (SELECT book_id, order_index, unnest(cs) AS c, generate_subscripts(cs, 1) AS j FROM folded),
  semantic AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY order_index, j) - 1 AS chunk_index, order_index AS chapter_index,
    c.ps AS page_start, c.pe AS page_end, c.content AS content, length(c.content) AS word_count FROM cut_chunks)"""
_ST = "{{'out': {out}, 'buf': {buf}, 'ps': {ps}, 'pe': {pe}, 'blen': {blen}}}"
_FL = "CASE WHEN acc.buf = '' THEN acc.out ELSE list_append(acc.out, {'ps': acc.ps, 'pe': acc.pe, 'content': acc.buf}) END"
_CUTS = f"""list_filter(list_transform(range(0, length(x.buf), 520), lambda a: {{'at': a, 'text': {S.strip('substr(x.buf, a + 1, 600)')}}}), lambda z: z.text <> '')"""
_SHORT = f"list_position(list_transform({_CUTS}, lambda z: z.at > 0 AND length(z.text) < 260), true)"
_WINS = f"""list_transform(({_CUTS})[1:CASE WHEN coalesce({_SHORT}, 0) > 0 THEN {_SHORT} - 1 ELSE len({_CUTS}) END], lambda z: {{'ps': x.ps, 'pe': x.ps, 'content': z.text}})"""
_WINDOWED = S.PAGES + f""", {S.CHAPTERS}, items AS (SELECT p.book_id, order_index, page, {S.strip('text')} AS t FROM pages_ p
    JOIN chapters c ON p.book_id = c.book_id AND p.page BETWEEN c.start_page AND c.end_page),
  folded AS (SELECT book_id, order_index, list_reduce(list({{'out': []::STRUCT(ps BIGINT, pe BIGINT, content VARCHAR)[], 'buf': t, 'ps': page, 'pe': page, 'blen': length(t)}} ORDER BY page), lambda acc, x:
    CASE WHEN x.buf = '' THEN acc
      WHEN length(x.buf) > 600 THEN {_ST.format(out=f"list_concat({_FL}, {_WINS})", buf="''", ps='x.ps', pe='x.ps', blen='0::bigint')}
      WHEN acc.buf = '' THEN {_ST.format(out='acc.out', buf='x.buf', ps='x.ps', pe='x.ps', blen='length(x.buf) + 2')}
      WHEN acc.blen + length(x.buf) + 2 > 600 THEN {_ST.format(out=_FL, buf="right(acc.buf, 80) || chr(10) || chr(10) || x.buf", ps='acc.pe', pe='x.ps', blen='least(80, length(acc.buf)) + length(x.buf) + 2')}
      ELSE {_ST.format(out='acc.out', buf="acc.buf || chr(10) || chr(10) || x.buf", ps='acc.ps', pe='x.ps', blen='acc.blen + length(x.buf) + 2')} END,
    {{'out': []::STRUCT(ps BIGINT, pe BIGINT, content VARCHAR)[], 'buf': '', 'ps': 0::bigint, 'pe': 0::bigint, 'blen': 0::bigint}}) AS acc FROM items GROUP BY 1, 2),
  flushed AS (SELECT book_id, order_index, {_FL} AS cs FROM folded),
  cut_chunks AS (SELECT book_id, order_index, unnest(cs) AS c, generate_subscripts(cs, 1) AS j FROM flushed)"""
_WORDS = f"""words_ AS (SELECT doc_id AS book_id, unnest(regexp_extract_all(lower(text), {S.q(P.WORD)})) AS w FROM documents)"""
_TOP = _WORDS + """, top_words AS (SELECT book_id, w, n, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, w) AS r FROM
    (SELECT book_id, w, count(*) AS n FROM words_ WHERE length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY 1, 2))"""
_KEYWORDS = _TOP + """, keyword_rows AS (SELECT book_id, w, r FROM top_words WHERE r <= 30)"""
_FIRST = "regexp_extract(line, '^[^ ]+', 0)"
_FACTS = S.LINES + f""", facts AS (SELECT book_id, string_agg(CASE n % 5 WHEN 0 THEN '定理 ' || n || '.1：  ' || line WHEN 1 THEN {_FIRST} || '定理： ' || line
    WHEN 2 THEN {_FIRST} || '是指' || line || '。' WHEN 3 THEN {_FIRST} || '的定义是： ' || line || '；' ELSE line END, chr(10) ORDER BY n) AS text FROM lines GROUP BY 1)"""


def _all(pattern: str, group: int) -> str:
    return f"regexp_extract_all(text, {S.q(pattern)}, {group})"


def _pairs(pattern: str, offset: int) -> str:
    return f"""SELECT book_id, {offset} + generate_subscripts({_all(pattern, 1)}, 1) AS o, trim(unnest({_all(pattern, 1)}), '：:，。 ') AS term,
      trim(unnest({_all(pattern, 2)}), '，。； ') AS definition FROM facts"""


_DEFINITIONS = _FACTS + f""", found AS ({_pairs(P.DEFINITION_OF, 0)} UNION ALL {_pairs(P.DEFINITION_IS, 1000000)}),
  kept AS (SELECT * FROM found WHERE length(term) >= 2 AND length(definition) >= 4
    QUALIFY row_number() OVER (PARTITION BY book_id, substr(definition, 1, 20) ORDER BY o) = 1),
  definitions AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY o) - 1 AS i, term, substr(definition, 1, 200) AS definition FROM kept
    QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY o) <= 30)"""
_NUMBERED = f"""list_filter(list_transform(list_zip({_all(P.THEOREM, 1)}, {_all(P.THEOREM, 2)}, {_all(P.THEOREM, 3)}),
   lambda z: {{'kind': z[1], 'num': z[2], 'st': substr({S.strip('z[3]')}, 1, 200)}}), lambda z: length(z.st) >= 4)"""
_NAMED = f"""list_transform(list_zip({_all(P.NAMED_THEOREM, 1)}, {_all(P.NAMED_THEOREM, 2)}), lambda z: [{{'kind': z[1], 'num': '', 'st': substr({S.strip('z[2]')}, 1, 200)}}])"""
_THEOREMS = f""", theorem_lists AS (SELECT book_id, list_reduce({_NAMED}, lambda acc, x: CASE WHEN length(x[1].st) < 4 OR
     len(list_filter(acc, lambda r: r.kind = x[1].kind OR contains(r.st, x[1].kind))) > 0 THEN acc ELSE list_append(acc, x[1]) END, {_NUMBERED})[1:30] AS ts FROM facts),
  theorems AS (SELECT book_id, generate_subscripts(ts, 1) - 1 AS i, unnest(ts) AS t FROM theorem_lists)"""
_SCORES = ", ".join(
    "{'s': (" + " + ".join(f"contains(features, {S.q(w.strip())})::int" for w in words) + f") / {len(words)}, 'i': {-i}, 'name': {S.q(name)}}}"
    for i, (name, words) in enumerate(LANGUAGE_SEEDS.items())
)
_CLASSES = _KEYWORDS + f""", {S.BOOKS}, {S.CHAPTERS}, feature_rows AS (SELECT b.book_id, b.category, concat_ws(' ', b.title, coalesce(k.kw, ''), h.ts) AS features FROM books b
   LEFT JOIN (SELECT book_id, string_agg(w, ' ' ORDER BY r) AS kw FROM keyword_rows GROUP BY 1) k USING (book_id)
   LEFT JOIN (SELECT book_id, string_agg(title, ' ' ORDER BY order_index) AS ts FROM chapters WHERE order_index < 40 GROUP BY 1) h USING (book_id)),
  classed AS (SELECT book_id, category, list_sort([{_SCORES}])[4] AS best FROM feature_rows)"""
_CLASS = "CASE WHEN best.s >= 0.03 THEN best.name ELSE '其他' END"
_HASH = "('0x' || substr(md5(w), {at}, 8))::bigint"
_SIMHASH = f"""words_ AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {S.q(P.WORD)})) AS w FROM documents),
  counted AS (SELECT doc_id, w, count(*) AS tf FROM words_ WHERE length(w) >= 2 GROUP BY 1, 2),
  hashed AS (SELECT doc_id, tf, {_HASH.format(at=1)} AS hi, {_HASH.format(at=9)} AS lo FROM counted),
  votes AS (SELECT doc_id, bit, sum(CASE WHEN (CASE WHEN bit < 32 THEN lo >> bit ELSE hi >> (bit - 32) END) & 1 = 1 THEN tf ELSE -tf END) AS v
    FROM hashed, (SELECT unnest(range(0, 64)) AS bit) GROUP BY 1, 2),
  printed AS (SELECT doc_id, sum(CASE WHEN v > 0 AND bit < 63 THEN (1::hugeint << bit) WHEN v > 0 THEN -(1::hugeint << 63) ELSE 0 END)::bigint AS fingerprint FROM votes GROUP BY 1),
  prints AS (SELECT d.doc_id, coalesce(fingerprint, 0) AS fingerprint FROM documents d LEFT JOIN printed p USING (doc_id))"""
_STOP = ", ".join(S.q(w) for w in P.CONCEPT_STOP_WORDS)
_CONCEPTS = _FACTS + _THEOREMS + ", " + _KEYWORDS + f""", terms AS (SELECT book_id, trim(w) AS name FROM keyword_rows UNION SELECT book_id, trim(t.kind) FROM theorems),
  concepts AS (SELECT DISTINCT book_id, name FROM terms WHERE length(name) > 1 AND NOT regexp_matches(name, '^[0-9]+$') AND name NOT IN ({_STOP})),
  nodes_ AS (SELECT name, count(*) AS n_books, string_agg(book_id::varchar, ',' ORDER BY book_id) AS books FROM concepts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200)"""

ORACLE = {
    "paragraph_split": f"WITH {_PARAGRAPHS} SELECT book_id, page, i, text FROM paragraphs",
    "semantic_chunk_packing": f"WITH {_SEMANTIC} SELECT * FROM semantic",
    "window_chunking": f"""WITH {_WINDOWED} SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY order_index, j) - 1 AS chunk_index, order_index AS chapter_index,
      c.ps AS page_start, c.pe AS page_end, c.content AS content, length(c.content) AS word_count FROM cut_chunks""",
    "chunk_metadata": f"""WITH {_SEMANTIC} SELECT book_id, count(*) AS chunks, sum(word_count)::bigint AS chars, min(page_start) AS first_page,
      max(page_end) AS last_page, max(chunk_index) AS last_index FROM semantic GROUP BY 1""",
    "page_chapter_assignment": f"""WITH {S.PAGES}, {S.CHAPTERS} SELECT p.book_id, page, order_index AS chapter_index FROM pages_ p JOIN chapters c
      ON p.book_id = c.book_id AND page BETWEEN start_page AND CASE WHEN level = 1 THEN end_page + 4 ELSE end_page END""",
    "index_tokenizer": f"""WITH {S.TOKENS} SELECT chunk_id, token, count(*) AS tf FROM tokens GROUP BY 1, 2
      UNION ALL SELECT chunk_id, lower(content), 1 FROM chunks WHERE len(regexp_extract_all(lower(content), {S.q(P.WORD)})) = 0""",
    "query_tokenizer": f"""WITH t AS (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM
        (SELECT item_id, regexp_extract_all(lower(text), {S.q(P.WORD)}) AS l FROM benchmark)) GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) AS k FROM t WHERE length(w) >= 2 OR ascii(w) < 128)
      SELECT b.item_id AS query_id, coalesce(string_agg(w, ' ' ORDER BY k) FILTER (k <= 8), '') AS tokens FROM benchmark b LEFT JOIN r ON b.item_id = r.item_id GROUP BY 1""",
    "keyword_extraction": f"""WITH {_TOP}, picked AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY r) AS k FROM top_words WHERE r <= 90 AND regexp_matches(w, {S.q(NON_ASCII)}))
      SELECT doc_id AS book_id, coalesce(string_agg(w, ',' ORDER BY k) FILTER (k <= 30), '') AS keywords FROM documents LEFT JOIN picked ON doc_id = book_id GROUP BY 1""",
    "definition_extraction": f"WITH {_DEFINITIONS} SELECT * FROM definitions",
    "theorem_extraction": f"WITH {_FACTS}{_THEOREMS} SELECT book_id, i, t.kind AS type, t.num AS number, t.st AS statement FROM theorems",
    "book_analysis_record": f"""WITH {_DEFINITIONS}{_THEOREMS}, {_KEYWORDS} SELECT f.book_id, coalesce(kw, '') AS keywords, coalesce(ds, '') AS definitions, coalesce(ts, '') AS theorems FROM facts f
      LEFT JOIN (SELECT book_id, string_agg(w, ',' ORDER BY r) AS kw FROM keyword_rows GROUP BY 1) USING (book_id)
      LEFT JOIN (SELECT book_id, string_agg(term || '=' || definition, '|' ORDER BY i) AS ds FROM definitions GROUP BY 1) USING (book_id)
      LEFT JOIN (SELECT book_id, string_agg(t.kind || ' ' || t.num || ' ' || t.st, '|' ORDER BY i) AS ts FROM theorems GROUP BY 1) USING (book_id)""",
    "subject_classifier": f"WITH {_CLASSES} SELECT book_id, {_CLASS} AS category FROM classed",
    "missing_category_fill": f"WITH {_CLASSES} SELECT book_id, CASE WHEN book_id % 3 = 0 THEN {_CLASS} ELSE category END AS category FROM classed",
    "automatic_tags": f"""WITH {_KEYWORDS}, {S.BOOKS}, wanted AS (SELECT book_id, file_type AS name FROM books UNION SELECT book_id, category FROM books
        UNION SELECT book_id, w FROM keyword_rows WHERE r <= 5),
      tags AS (SELECT name, row_number() OVER (ORDER BY name) AS tag_id FROM (SELECT DISTINCT lang AS name FROM documents)),
      fresh AS (SELECT name, row_number() OVER (ORDER BY name) + (SELECT max(tag_id) FROM tags) AS tag_id FROM (SELECT DISTINCT name FROM wanted WHERE name NOT IN (SELECT name FROM tags))),
      every AS (SELECT * FROM tags UNION ALL SELECT * FROM fresh),
      links AS (SELECT doc_id AS book_id, tag_id FROM documents JOIN tags ON lang = name WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
      SELECT w.book_id, e.tag_id, w.name FROM wanted w JOIN every e USING (name) WHERE (w.book_id, e.tag_id) NOT IN (SELECT book_id, tag_id FROM links)""",
    "exact_deduplication": """WITH h AS (SELECT doc_id AS file_id, sha256(text) AS file_hash FROM documents),
      f AS (SELECT *, min(file_id) OVER (PARTITION BY file_hash) AS o FROM h) SELECT file_id, file_hash, CASE WHEN o <> file_id THEN o END AS duplicate_of FROM f""",
    "simhash_fingerprint": f"WITH {_SIMHASH} SELECT doc_id, fingerprint FROM prints",
    "near_duplicate_pairs": f"""WITH {_SIMHASH}, seen AS (SELECT p.* FROM prints p JOIN documents d USING (doc_id) WHERE regexp_matches(d.text, '\\S')) SELECT a.doc_id, min(b.doc_id) AS duplicate_of FROM seen a LEFT JOIN seen b
      ON b.doc_id < a.doc_id AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 10 GROUP BY 1""",
    "concept_collection": f"WITH {_CONCEPTS} SELECT book_id, name FROM concepts",
    "concept_nodes": f"WITH {_CONCEPTS} SELECT name, n_books, books FROM nodes_",
    "cooccurrence_edges": f"""WITH {_CONCEPTS} SELECT a.w AS source, b.w AS target, count(*) AS weight FROM keyword_rows a JOIN keyword_rows b ON a.book_id = b.book_id AND a.r < b.r
      WHERE a.w IN (SELECT name FROM nodes_) AND b.w IN (SELECT name FROM nodes_) GROUP BY 1, 2""",
}
