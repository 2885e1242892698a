"""Keywords, definitions, theorems, subject classes and tags of books.

``texts(book_id, text)`` holds one row per book. Everything that looks at text happens inside that
row; only names and counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import let, strip
from quire.functions.tokens import index_tokens, term_counts
from quire.operators.ranking import global_row_number
from quire.session import written

OTHER = "其他"
HAN_SCRIPT = rf"[{P.HAN}]"


def keywords(text: Column, n: int = 30, script: str | None = HAN_SCRIPT, stop_words: tuple[str, ...] = ()) -> Column:
    """Most frequent words: the top ``3 n`` by count, of those the ones in ``script``, cut to ``n``."""
    words = F.filter(
        index_tokens(text, [], keep_bare=False),
        # A number begins below the colon: other words are told apart without the pattern.
        lambda w: (F.length(w) >= 2) & ((w >= ":") | ~w.rlike("^[0-9]+$")) & (~w.isin(*stop_words) if stop_words else F.lit(True)),
    )
    ranked = F.sort_array(
        F.transform(
            F.coalesce(term_counts(words), F.lit([]).cast("array<struct<token:string,tf:int>>")),
            lambda t: F.struct((-t["tf"]).alias("n"), t["token"].alias("w")),
        )
    )
    top = F.transform(F.slice(ranked, 1, 3 * n), lambda t: t["w"])
    return F.slice(F.filter(top, lambda w: w.rlike(script)) if script else top, 1, n)


def _quick(pattern: str, words: str) -> str:
    """The same matches with looks ahead in Java's form: a term needs a Han character in its run, and of ``words``
    the first characters are tried as one class."""
    firsts = "".join(dict.fromkeys(w[0] for w in words.split("|")))
    return rf"(?=[A-Za-z0-9·\-()（）]*+[{P.HAN}])" + pattern.replace(f"(?:{words})", f"(?=[{firsts}])(?:{words})", 1)


def _trimmed_pairs(text: Column, pattern: str, words: str) -> Column:
    """White space before a definition may hold line breaks, so the whole text is searched."""
    pattern = _quick(pattern, words)
    part = lambda m, group, chars: F.btrim(F.regexp_extract(m, pattern, group), F.lit(chars))
    matches = F.when(text.rlike(words), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.transform(
        F.coalesce(matches, F.array().cast("array<string>")),
        lambda m: F.struct(part(m, 1, "：:，。 ").alias("term"), part(m, 2, "，。； ").alias("definition")),
    )


def definitions(text: Column, limit: int = 30) -> Column:
    """``array<struct<term,definition>>``, the first of each 20-character opening, at most ``limit``."""
    found = F.filter(
        F.concat(
            _trimmed_pairs(text, P.DEFINITION_OF, P.DEFINITION_OF_WORDS),
            _trimmed_pairs(text, P.DEFINITION_IS, P.DEFINITION_IS_WORDS),
        ),
        lambda d: (F.length(d["term"]) >= 2) & (F.length(d["definition"]) >= 4),
    )
    return let(
        found,
        lambda all_: let(
            F.transform(all_, lambda d: F.substring(d["definition"], 1, 20)),
            lambda keys: F.slice(
                F.transform(
                    F.filter(all_, lambda d, i: F.array_position(keys, F.get(keys, i)) == i + 1),
                    lambda d: F.struct(d["term"].alias("term"), F.substring(d["definition"], 1, 200).alias("definition")),
                ),
                1,
                limit,
            ),
        ),
    )


def theorems(text: Column, limit: int = 30) -> Column:
    """``array<struct<type,number,statement>>``: numbered ones, then named ones not yet covered."""

    def item(kind: Column, number: Column, statement: Column) -> Column:
        return F.struct(
            kind.alias("type"), number.alias("number"), F.substring(statement, 1, 200).alias("statement")
        )

    group = lambda pattern, g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    numbered = F.transform(
        F.filter(
            F.arrays_zip(
                group(P.THEOREM, 1).alias("a"), group(P.THEOREM, 2).alias("b"),
                F.transform(group(P.THEOREM, 3), strip).alias("c"),
            ),
            lambda z: F.length(z["c"]) >= 4,
        ),
        lambda z: item(z["a"], z["b"], z["c"]),
    )
    named = F.arrays_zip(group(P.NAMED_THEOREM, 1).alias("a"), F.transform(group(P.NAMED_THEOREM, 2), strip).alias("c"))

    def add(acc: Column, z: Column) -> Column:
        covered = F.exists(acc, lambda r: (r["type"] == z["a"]) | F.contains(r["statement"], z["a"]))
        return F.when(covered | (F.length(z["c"]) < 4), acc).otherwise(
            F.concat(acc, F.array(item(z["a"], F.lit(""), z["c"])))
        )

    return F.slice(F.aggregate(named, numbered, add), 1, limit)


def analyse_books(texts: DataFrame, script: str | None = HAN_SCRIPT) -> DataFrame:
    """One analysis record per book."""
    text = F.col("text")
    return texts.select(
        "book_id",
        definitions(text).alias("definitions"),
        theorems(text).alias("theorems"),
        keywords(text, script=script).alias("keywords"),
    )


def classify(features: Column, seeds: dict[str, list[str]], threshold: float = 0.03) -> Column:
    """Subject class with the largest share of its seed words in ``features``.

    The first class wins a tie; below ``threshold`` the class is 其他. ``seeds`` is a parameter: one
    list of seed words per class.
    """
    scored = F.array(
        *[
            F.struct(
                (F.size(F.filter(F.lit([w.strip() for w in words]), lambda w: F.contains(features, w))) / len(words)).alias("s"),
                F.lit(-i).alias("i"),
                F.lit(name).alias("name"),
            )
            for i, (name, words) in enumerate(seeds.items())
        ]
    )
    return let(
        F.array_max(scored), lambda best: F.when(best["s"] >= threshold, best["name"]).otherwise(OTHER)
    )


def classification_features(books: DataFrame, keyword_lists: DataFrame, chapters: DataFrame) -> DataFrame:
    """Title, keywords and the first 40 chapter titles of each book as one text."""
    titles = chapters.filter("order_index < 40").groupBy("book_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("order_index", "title"))), lambda c: c["title"]).alias("titles")
    )
    return (
        books.join(keyword_lists, "book_id", "left")
        .join(titles, "book_id", "left")
        .withColumn(
            "features",
            F.concat_ws(" ", "title", F.array_join("keywords", " "), F.array_join("titles", " ")),
        )
        .drop("keywords", "titles")
    )


def fill_category(books: DataFrame, seeds: dict[str, list[str]]) -> DataFrame:
    """Classify ready books that have no category yet."""
    missing = (F.col("status") == "ready") & F.col("category").isNull()
    return books.withColumn(
        "category", F.when(missing, classify(F.col("features"), seeds)).otherwise(F.col("category"))
    )


def wanted_tags(books: DataFrame, keyword_lists: DataFrame, n: int = 5) -> DataFrame:
    """``(book_id, name)``: file type, category and the first ``n`` keywords of each book."""
    named = books.select("book_id", F.explode(F.array("file_type", "category")).alias("name"))
    words = keyword_lists.select("book_id", F.explode(F.slice("keywords", 1, n)).alias("name"))
    return (
        named.union(words)
        .select("book_id", strip(F.col("name")).alias("name"))
        .filter("length(name) >= 1")
        .distinct()
    )


def assign_tags(wanted: DataFrame, tags: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New tags and new links for ``wanted(book_id, name)``.

    Ids of new tags continue after the largest one, in name order. ``wanted`` is written, as names and links both
    come from it: the keywords of a book are found once.
    """
    wanted = written(wanted, "wanted")
    top = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("top"))
    fresh = wanted.select("name").distinct().join(tags, "name", "left_anti")
    numbered = global_row_number(fresh, ["name"], "rn")
    new_tags = numbered.select((F.col("rn") + top.scalar()).alias("tag_id"), "name")
    every = tags.select("tag_id", "name").unionByName(new_tags)
    new_links = (
        wanted.join(every, "name").select("book_id", "tag_id").distinct().join(links, ["book_id", "tag_id"], "left_anti")
    )
    return new_tags, new_links
