"""Tokenizers for the index and for queries, and the run-length form of a token list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import let

LATIN_RUN = rf"[\p{{L}}\p{{N}}&&[^{P.HAN}]]+"
_HAN_RUN = rf"[{P.HAN}]+"


def _ngrams(run: Column, n: int) -> Column:
    return F.when(
        F.length(run) >= n,
        F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, n)),
    ).otherwise(F.array().cast("array<string>"))


def _han_tokens(lowered: Column, sizes: tuple[int, ...], terms: list[str]) -> Column:
    runs = F.regexp_extract_all(lowered, F.lit(_HAN_RUN), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda run: F.concat(*[_ngrams(run, n) for n in sizes])))
    if not terms:
        return grams
    return F.concat(grams, F.filter(F.lit(terms), lambda term: F.contains(lowered, term)))


def index_tokens(text: Column, terms: list[str] = P.SUBJECT_TERMS, keep_bare: bool = True) -> Column:
    """Lower-case words; Han runs give single characters, pairs and the listed terms.

    With ``keep_bare`` a text without any token is indexed as it stands.
    """
    long_terms = [t for t in terms if len(t) > 2]

    def build(lowered: Column) -> Column:
        latin = F.regexp_extract_all(lowered, F.lit(LATIN_RUN), F.lit(0))
        tokens = F.when(
            lowered.rlike(_HAN_RUN), F.concat(latin, _han_tokens(lowered, (1, 2), long_terms))
        ).otherwise(latin)
        if not keep_bare:
            return tokens
        return let(tokens, lambda found: F.when(F.size(found) == 0, F.array(lowered)).otherwise(found))

    return let(F.lower(text), build)


def query_tokens(text: Column, limit: int = P.QUERY_TOKENS, terms: list[str] = P.SUBJECT_TERMS) -> Column:
    """Distinct tokens, longest first, single Han characters dropped, at most ``limit``."""
    long_terms = [t for t in terms if len(t) > 2]

    def build(lowered: Column) -> Column:
        tokens = F.array_distinct(
            F.concat(
                F.regexp_extract_all(lowered, F.lit(LATIN_RUN), F.lit(0)),
                F.when(lowered.rlike(_HAN_RUN), _han_tokens(lowered, (2,), long_terms)).otherwise(
                    F.array().cast("array<string>")
                ),
            )
        )
        kept = F.filter(tokens, lambda t: (F.length(t) >= 2) | t.rlike(r"^[\x{0}-\x{7f}]$"))
        return longest(kept, limit)

    return let(F.lower(text), build)


def term_counts(tokens: Column) -> Column:
    """``array<struct<token,tf>>`` of a token list, by run lengths of the sorted list.

    The counting stays inside the row, so an index build needs no shuffle.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("token"), (F.coalesce(F.get(s, k + 1), F.size(ordered)) - at).alias("tf")
                ),
            ),
        )

    # ``sort_array`` compares strings itself, ``array_sort`` through a function of two columns.
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs))


def words(text: Column, min_chars: int = 2, terms: list[str] = P.SUBJECT_TERMS) -> Column:
    """Distinct words of at least ``min_chars`` characters, case kept: Latin words in text order,
    then the pairs of Han runs and the listed terms."""
    long_terms = [t for t in terms if len(t) > 2]
    latin = F.regexp_extract_all(text, F.lit(LATIN_RUN), F.lit(0))
    found = F.when(text.rlike(_HAN_RUN), F.concat(latin, _han_tokens(text, (2,), long_terms))).otherwise(latin)
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= min_chars))


def longest(found: Column, n: int) -> Column:
    """The ``n`` longest strings; earlier ones first among equals."""
    ranked = F.array_sort(
        F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("k"), i.alias("i"), t.alias("t")))
    )
    return F.slice(F.transform(ranked, lambda r: r["t"]), 1, n)
