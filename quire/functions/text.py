"""Line-level cleaning of page text as column expressions (no UDF, no shuffle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(P.SPACE_CHARS))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def first_n(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def drop_listed_lines(lines: Column, listed: Column | None) -> Column:
    """Remove running headers and footers; blank lines stay as empty strings."""
    blanked = F.transform(lines, lambda l: F.when(strip(l) == "", F.lit("")).otherwise(l))
    if listed is None:
        return blanked
    return F.filter(
        blanked, lambda l: (l == "") | ~F.coalesce(F.array_contains(listed, strip(l)), F.lit(False))
    )


def drop_page_numbers(lines: Column) -> Column:
    return F.filter(lines, lambda l: ~strip(l).rlike(P.PAGE_NUMBER_LINE))


def drop_repeated_lines(lines: Column) -> Column:
    """Drop a line equal to its predecessor, runs of blank lines and leading blank lines.

    A dropped line equals the kept line before it, so comparing with the raw predecessor gives
    the same result as comparing with the last kept one, and the operation needs no fold.
    """
    return let(
        F.transform(lines, strip),
        lambda bare: F.transform(
            F.filter(
                F.arrays_zip(
                    bare.alias("bare"),
                    lines.alias("raw"),
                    F.concat(F.array(F.lit("")), F.slice(bare, 1, F.greatest(F.size(bare) - 1, F.lit(0)))).alias("before"),
                ),
                lambda z: z["bare"] != z["before"],
            ),
            lambda z: F.when(z["bare"] == "", F.lit("")).otherwise(z["raw"]),
        ),
    )


def collapse_repeats(text: Column) -> Column:
    """Three or more equal Han characters, or equal punctuation marks, become one."""
    text = F.regexp_replace(text, rf"([{P.HAN}])\1{{2,}}", "$1")
    return F.regexp_replace(text, r"([，。；：！？、])\1{2,}", "$1")


def join_broken_words(text: Column) -> Column:
    """Rejoin Latin words cut by a line break."""
    text = F.regexp_replace(text, r"([A-Za-z])-\n([a-z])", "$1$2")
    return F.regexp_replace(text, r"([a-z])\n([a-z])", "$1$2")


def _is_title(line: Column) -> Column:
    bare = strip(line)
    return (F.length(bare) <= 30) & bare.rlike(P.TITLE_LINE)


def join_broken_lines(text: Column) -> Column:
    """Append a line to its predecessor unless that one is closed or either is a title."""

    def step(kept: Column, line: Column) -> Column:
        last = F.element_at(kept, -1)
        blank = strip(line) == ""
        join = (
            (strip(last) != "") & ~strip(last).rlike(P.CLOSED_LINE) & ~_is_title(last) & ~_is_title(line)
        )
        head = F.slice(kept, 1, F.size(kept) - 1)
        return (
            F.when(blank & (F.size(kept) == 0), kept)
            .when(blank, F.concat(kept, F.array(F.lit(""))))
            .when(F.size(kept) == 0, F.array(line))
            .when(join, F.concat(head, F.array(F.concat(last, strip(line)))))
            .otherwise(F.concat(kept, F.array(line)))
        )

    return F.array_join(F.aggregate(lines_of(text), F.lit([]).cast("array<string>"), step), "\n")


def clean_text(text: Column, listed: Column | None = None) -> Column:
    """All cleaning steps in their fixed order."""
    lines = drop_page_numbers(drop_listed_lines(lines_of(text), listed))
    joined = F.array_join(drop_repeated_lines(lines), "\n")
    return strip(join_broken_lines(join_broken_words(collapse_repeats(joined))))
