"""Clean-up of heading texts, numerals in headings, style names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import let, strip


def join_spaced_han(text: Column) -> Column:
    """Remove letter-spacing between Han characters."""
    return F.regexp_replace(text, rf"(?<=[{P.HAN}])[{P.SPACE}]+(?=[{P.HAN}])", "")


def clean_heading(raw: Column, tails: list[str] = P.PROSE_TAILS) -> Column:
    """Strip page numbers, a dangling Latin bracket, known prose tails and letter-spacing."""
    text = F.regexp_replace(strip(raw), rf"[{P.SPACE}]*[0-9{P.SPACE}]+$", "")
    text = F.regexp_replace(text, rf"\([a-zA-Z{P.SPACE}]+$", "")
    # The first tail on its own, then the others in one pass: cutting one exposes no other.
    for pattern in (tails[0], "|".join(tails[1:])):
        text = F.regexp_replace(text, pattern, "")
    return F.btrim(join_spaced_han(text), F.lit(" ，。、|｜"))


def clean_outline_title(raw: Column) -> Column:
    """Title clean-up of the three-level scan."""
    text = F.regexp_replace(strip(raw), rf"[{P.SPACE}]*[0-9]+[.．、]?[{P.SPACE}]*$", "")
    text = F.regexp_replace(text, rf"[{P.SPACE}]*[0-9]+$", "")
    text = F.regexp_replace(text, rf"厂[{P.SPACE}]*$", "")
    text = F.regexp_replace(text, rf"[（(][^）)]*[)）][{P.SPACE}]*$", "")
    return F.btrim(join_spaced_han(text), F.lit(" ，。、|｜.．"))


def clean_office_heading(raw: Column) -> Column:
    """Strip page numbers, numbered brackets and exam hints of word-processor headings."""
    text = F.regexp_replace(strip(raw), rf"[{P.SPACE}]*[0-9{P.SPACE}]+$", "")
    text = F.regexp_replace(text, rf"[（(][0-9]+[）)][{P.SPACE}]*$", "")
    text = F.regexp_replace(
        text, rf"20[0-9]{{2}}[{P.SPACE}]*年?[{P.SPACE}]*(?:简答|论述|名词解释|计算|问答|考|预测).*$", ""
    )
    text = F.regexp_replace(text, rf"（20[0-9]{{2}}年?[^）]*）[{P.SPACE}]*$", "")
    return F.btrim(join_spaced_han(text), F.lit(" ，。、|｜:："))


def outline_key(title: Column, level: Column) -> Column:
    """Key under which two headings count as the same."""
    bare = F.regexp_replace(clean_outline_title(title), rf"[{P.SPACE}，。、|｜.．:：—-]+", "")
    return F.concat(level.cast("string"), F.lit("|"), bare)


def _digit(char: Column) -> Column:
    return F.instr(F.lit("一二三四五六七八九"), char)


def _below_ten_thousand(text: Column) -> Column:
    total = F.lit(0)
    for unit, weight in (("千", 1000), ("百", 100), ("十", 10)):
        found = F.regexp_extract(text, f"([一二三四五六七八九]?){unit}", 0)
        lead = F.regexp_extract(text, f"([一二三四五六七八九]?){unit}", 1)
        total = total + F.when(found == "", 0).otherwise(
            F.when(lead == "", weight).otherwise(_digit(lead) * weight)
        )
    last = F.regexp_extract(text, "([一二三四五六七八九])$", 1)
    return total + F.when(last == "", 0).otherwise(_digit(last))


def numeral_value(text: Column) -> Column:
    """Value of a Chinese or decimal numeral; NULL when it is neither."""
    bare = strip(text)
    upper = F.regexp_extract(bare, "^(.*)万", 1)
    lower = F.regexp_replace(bare, "^.*万", "")
    han = _below_ten_thousand(upper) * 10000 + _below_ten_thousand(lower)
    return (
        F.when(bare.rlike("^[0-9]{1,18}$"), bare.cast("bigint"))
        .when(bare.rlike("^[零一二三四五六七八九十百千万]+$"), han.cast("bigint"))
    )


def chapter_number(title: Column) -> Column:
    return numeral_value(F.regexp_extract(title, f"第([{P.NUM}]+)[章篇编]", 1))


def style_level(style: Column) -> Column:
    """Heading level of a paragraph style name, NULL for body text."""
    name = strip(style)
    table = F.create_map([F.lit(x) for item in P.HEADING_STYLES.items() for x in item])
    numbered = F.regexp_extract(F.lower(name), rf"^(?:heading|标题)[{P.SPACE}]*([0-9])", 1)
    han = F.regexp_extract(name, rf"^标题[{P.SPACE}]*([一二三四五六七八九十0-9]+)", 1)
    value = F.instr(F.lit("一二三四五六"), han)
    return (
        F.when(table[F.lower(name)].isNotNull(), table[F.lower(name)])
        .when(numbered != "", F.when(numbered.cast("int").between(1, 6), numbered.cast("int")))
        .when(han != "", F.when((F.length(han) == 1) & (value > 0), value).otherwise(1))
    )


def downgrade_headings(markdown: Column, levels: int = 2) -> Column:
    """Push Markdown headings down so that they nest below the chapter they belong to."""
    return F.array_join(
        F.transform(
            F.split(markdown, "\n"),
            lambda line: F.when(
                line.rlike(r"^#{1,6}[ \t]+.+$"),
                let(
                    F.length(F.regexp_extract(line, "^(#{1,6})", 1)),
                    lambda depth: F.concat(
                        F.repeat(F.lit("#"), F.least(depth + levels, F.lit(6)).cast("int")),
                        F.lit(" "),
                        F.regexp_extract(line, r"^#{1,6}[ \t]+(.+)$", 1),
                    ),
                ),
            ).otherwise(line),
        ),
        "\n",
    )
