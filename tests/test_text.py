"""Cleaning, headings, numerals, tokens: single expressions on single texts."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions import titles as T
from quire.functions import tokens as K


def by_line(step):
    return lambda c: F.array_join(step(X.lines_of(c)), "\n")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("拉格朗日中值定理\n拉格朗日中值定理\n下一行", "拉格朗日中值定理\n下一行"),
        ("\n\na\n\n\nb", "a\n\nb"),
        ("a\n\na", "a\n\na"),
        ("a \n a\na\nb", "a \nb"),
        ("", ""),
    ],
)
def test_repeated_lines(value, text, expected):
    assert value(text, by_line(X.drop_repeated_lines)) == expected


def test_collapse_repeats(value):
    assert value("拉格朗日日日日", X.collapse_repeats) == "拉格朗日"
    assert value("好好好好学", X.collapse_repeats) == "好学"
    assert value("好好学。。。", X.collapse_repeats) == "好好学。"


def test_broken_words(value):
    assert value("The func-\ntion is", X.join_broken_words) == "The function is"
    assert value("compu\nter", X.join_broken_words) == "computer"
    assert value("End\nNew", X.join_broken_words) == "End\nNew"


def test_broken_lines(value):
    assert value("拉格朗日中值定理指出\n若函数连续", X.join_broken_lines) == "拉格朗日中值定理指出若函数连续"
    assert value("第一章 函数\n正文", X.join_broken_lines) == "第一章 函数\n正文"
    assert value("完。\n正文", X.join_broken_lines) == "完。\n正文"


def test_clean_text(value):
    header = F.array(F.lit("高等数学"))
    assert value("高等数学\n第一章 函数\n5", lambda c: X.clean_text(c, header)) == "第一章 函数"


def test_strip_is_unicode_aware(value):
    assert value("　 a \n", X.strip) == "a"


@pytest.mark.parametrize(
    "text, number",
    [("十二", 12), ("三", 3), ("二十", 20), ("一百零五", 105), ("二千三百", 2300), ("一万二千", 12000), ("20", 20), ("x", None)],
)
def test_numerals(value, text, number):
    assert value(text, T.numeral_value) == number


@pytest.mark.parametrize(
    "style, level",
    [("Heading 2", 2), ("heading3", 3), ("标题三", 3), ("大标题", 1), ("标题 4", 4), ("标题 9", None), ("Normal", None), (None, None)],
)
def test_style_level(value, style, level):
    assert value(style, T.style_level) == level


def test_heading_cleanup(value):
    assert value("公 共 管 理 导 论   3", T.clean_heading) == "公共管理导论"
    assert value("财政 (public", T.clean_heading) == "财政"
    assert value("概念（4）", T.clean_office_heading) == "概念"
    assert value("a\n# b\n##### c\n####### d", T.downgrade_headings) == "a\n### b\n###### c\n####### d"


def test_index_tokens(value):
    assert len(value("拉格朗日中值定理", K.index_tokens)) > 1
    assert value("！！", K.index_tokens) == ["！！"]
    assert value("Été 2024", K.index_tokens) == ["été", "2024"]


def test_query_tokens(value):
    assert value("!!!", K.query_tokens) == []
    tokens = value("概率与统计 2024!", K.query_tokens)
    assert "2024" in tokens and not any(c in t for t in tokens for c in "!,.")
    assert value("a bb a 日 ccc", K.query_tokens) == ["ccc", "bb", "a"]
    assert len(value(" ".join(f"w{i}" for i in range(20)), K.query_tokens)) == 8


def test_term_counts(value):
    counted = value("b a b c b", lambda c: K.term_counts(K.index_tokens(c)))
    assert [(r.token, r.tf) for r in counted] == [("a", 1), ("b", 3), ("c", 1)]
