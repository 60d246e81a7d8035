"""Golden cases of the scalar functions."""

import bisect
import re

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T


def one(spark, col, **values):
    types = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], types or "z int") if values else spark.range(1)
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize("given,want", [("Mara's Gift", "Mara"), ("Mara's", "Mara"), ("'s", ""), ("Mara’s Gift", "Mara’s Gift"), ("", ""), (None, None)])
def test_possessive(spark, given, want):
    assert one(spark, T.strip_possessive(F.col("a")), a=given) == want


@pytest.mark.parametrize("given,want", [('```json\n["A","B"]\n```', ["A", "B"]), ('["A","B","C', ["A", "B"]), ('{"a":1}', []), ('["' + "x" * 50_000 + '","B', ["x" * 50_000]), ("", []), ("text", [])])
def test_keyword_array(spark, given, want):
    assert one(spark, T.parse_keyword_array(F.col("a")), a=given) == want


def test_markup_and_words(spark):
    assert one(spark, T.strip_placeholders(F.col("a")), a="hit %d for {0} [TAG] x") == "hit  for   x"
    assert one(spark, T.english_words(F.col("a")), a="中文hello world <b>tag</b>") == ["tag", "world"]


@pytest.mark.parametrize("given,want", [("abc", "en"), ("漢", "zh"), ("かな", "ja"), ("한", "ko"), ("да", "ru"), ("", "en"), ("x да 漢", "ru")])
def test_language(spark, given, want):
    assert one(spark, T.detect_language(F.col("a")), a=given) == want


def test_vars_and_names(spark):
    assert one(spark, T.apply_vars(F.col("t"), {"a": "1"}), t='{a}{b}{"x":1}') == '1{b}{"x":1}'
    assert one(spark, T.language_display_name(F.col("a")), a="zh") == "Simplified Chinese"
    assert one(spark, T.language_display_name(F.col("a")), a="xx") == "xx"


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("a")), a="中文ab中c d_e f'g") == ["中", "文", "ab中c", "d_e", "f'g"]


def plain_truncate(text, anchors, n):
    spans = [m.span() for m in re.finditer(r"[一-鿿]|[^\W_][^\W]*(?:'[\w']*)*", text)]
    if n <= 0 or len(spans) <= n:
        return text
    low, start = text.lower(), 0
    for a in anchors:
        a = a.strip()
        if len(a) >= 2 and low.find(a.lower()) >= 0:
            start = max(0, bisect.bisect_right([s for s, _ in spans], low.find(a.lower())) - 1) - int(n * 0.4)
            break
    start = min(max(0, start), len(spans) - n)
    a, b = spans[start][0], spans[start + n - 1][1]
    return ("…" if a else "") + text[a:b] + ("…" if b < len(text) else "")


@pytest.mark.parametrize("text,anchors,n", [("a b c d e f g h", ["no"], 3), ("aa bb cc dd ee ff gg hh", ["ee"], 5), ("short", ["x"], 5), ("aa bb, cc. dd! ee", ["dd"], 2), ("aa bb cc", ["aa"], 0)])
def test_truncate(spark, text, anchors, n):
    assert one(spark, T.truncate_reference(F.col("t"), F.col("a"), n), t=text, a=anchors) == plain_truncate(text, anchors, n)


def test_truncate_documents(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").filter("text is not null and lang = 'en'").select("text").limit(40)
    for r in rows.select("text", T.truncate_reference(F.col("text"), F.array(F.lit("the")), 12).alias("x")).collect():
        assert r.x == plain_truncate(r.text, ["the"], 12)


def test_distinct_keeps_first_spelling(spark):
    assert one(spark, T.distinct_ci(F.col("a")), a=["Aa", "B", "aA", "b", "C"]) == ["Aa", "B", "C"]


@pytest.mark.parametrize("s,t,want", [("Hello", " hello ", True), ("Hello there", "你好", False), ("Good morning everyone", "Bonjour tout le monde", True), ("", "x", False), (None, "x", False)])
def test_untranslated(spark, s, t, want):
    assert one(spark, T.likely_untranslated(F.col("s"), F.col("t")), s=s, t=t) is want


def test_fragments(spark):
    assert one(spark, T.untranslated_fragments(F.col("s"), F.col("t")), s="Iron npc Sword", t="铁 sword npc") == ["sword"]
    assert one(spark, T.suspicious_fragments(F.col("s"), F.col("t")), s="Iron Sword", t="铁sword 剑 sword") == ["sword"]
    assert one(spark, T.suspicious_fragments(F.col("s"), F.col("t")), s="Iron Sword", t="铁 sword 剑") == []


def test_parse_translation(spark):
    f = lambda r: one(spark, T.parse_translation(F.col("r"), F.col("s")), r=r, s="src")
    assert f('```json\n{"translation": "剑"}\n```') == "剑"
    assert f('{"other": 1}') == "src"
    assert f('Sure: {"translation": "剑"} done') == "剑"
    assert f("  plain ") == "plain"


def test_strip_blank_kinds(spark):
    assert one(spark, T.strip(F.col("a")), a="\t　 x \n ") == "x"
