import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rubrika.functions import text as X


def apply(spark, expression, values):
    df = spark.createDataFrame(list(enumerate(values)), "i long, s string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("s"))).collect()]


CLEANED = {
    "<b>Breaking News</b>: Market rallies.": "Breaking News : Market rallies.",
    "Read more at https://example.com/news/article123": "Read more at",
    "": "",
    "a <b\nc> d": "a <b c> d",
    "a <b\rc> d": "a d",
    "a <b c> d": "a d",
    "x <> y": "x y",
    "a < b and c > d": "a d",
    "x < y, no end": "x < y, no end",
    "<<a> b>": "b>",
    "fish &amp; chips": "fish chips",
    "&AMP; &#39; &frac12; &;": "&AMP; &#39; &frac12; &;",
    "http://x?a=1&amp;b=2 z": "b=2 z",
    "HTTP://X": "HTTP://X",
    "bare http": "bare http",
    "xhttpd y": "x y",
    "www.a": "",
    "www. a": "www. a",
    "see www.a.b/c, then": "see then",
    "a b　c\x1cd\x1fe\x85f": "a b c d e f",
    "zero​width": "zero​width",
    "  ends \t\n": "ends",
    "ht<i>tp://x": "ht tp://x",
    None: "",
}


def test_clean_text(spark):
    assert dict(zip(CLEANED, apply(spark, X.clean_text, list(CLEANED)))) == CLEANED


def test_clean_text_of_other_types(spark):
    row = spark.range(1).select(
        X.clean_text(F.lit(123)).alias("number"),
        X.clean_text(F.array(F.lit("a"))).alias("list"),
        X.clean_text(F.lit(None)).alias("nothing"),
    ).first()
    assert list(row) == ["", "", ""]


def test_spaces_are_unicode_spaces(spark):
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    points = [p for p in points if p < 0x10000 or p % 97 == 0]
    found = apply(spark, lambda s: s.rlike(X.SPACE), [chr(p) for p in points])
    expected = [bool(re.match(r"\s", chr(p))) for p in points]
    assert [p for p, a, b in zip(points, found, expected) if a != b] == []


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.text(alphabet="ab<>&;h\n\r \t  tpw.é", max_size=40)
        | st.lists(
            st.sampled_from(["http", "www.", "&amp;", "<i>", "<", ">", "\n", " ", "x", "　"]),
            max_size=12,
        ).map("".join),
        min_size=1,
        max_size=60,
    )
)
def test_cleaning_properties(spark, texts):
    for before, after in zip(texts, apply(spark, X.clean_text, texts)):
        assert after == after.strip() and not re.search(r"\s\s|[^\S ]", after)
        assert not re.search(r"&[a-z]+;", after) or "<" in before or "&" in after
        assert not re.search(r"www\.\S", after) and not re.search(r"http\S", after)
        kept = re.sub(r"\s", "", after)
        remaining = iter(before)
        assert all(letter in remaining for letter in kept)


def test_marked_and_unmarked_texts_take_one_meaning(spark):
    """The quick way for texts without markers gives what the full way gives."""
    texts = ["plain  text", "a\tb", "q <w> e", "only &lt; here", "go http://a b"]

    def full(s):
        for pattern in (X.TAG, X.ENTITY, X.URL, f"{X.SPACE}+"):
            s = F.regexp_replace(s, pattern, " ")
        return F.trim(s)

    assert apply(spark, X.clean_text, texts) == apply(spark, full, texts)


def test_combine_keeps_the_separator(spark):
    df = spark.createDataFrame([("<b>T</b>", "B  b"), (None, "x"), ("y", None)], "t string, d string")
    rows = df.select(X.combine_title_body(F.col("t"), F.col("d"))).collect()
    assert [r[0] for r in rows] == ["T [SEP] B b", " [SEP] x", "y [SEP] "]


@pytest.mark.parametrize("blank", [None, "", "   \n\t  ", " 　", "\x1c"])
def test_blank(spark, blank):
    assert apply(spark, X.is_blank, [blank, "x", "​"]) == [True, False, False]


def test_tokens(spark):
    texts = ["Élan, DÉJÀ-vu!", "naïve Ångström 42", "été", "", None, "straße €5", "日本 x"]
    assert apply(spark, X.tokens, texts) == [
        ["elan", ",", "deja", "-", "vu", "!"],
        ["naive", "angstrom", "42"],
        ["ete"],
        [],
        [],
        ["straße", "€", "5"],
        ["日本", "x"],
    ]


def test_truncate_and_preview_count_characters(spark):
    long = "😀" * 5000
    assert apply(spark, X.truncate, [long, "ab"]) == ["😀" * 4000, "ab"]
    assert apply(spark, X.preview, [long, "x" * 300, "x" * 301]) == [
        "😀" * 300 + "...",
        "x" * 300,
        "x" * 300 + "...",
    ]


def test_percent_text_rounds_as_printing_does(spark):
    shares = [i / 10000 for i in range(10001)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    found = {r[0]: r[1] for r in df.select("s", X.percent_text(F.col("s"))).collect()}
    assert {s: t for s, t in found.items() if t != f"{s * 100:.1f}"} == {}


def test_utc_date_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        seconds = spark.createDataFrame([(0,), (86399,), (-1,)], "s long")
        days = seconds.select(X.utc_date(F.timestamp_seconds("s")).cast("string"))
        assert [r[0] for r in days.collect()] == ["1970-01-01", "1970-01-01", "1969-12-31"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
