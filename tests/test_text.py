import re
import sys
import unicodedata

from pyspark.sql import functions as F

from postmill.functions import text as tx
from postmill.operators.clean import clean_posts, cleaning_report


def python_normal(value):
    """Plain statement of the whitespace rules, for comparison only."""
    if value is None:
        return ""
    value = value.replace("\r\n", "\n").replace("\r", "\n")
    value = re.sub("[ \t\f\v]+", " ", value)
    value = "\n".join(part.strip() for part in value.split("\n")).strip()
    return re.sub("\n{3,}", "\n\n", value)


def apply(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row["o"] for row in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_keeps_style_and_handles_null(spark):
    values = ["  你好   #种草  😊!!!\n\n\n第二行  ", None, "", " \r\n\t", "a\r\rb\r\n \n\n\x0b c", "　a　\n b \x85\n",
              "x\xa0\n\xa0\n\xa0\ny", "\x1c\x1d a  \n\n\n\n b", "a   b", "\n\n a \n\n"]
    assert apply(spark, values, tx.normalize_text) == [python_normal(value) for value in values]


def test_strip_class_is_exactly_what_python_strips(spark):
    points = [p for p in range(0x3100) if not 0xD800 <= p <= 0xDFFF]
    values = ["a" + chr(p) for p in points] + ["a\n" + chr(p) + "b" for p in points]
    assert apply(spark, values, tx.normalize_text) == [python_normal(value) for value in values]


def test_casefold_agrees_with_python_on_every_assigned_code_point(spark):
    points = [p for p in range(1, sys.maxunicode + 1) if unicodedata.category(chr(p)) not in ("Cn", "Cs", "Co")]
    values = ["".join(map(chr, points[i : i + 500])) for i in range(0, len(points), 500)]
    wrong = [i for i, folded in enumerate(apply(spark, values, tx.casefold)) if folded != values[i].casefold()]
    assert wrong == []


def test_template_and_title_only(spark):
    rows = spark.createDataFrame([("标题", "正文"), ("", "正文"), ("标题", ""), ("", "")], "t string, b string")
    got = rows.select(tx.canonical_text(F.col("t"), F.col("b")), tx.is_title_only(F.col("t"), F.col("b"))).collect()
    assert [tuple(row) for row in got] == [
        ("标题：标题\n正文：正文", False), ("正文：正文", False), ("标题：标题", True), ("", False)]


def test_fingerprint_ignores_decoration(spark):
    values = ["今天  真的，绝了！😊", "今天真的绝了", "昨天真的绝了", "Straße_", "STRASSE", "☺️👍🏽a", "A"]
    a, b, c, d, e, f, g = apply(spark, values, tx.text_fingerprint)
    assert a == b != c and d == e and f == g


POST = "note_title string, note_content string, label int"


def test_short_title_is_measured_without_template(spark):
    rows = spark.createDataFrame([("标", "", 1), ("够长的标题", "", 0)], POST)
    assert [row["text"] for row in clean_posts(rows, 3).collect()] == ["标题：够长的标题"]
    report = cleaning_report(rows, 3).first()
    assert report["dropped_short_title_only_rows"] == 1 and report["output_rows"] == 1


def test_rows_without_text_are_dropped(spark):
    rows = spark.createDataFrame([(" 标题 ", " 内容 ", 0), (" ", None, 1)], POST)
    cleaned = clean_posts(rows).collect()
    assert [row["text"] for row in cleaned] == ["标题：标题\n正文：内容"]
    assert cleaned[0]["id"].startswith("human_") and len(cleaned[0]["id"]) == 22
    assert cleaning_report(rows).first()["dropped_empty_text_rows"] == 1
