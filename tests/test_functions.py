import ast
import datetime as dt

import pytest
from pyspark.sql import functions as F

from growthlens.functions.dates import age_days, month_key, parse_week_start, read_week, to_utc
from growthlens.functions.topics import topic_count, topic_flags, topic_list
from growthlens.functions.values import clean_text, drop_na_tokens, filled_text, half_even, is_known, per, percent, to_number, whole_or


def of(spark, values, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    got = df.select("i", *(e.alias(f"e{k}") for k, e in enumerate(exprs))).orderBy("i").collect()
    return [r[1] if len(exprs) == 1 else tuple(r[1:]) for r in got]


def test_topic_count(spark):
    cases = {None: 0, "": 0, "  ": 0, "[]": 0, "[ ]": 0, "a|b|c": 1, "python": 1, "123": 1, "a,b,,c": 3, "a, ,b": 2, "['a','b']": 2, '["A"]': 1, "[a, b]": 2, "1,2": 2, ",\t,": 0}
    assert of(spark, list(cases), "string", topic_count(F.col("x"))) == list(cases.values())
    assert of(spark, ["a|b|c", "a,b"], "string", topic_count(F.col("x"), "|")) == [3, 1]


LITERALS = [
    "['a',]", "['a' 'b']", "['a', \"b\" , 'c d']", "[ 'x,y' ]", "[u'a', r'b']", "['it\\'s', 'a\\tb']", "[1, 2.5, None, True]", "['']", "[,]", "['a' b]", "['a'", "['a'] x", "[a, b]", "['a',,]", "[\"a\"\"b\"]",
    "[\'\'\'a\'b\'\'\', 'c']", "['a\\\\', 'b']", "('a', 'b')", "['é', '漢字']",
]


@pytest.mark.parametrize("text", LITERALS)
def test_list_literals(spark, text):
    """As a Python literal where it is a list, else by commas."""
    try:
        parsed = ast.literal_eval(text)
    except (ValueError, SyntaxError):
        parsed = None
    parts = [x.strip() for x in text.split(",") if x.strip()]
    count = len(parsed) if isinstance(parsed, list) else len(parts) if "," in text else 1
    items = [str(x).lower() for x in parsed] if isinstance(parsed, list) else [x.lower() for x in parts]
    assert of(spark, [text], "string", topic_count(F.col("x")), topic_list(F.col("x"))) == [(count, items)]


def test_long_list_literal(spark):
    text = "[" + ", ".join(f"'topic {i}'" for i in range(60_000)) + "]"
    assert of(spark, [text], "string", topic_count(F.col("x"))) == [60_000]


def test_topic_list_and_flags(spark):
    assert of(spark, ["['A','b']", "X, ,y", None, "[]"], "string", topic_list(F.col("x"))) == [["a", "b"], ["x", "y"], [], []]
    flags = topic_flags(F.col("x"))
    names = list(flags)
    got = of(spark, ["html", "maintain", "Deep-Learning", "webpack", None, "machine learning"], "string", *flags.values())
    set_ = [{n for n, v in zip(names, r) if v} for r in got]
    assert set_[0] == {"has_ml_topic"} and "has_ai_topic" in set_[1] and set_[2] == {"has_deep_learning_topic"} and set_[3] == {"has_web_topic"}
    assert set_[4] == set() and "has_ml_topic" not in set_[5]


def test_text(spark):
    got = of(spark, [None, "   ", " \t hi\n ", "😀a"], "string", clean_text(F.col("x")), F.length(clean_text(F.col("x"))))
    assert got == [("No Description", 14), ("No Description", 14), ("hi", 2), ("😀a", 2)]
    assert of(spark, [None, "", " "], "string", filled_text(F.col("x"), "Unknown")) == ["Unknown", "Unknown", " "]
    assert of(spark, [None, "x", ""], "string", is_known(F.col("x"))) == [0, 1, 1]
    assert of(spark, ["NA", "nan", "None", "", "x", None], "string", drop_na_tokens(F.col("x"))) == [None, None, None, None, "x", None]


def test_numbers(spark):
    assert of(spark, ["1.5", "x", None, "NaN"], "string", to_number(F.col("x"))) == [1.5, None, None, None]
    assert of(spark, ["7", "x", None, "3000000000", "2.7", "-2.7", "inf", "1e30", "9007199254740993"], "string", whole_or(F.col("x"), 1)) == [7, 1, 1, 3_000_000_000, 2, -2, 1, 1, 9007199254740993]
    assert of(spark, [3e9, float("inf"), float("nan"), None, 1e300], "double", whole_or(F.col("x"), 0)) == [3_000_000_000, 0, 0, 0, 0]
    assert of(spark, [0.125, 0.135, 2.5], "double", half_even(F.col("x"))) == [0.12, 0.14, 2.5]
    assert of(spark, [0.0, 5.0], "double", percent(F.col("x"), F.lit(0)), per(F.col("x"), F.lit(4))) == [(None, 0.0), (None, 1.0)]


def test_age_and_weekday(spark):
    cases = {"2026-06-14 00:10": (0, 6), "2026-06-14 00:00": (0, 6), "2026-06-13 18:00": (0, 5), "2026-06-12 23:59:59": (1, 4), "2025-06-14 00:00": (365, 5), "nope": (None, None)}
    at = to_utc(F.col("x"))
    assert of(spark, list(cases), "string", age_days(at), F.weekday(at)) == list(cases.values())


def test_week_start(spark):
    day = dt.date(2010, 3, 22)
    assert of(spark, ["2010-03-22/2010-03-28", "2010-03-22", None, "nope", "2010"], "string", parse_week_start(F.col("x"))) == [day, day, None, None, dt.date(2010, 1, 1)]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2025-03-24/2025-03-30", "2025-03-24"), (" 2025-03-26 / 2025-03-30 ", "2025-03-24"), ("2025-03-30", "2025-03-24"), ("2025-W07", "2025-02-10"), ("20250203/20250209", "2025-02-03"),
        ("2025/03/17-2025/03/23", "2025-03-17"), ("2025-09-29T00:00:00Z/2025-10-05T23:59:59Z", "2025-09-29"), ("14.04.2025/20.04.2025", "2025-04-14"), ("2025.04.14", "2025-04-14"),
        ("0000-00-00/0000-00-00", None), ("2025-02-30/2025-03-05", None), ("31.04.2025", None), ("2025-W54", None), ("2025-W53", None), ("2026-W53", "2026-12-28"), ("2025-W00", None),
        ("unknown", None), ("", None), ("n/a", None), (None, None), ("2025123", None), ("2025-03-031", None), ("2020-W53", "2020-12-28"), ("2024-12-30", "2024-12-30"), (" 2025-03-24", "2025-03-24"),
    ],
)
def test_read_week(spark, text, expected):
    got = of(spark, [text], "string", read_week(F.col("x")))[0]
    assert (str(got) if got else None) == expected


def test_month_key(spark):
    assert of(spark, [dt.datetime(2025, 3, 4, 5, 6), None], "timestamp_ntz", month_key(F.col("x"))) == ["2025-03", "unknown"]
