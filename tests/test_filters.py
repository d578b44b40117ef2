from __future__ import annotations

import json

import pytest

from vecspark.operators import filters

THREE = [
    ("f-1", {"country": "BG", "year": 2020, "city": "Varna", "enabled": True, "isOpen": True, "temperature": 10.0, "biz_id": 3, "classification": "typeA", "at": 2000}),
    ("f-2", {"country": "NL", "year": 2022, "city": "Sofia", "enabled": False, "isOpen": True, "temperature": -20.0, "biz_id": 5, "classification": "typeB", "at": 3000}),
    ("f-3", {"country": "US", "year": 2019, "city": "Plovdiv", "enabled": True, "isOpen": False, "temperature": 20.13, "biz_id": -5, "classification": "typeA", "at": 2000}),
]
EIGHT = [
    (i, {"category": c, "year": y, "rating": r})
    for i, c, y, r in zip("abcdefgh", "tech tech animals science tech misc tech other".split(), (2020, 2021, 2019, 2023, 2018, 2022, 2024, 2020), (4.8, 4.2, 4.9, 4.7, 3.0, 4.8, 4.9, 2.0), strict=True)
]


def passing(spark, rows, text, **options) -> str:
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in rows], "id string, metadata string")
    return " ".join(sorted(r["id"] for r in df.where(filters.compile(text, filters.json("metadata"), **options)).collect()))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("country == 'BG' && year >= 2020", "f-1"),
        ("year >= 2020 OR country == 'BG' AND city != 'Sofia'", "f-1 f-2"),
        ("(year >= 2020 OR country == 'BG') AND city NIN ['Sofia', 'Plovdiv']", "f-1"),
        ("NOT(isOpen == true AND year >= 2020 AND country IN ['BG', 'NL', 'US'])", "f-3"),
        ("NOT(isOpen == true AND year >= 2020 AND NOT(country IN ['BG']))", "f-1 f-3"),
        ("temperature >= -15.6 && temperature <= +20.13", "f-1 f-3"),
        ("biz_id == 3", "f-1"),
        ("biz_id == -5", "f-3"),
        ("enabled == true", "f-1 f-3"),
        ("classification != 'typeB'", "f-1 f-3"),
        ("missing IS NULL", "f-1 f-2 f-3"),
        ("missing IS NOT NULL", ""),
        ("at == 2000", "f-1 f-3"),
    ],
)
def test_three_documents(spark, text, expected):
    assert passing(spark, THREE, text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("category == 'tech'", "a b e g"),
        ("category == 'tech' && year >= 2020", "a b g"),
        ("category == 'animals' || rating > 4.85", "c g"),
        ("category IN ['tech', 'science'] AND NOT(year < 2020)", "a b d g"),
        ("category NOT IN ['tech', 'science', 'animals', 'misc']", "h"),
        ("missing == 'x'", ""),
    ],
)
def test_eight_segments(spark, text, expected):
    assert passing(spark, EIGHT, text) == expected


def test_missing_keys(spark):
    rows = [("x", {"n": 1}), ("y", {}), ("z", {"n": None})]
    for text, sql, ordered in [("n < 5", "x", "x y z"), ("n <= 0", "", "y z"), ("n != 1", "y z", "y z"), ("n > 0", "x", "x"), ("n == null", "y z", "y z"), ("n >= null", "", "x y z"), ("n IN [null, 7]", "y z", "y z"), ("!(n < 5)", "y z", "")]:
        assert passing(spark, rows, text) == sql, text
        assert passing(spark, rows, text, null_semantics="ordered") == ordered, text


@pytest.mark.parametrize("text", ["", "a ==", "a == 'b' extra", "(a == 1", "a ~ 1", "== 1", "a IN [1", "a == b"])
def test_bad_text_raises(text):
    with pytest.raises(ValueError):
        filters.parse(text)


def test_unknown_names_raise():
    with pytest.raises(ValueError):
        filters.compile("a == 1", null_semantics="other")
    with pytest.raises(ValueError):
        filters.compile(filters.Leaf("a", "like", "x"))
