import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions.paths import parse, variant_path
from lodestone.functions.patterns import to_java
from lodestone.operators.filters import Root, compile_filter

ROWS = [
    {"_id": "1", "n": 10, "tags": ["a", "b", "c"], "s": "hello", "opt": "present", "mixed": 42},
    {"_id": "2", "n": 11, "tags": ["a"], "s": "world", "mixed": "str"},
    {"_id": "3", "n": 15, "tags": [], "s": "Hello", "mixed": None},
]
BOTH = [
    ({"n": {"$eq": 10}}, "1"),
    ({"n": {"$ne": 10}}, "23"),
    ({"n": {"$gt": 10}}, "23"),
    ({"n": {"$gte": 11}}, "23"),
    ({"n": {"$lt": 11}}, "1"),
    ({"n": {"$lte": 10}}, "1"),
    ({"n": {"$in": [10, 15]}}, "13"),
    ({"n": {"$nin": [10, 15]}}, "2"),
    ({"tags": {"$all": ["a", "b"]}}, "1"),
    ({"opt": {"$exists": True}}, "1"),
    ({"opt": {"$exists": False}}, "23"),
    ({"n": {"$not": {"$gt": 10}}}, "1"),
    ({"s": {"$regex": "hello", "$options": "i"}}, "13"),
    ({"s": re.compile("^h")}, "1"),
    ({"tags": {"$size": 1}}, "2"),
    ({"n": {"$mod": [5, 0]}}, "13"),
    ({"n": {"$mod": [0, 0]}}, ""),
    ({"opt": {"$nin": ["present"]}}, "23"),
    ({"s": {"$in": ["hello", "world"]}}, "12"),
    ({"s": {"$nin": ["hello"]}}, "23"),
    ({"tags": {"$in": ["b"]}}, "1"),
    ({"tags": "a"}, "12"),
    ({"tags": {"$ne": "a"}}, "3"),
    ({"tags": ["a"]}, "2"),
    ({"tags": {"$all": []}}, ""),
    ({"tags": {"$elemMatch": {"$gt": "a", "$lt": "c"}}}, "1"),
    ({"tags[1]": "b"}, "1"),
    ({"tags.0": "a"}, "12"),
    ({"$and": [{"n": {"$gte": 10}}, {"n": {"$lte": 11}}]}, "12"),
    ({"$or": [{"n": 10}, {"n": 15}]}, "13"),
    ({"$nor": [{"n": 10}, {"opt": "present"}]}, "23"),
    ({"$not": {"n": 10, "s": "hello"}}, "23"),
    ({"opt": None}, "23"),
    ({"opt": {"$ne": None}}, "1"),
    ({"opt": {"$in": [None]}}, "23"),
    ({"n": {"$gt": "5"}}, ""),
    ({"s": {"$lt": 5}}, ""),
    ({"n": {"$in": []}}, ""),
    ({"n": {"$nin": []}}, "123"),
    ({"_id": {"$in": ["1", "3"]}}, "13"),
    ({"$exists": {"opt": True, "n": True}}, "1"),
    ({"$text": {"$search": "WORLD"}}, "2"),
    ({"$text": {"$search": " "}}, ""),
    ({"s": {"$regex": "("}}, ""),
    ({"s": {"$type": "string"}}, "123"),
    ({"tags": {"$type": 4}}, "123"),
    ({}, "123"),
]
DOC_ONLY = [
    ({"mixed": {"$type": "string"}}, "2"),
    ({"mixed": {"$type": "null"}}, "3"),
    ({"mixed": {"$type": ["number", "null"]}}, "13"),
    ({"mixed": {"$exists": True}}, "123"),
    ({"mixed": None}, "3"),
    ({"mixed": {"$gt": 40}}, "1"),
    ({"mixed": {"$gte": "s"}}, "2"),
    ({"mixed": {"$in": [42, None]}}, "13"),
    ({"mixed": {"$nin": ["str", None]}}, "1"),
]


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame([{**{"opt": None}, **{k: v for k, v in r.items() if k != "mixed"}} for r in ROWS], "_id string, n long, tags array<string>, s string, opt string").cache()


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(r["_id"], json.dumps({k: v for k, v in r.items() if k != "_id"})) for r in ROWS]
    return spark.createDataFrame(rows, "_id string, data string").select("_id", F.try_parse_json("data").alias("doc")).cache()


def ids(df, query, document=None):
    return "".join(sorted(r["_id"] for r in df.filter(compile_filter(query, Root.of(df, document))).collect()))


@pytest.mark.parametrize("query,want", BOTH, ids=str)
def test_typed_and_document_tiers_agree(typed, documents, query, want):
    assert ids(typed, query) == want
    assert ids(documents, query, "doc") == want


@pytest.mark.parametrize("query,want", DOC_ONLY, ids=str)
def test_documents_know_missing_from_null(documents, query, want):
    assert ids(documents, query, "doc") == want


def test_nested_objects_and_arrays_of_objects(spark):
    df = spark.createDataFrame(
        [("1", ("London", ("x", 1)), [("a", 1), ("b", 2)]), ("2", ("Paris", ("y", 2)), [("a", 5)]), ("3", None, None)],
        "_id string, address struct<city string, geo struct<k string, v long>>, items array<struct<name string, qty long>>",
    )
    assert ids(df, {"address.city": "London"}) == "1"
    assert ids(df, {"address.geo.v": {"$gte": 2}}) == "2"
    assert ids(df, {"address": {"city": "Paris", "geo": {"k": "y", "v": 2}}}) == "2"
    assert ids(df, {"items": {"$elemMatch": {"name": "a", "qty": {"$gt": 1}}}}) == "2"
    assert ids(df, {"items": {"$all": [{"name": "a"}, {"name": "b", "qty": 2}]}}) == "1"
    assert ids(df, {"items": {"$in": [{"name": "b"}]}}) == "1"
    assert ids(df, {"$all": {"items": [{"name": "a"}]}}) == "12"
    assert ids(df, {"items[0].qty": 5}) == "2"
    assert ids(df, {"address.city": {"$not": {"$eq": "London"}}}) == "23"
    assert ids(df, {"absent.field": None}) == "123" and ids(df, {"absent": 1}) == ""


def test_dates(spark):
    df = spark.createDataFrame([("1", dt.datetime(2024, 1, 1), "2024-01-01T00:00:00.000Z"), ("2", dt.datetime(2024, 2, 1, 15, 45), "2024-02-01T15:45:00.000Z")], "_id string, t timestamp, iso string")
    assert ids(df, {"t": dt.datetime(2024, 1, 1)}) == "1"
    assert ids(df, {"t": {"$gt": dt.date(2024, 1, 15)}}) == "2"
    assert ids(df, {"t": {"$lte": "2024-01-01T00:00:00.000Z"}}) == "1"
    assert ids(df, {"iso": {"$gte": dt.datetime(2024, 2, 1, 15, 45)}}) == "2"
    assert ids(df, {"t": {"$in": [dt.datetime(2024, 1, 1), dt.datetime(2020, 1, 1)]}}) == "1"
    assert ids(df, {"t": {"$type": "date"}}) == "12" and ids(df, {"t": {"$gt": 5}}) == ""


def test_errors_and_lenient_mode(typed):
    root = Root.of(typed)
    for bad in ({"n": {"$near": 1}}, {"$where": "1"}, {"$and": []}, {"$or": {}}):
        with pytest.raises(ValueError):
            compile_filter(bad, root)
    with pytest.raises(TypeError):
        compile_filter({"_id": 5}, root)
    with pytest.raises(TypeError):
        compile_filter({"n": {"$in": 3}}, root)
    assert typed.filter(compile_filter({"n": {"$near": 1}}, root, strict=False)).count() == 0
    assert ids(typed, {"s": "present"}) == ""
    assert typed.filter(compile_filter({"s": "ELL"}, root, eq_mode="contains")).count() == 2


def test_simple_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as k", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = df.filter(compile_filter({"k": {"$gte": 3, "$lt": 5}, "s": {"$in": ["3", "10"]}}, Root.of(df))).select("id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,3)" in plan and "In(s" in plan and "Python" not in plan


def test_paths_and_patterns():
    assert parse("a.b[0].c") == parse("a.b.0.c") == ("a", "b", 0, "c")
    assert variant_path(("a", "b c", 1)) == "$['a']['b c'][1]"
    for bad in ("", ".a", "a.", "a..b", "[0]"):
        with pytest.raises(ValueError):
            parse(bad)
    assert to_java("^a$", "i") == r"(?i)^a\z" and to_java(r"\$[$]$", "m") == r"(?m)\$[$]$"
    assert to_java("[^]x[]") == r"[\s\S]x(?!)"
