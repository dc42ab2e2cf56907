import datetime as dt
import json

import pytest

from lodestone.operators.filters import Root, compile_filter
from lodestone.operators.updates import apply_update, update_frame

SCHEMA = "_id string, n long, s string, tags array<string>, a struct<b long, c string>, objs array<struct<k long>>"
ROW = {"_id": "1", "n": 5, "s": "x", "tags": ["p", "q", "p"], "a": {"b": 1, "c": "d"}, "objs": [{"k": 1}, {"k": 2}]}
EMPTY = {"_id": "2", "n": None, "s": None, "tags": None, "a": None, "objs": None}
CASES = [
    {"$set": {"n": 7, "a.b": 9}},
    {"$set": {"a": {"b": 3, "c": "z"}}},
    {"$unset": {"s": ""}},
    {"$unset": {"a.c": ""}},
    {"$inc": {"n": 3}},
    {"$inc": {"a.b": -1}},
    {"$mul": {"n": 4}},
    {"$min": {"n": 2}},
    {"$max": {"n": 2}},
    {"$push": {"tags": "r"}},
    {"$push": {"tags": {"$each": ["r", "s"]}}},
    {"$pull": {"tags": "p"}},
    {"$pull": {"objs": {"k": 1}}},
    {"$addToSet": {"tags": "q"}},
    {"$addToSet": {"tags": {"$each": ["q", "t", "t"]}}},
    {"$pop": {"tags": 1}},
    {"$pop": {"tags": -1}},
    {"$set": {"n": 1}, "$inc": {"n": 2}},
]


def clean(doc):
    """A typed null is a missing field."""
    if isinstance(doc, dict):
        out = {k: clean(v) for k, v in doc.items()}
        return {k: v for k, v in out.items() if v is not None and v != {}}
    return doc


@pytest.mark.parametrize("update", CASES, ids=json.dumps)
def test_frames_and_documents_agree(spark, update):
    df = spark.createDataFrame([ROW, EMPTY], SCHEMA)
    out = {r["_id"]: clean(r.asDict(recursive=True)) for r in update_frame(df, compile_filter({}, Root.of(df)), update).collect()}
    for row in (ROW, EMPTY):
        assert out[row["_id"]] == clean(apply_update(clean(row), update))


def test_only_matches_change_and_new_fields(spark):
    df = spark.createDataFrame([ROW, EMPTY], SCHEMA)
    out = {r["_id"]: r for r in update_frame(df, compile_filter({"n": 5}, Root.of(df)), {"$set": {"fresh.deep": 1.5, "s": "new"}, "$inc": {"hits": 1}}).collect()}
    assert out["1"]["fresh"]["deep"] == 1.5 and out["1"]["hits"] == 1 and out["1"]["s"] == "new"
    assert out["2"]["fresh"] is None and out["2"]["hits"] is None and out["2"]["s"] is None


def test_errors(spark):
    df = spark.createDataFrame([ROW], SCHEMA)
    every = compile_filter({}, Root.of(df))
    for bad in ({"$rename": {"n": "m"}}, {"n": 1}, {}, {"$currentDate": {"n": 5}}, {"$set": {"_id": "9"}}):
        with pytest.raises(ValueError):
            update_frame(df, every, bad)
    with pytest.raises(TypeError):
        update_frame(df, every, {"$set": {"n": "text"}})


def test_document_corners():
    now = dt.datetime(2024, 1, 2, 3, 4, 5, 678000, dt.timezone.utc)
    assert apply_update({}, {"$currentDate": {"at": True, "ms": {"$type": "timestamp"}}}, now) == {"at": "2024-01-02T03:04:05.678Z", "ms": 1704164645678}
    assert apply_update({"n": "text"}, {"$inc": {"n": 1}}) == {"n": "text"}
    assert apply_update({"n": ""}, {"$inc": {"n": 1}}) == {"n": 1}
    assert apply_update({"n": "text"}, {"$mul": {"n": 3}}) == {"n": 0}
    assert apply_update({"t": "text"}, {"$push": {"t": 1}}) == {"t": "text"}
    assert apply_update({"t": "text"}, {"$addToSet": {"t": 1}}) == {"t": [1]}
    assert apply_update({"a": 5}, {"$set": {"a.b": 1}}) == {"a": {"b": 1}}
    assert apply_update({"a": [1, 2]}, {"$set": {"a.1": 9}}) == {"a": [1, 9]}
    assert apply_update({"n": 3}, {"$min": {"m": 4}, "$max": {"n": 9}}) == {"n": 9, "m": 4}
    assert apply_update({"o": [{"a": 1, "b": 2}]}, {"$pull": {"o": {"b": 2, "a": 1}}}) == {"o": []}
