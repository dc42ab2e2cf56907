import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.collection import Database
from lodestone.tools.cli import Shell
from lodestone.tools.guided import build_filter, compile_condition, describe, operators_for, parse_value
from lodestone.tools.inference import default_columns, describe_field, fields_of, infer_schema


def test_guided_filters():
    assert build_filter([("age", "number", "between", "3, 9"), ("name", "string", "contains", "a.b")]) == {"age": {"$gte": 3, "$lte": 9}, "name": {"$regex": r"a\.b", "$options": "i"}}
    assert build_filter([("a", "number", "gt", "1"), ("a", "number", "lt", "5")]) == {"$and": [{"a": {"$gt": 1}}, {"a": {"$lt": 5}}]}
    assert build_filter([("a", "string", "eq", "x"), ("b", "boolean", "isTrue", "")], "any") == {"$or": [{"a": "x"}, {"b": True}]}
    assert build_filter([]) == {}
    assert compile_condition("t", "array", "arrayContainsAll", "x, 5") == {"t": {"$all": ["x", 5]}}
    assert compile_condition("t", "array", "size", "2") == {"t": {"$size": 2}}
    assert compile_condition("o", "object", "jsonEquals", '{"a": 1}') == {"o": {"a": 1}}
    assert compile_condition("d", "date", "gte", "2024-01-31") == {"d": {"$gte": "2024-01-31T00:00:00.000Z"}}
    assert compile_condition("x", "string", "notExists") == {"x": {"$exists": False}}
    assert parse_value("yes", "boolean") is True and parse_value("1.5", "number") == 1.5
    for text, kind in (("abc", "number"), ("maybe", "boolean"), ("soon", "date"), ("{", "object")):
        with pytest.raises(ValueError):
            parse_value(text, kind)
    assert "between" in operators_for("number") and "regex" in operators_for("number", ["number", "string"]) and "exists" in operators_for("boolean")
    assert describe([("age", "number", "gt", "3"), ("x", "string", "exists", "")]) == "age > 3 and x present"


def test_inference_and_shell(spark):
    db = Database(spark)
    docs = spark.createDataFrame([("1", '{"name":"A","age":3,"at":"2024-01-01T00:00:00.000Z","address":{"city":"X"},"tags":["a",1]}'), ("2", '{"name":"B","age":"old","nick":null,"address":{"city":"Y"}}'), ("3", "{bad")], "_id string, data string")
    c = db.register("people", docs, documents=True)
    fields = {f.path: f for f in fields_of(infer_schema(c.rows().where("data_valid"), "doc"))}
    assert fields["name"].count == 2 and fields["name"].presence == 1 and fields["name"].primary_type == "string"
    assert sorted(fields["age"].types) == ["number", "string"] and fields["at"].primary_type == "date" and fields["at"].presence == 0.5
    assert fields["address.city"].depth == 1 and fields["address.city"].distinct_values == ["X", "Y"] and fields["nick"].primary_type == "null"
    assert fields["tags"].primary_type == "array" and fields["name"].low_cardinality
    assert fields["tags"].element_types == ["number", "string"] and fields["tags"].element_fields == []
    assert default_columns(list(fields.values())) == ["age", "name", "at"] and "string" in describe_field(fields["name"])
    shell = Shell(db)
    assert shell.run(".use people") == "using people" and shell.run(".count") == "3" and shell.run('.count {"name": "A"}') == "1"
    assert '"name": "A"' in shell.run('.find {"name": "A"}') and shell.run(".last") and "name" in shell.run(".schema")
    assert shell.run(".distinct name").split() == ['"A"', '"B"'] or set(shell.run(".distinct name").split()) == {'"A"', '"B"'}
    assert shell.run(".sql SELECT count(*) AS n FROM people").split() == ["n", "3"]
    assert "unknown command" in shell.run(".nope") and shell.run(".find {").startswith("error")
    assert "people" in shell.run(".collections") and shell.run(".group name").count("\n") == 1


def test_long_values_are_told_apart(spark):
    long = "x" * 300
    df = spark.createDataFrame([(long + str(i), [{"b": 1}]) for i in range(30)], "t string, l array<struct<b:int>>")
    typed = {f.path: f for f in fields_of(infer_schema(df))}
    assert typed["t"].distinct_values is None and not typed["t"].low_cardinality and typed["l"].element_fields == ["b"] and typed["l"].element_types == ["object"]
    docs = df.select(F.parse_json(F.to_json(F.struct("*"))).alias("doc"))
    stored = {f.path: f for f in fields_of(infer_schema(docs, "doc"))}
    assert stored["t"] == typed["t"] and stored["l"].element_fields == ["b"] and stored["l"].element_types == ["object"]


def test_catalogue_on_the_smallest_tables(spark):
    """Some queries against their SQL; the driver compares all of them."""
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    con = duckdb.connect()
    for name in ("orders", "lineitem", "customer", "events", "part", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name in ("pricing_summary", "elem_match", "doc_in_mixed", "upd_nested", "coalesce_log", "group_first_last"):
        mine = queries[name](spark, "/root/testdata/sf0.001").toPandas()
        theirs = con.execute(sql[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns) and len(mine) == len(theirs)
    assert __spark_entry__.entry(spark).count() > 0
    assert not [n for n in sql if n not in queries]
