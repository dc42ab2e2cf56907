import pytest
from pyspark.sql import functions as F

from lodestone.collection import Collection, distinct_values
from lodestone.operators.pipeline import aggregate
from lodestone.operators.projection import project

ROWS = [
    ("1", "Alice", 10, ["admin", "user"], "A", 85, True),
    ("2", "Bob", 20, ["user"], "B", 60, False),
    ("3", "Charlie", 30, ["user", "mod"], "A", 90, True),
    ("4", "Dave", 40, ["admin"], "C", 72, False),
    ("5", "Eve", 50, ["user"], "B", 45, True),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "_id string, name string, value long, tags array<string>, category string, score long, active boolean").cache()


def rows(df, key="_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_group_accumulators(people):
    out = rows(aggregate(people, [{"$group": {"_id": "$category", "total": {"$sum": "$value"}, "mean": {"$avg": "$score"}, "low": {"$min": "$value"}, "high": {"$max": "$value"}, "n": {"$sum": 1}, "two": {"$sum": 2}, "c": {"$count": {}}, "text": {"$sum": "$name"}, "none": {"$avg": "$name"}}}]))
    assert out["A"] == {"_id": "A", "total": 40, "mean": 87.5, "low": 10, "high": 30, "n": 2, "two": 4, "c": 2, "text": 0.0, "none": None}


def test_ordered_accumulators(people):
    stages = lambda d: [{"$sort": d}, {"$group": {"_id": "$category", "first": {"$first": "$name"}, "last": {"$last": "$name"}, "names": {"$push": "$name"}}}]
    assert rows(aggregate(people, stages({"value": 1})))["A"] == {"_id": "A", "first": "Alice", "last": "Charlie", "names": ["Alice", "Charlie"]}
    assert rows(aggregate(people, stages({"value": -1})))["B"]["names"] == ["Eve", "Bob"]
    assert rows(aggregate(people, stages({"name": -1})))["A"] == {"_id": "A", "first": "Charlie", "last": "Alice", "names": ["Charlie", "Alice"]}
    unsorted = aggregate(people, [{"$group": {"_id": None, "names": {"$push": "$name"}}}], order_by="_id").first()
    assert unsorted["names"] == [r[1] for r in ROWS]


def test_ordered_accumulators_keep_nulls(spark):
    df = spark.createDataFrame([("1", "g", None), ("2", "g", "x"), ("3", "g", None)], "_id string, k string, v string")
    out = aggregate(df, [{"$group": {"_id": "$k", "f": {"$first": "$v"}, "l": {"$last": "$v"}, "p": {"$push": "$v"}}}], order_by="_id").first()
    assert (out["f"], out["l"], out["p"]) == (None, None, [None, "x", None])


def test_group_keys(people):
    assert aggregate(people, [{"$group": {"_id": None, "n": {"$sum": 1}}}]).collect()[0]["n"] == 5
    assert aggregate(people, [{"$match": {"value": 0}}, {"$group": {"_id": None, "n": {"$sum": 1}}}]).count() == 0
    assert aggregate(people, [{"$group": {"_id": 7, "n": {"$sum": 1}}}]).first().asDict() == {"_id": 7, "n": 5}
    compound = aggregate(people, [{"$group": {"_id": {"c": "$category", "k": "fixed"}, "n": {"$sum": 1}}}, {"$match": {"_id.c": "A"}}]).first()
    assert compound["_id"].asDict() == {"c": "A", "k": "fixed"} and compound["n"] == 2
    assert rows(aggregate(people, [{"$group": {"_id": "$absent", "n": {"$sum": 1}}}])) == {None: {"_id": None, "n": 5}}


def test_stages(people):
    out = aggregate(people, [{"$match": {"active": True}}, {"$sort": {"score": -1}}, {"$limit": 2}])
    assert [r["name"] for r in out.collect()] == ["Charlie", "Alice"]
    assert aggregate(people, [{"$unwind": "$tags"}, {"$match": {"tags": "admin"}}]).count() == 2
    assert aggregate(people, [{"$match": {"_id": "1"}}, {"$unwind": {"path": "$tags"}}]).count() == 2
    assert aggregate(people, [{"$unwind": "$name"}]).count() == 5
    assert aggregate(people, [{"$match": {"value": 0}}, {"$count": "n"}]).first()["n"] == 0
    assert [r["name"] for r in aggregate(people, [{"$sort": {"value": 1}}, {"$skip": 1}, {"$limit": 2}]).collect()] == ["Bob", "Charlie"]
    added = aggregate(people, [{"$addFields": {"x": "$name", "k": 1}}]).first()
    assert (added["x"], added["k"]) == ("$name", 1)
    assert aggregate(people, [{"$addFields": {"x": "$name"}}], expressions=True).where("_id = '1'").first()["x"] == "Alice"
    having = aggregate(people, [{"$group": {"_id": "$category", "n": {"$sum": 1}}}, {"$match": {"n": {"$gt": 1}}}])
    assert {r["_id"] for r in having.collect()} == {"A", "B"}
    for bad, error in (([{"$lookup": {}}], NotImplementedError), ([{"$match": {}, "$limit": 1}], ValueError), ([{"$group": {"_id": 1, "x": {"$addToSet": "$a"}}}], NotImplementedError), ([{"$limit": -1}], ValueError), ([{"$group": {}}], ValueError)):
        with pytest.raises(error):
            aggregate(people, bad)


def test_nested_unwind_keeps_each_element(spark):
    df = spark.createDataFrame([("1", ([1, 2, 3], "k"))], "_id string, a struct<list array<long>, other string>")
    out = aggregate(df, [{"$unwind": "$a.list"}]).collect()
    assert sorted(r["a"]["list"] for r in out) == [1, 2, 3] and {r["a"]["other"] for r in out} == {"k"}


def test_sort_puts_missing_last_up_and_first_down(spark):
    df = spark.createDataFrame([("1", 2), ("2", None), ("3", 1)], "_id string, v long")
    assert [r["_id"] for r in aggregate(df, [{"$sort": {"v": 1}}]).collect()] == ["3", "1", "2"]
    assert [r["_id"] for r in aggregate(df, [{"$sort": {"v": -1}}]).collect()] == ["2", "1", "3"]


def test_projection(spark):
    df = spark.createDataFrame([("1", "Ada", 30, ("London", "UK")), ("2", "Bob", 40, None)], "_id string, name string, age long, address struct<city string, country string>")
    assert project(df, {}).columns == df.columns
    assert project(df, {"name": 1}).columns == ["name", "_id"]
    assert project(df, {"name": True, "_id": 0}).columns == ["name"]
    assert project(df, {"age": 0}).columns == ["_id", "name", "address"]
    assert project(df, {"_id": 0}).columns == ["name", "age", "address"]
    nested = project(df, {"address.city": 1}).collect()
    assert nested[0]["address"].asDict() == {"city": "London"} and nested[1]["address"] is None
    assert project(df, {"address.city": 0}).first()["address"].asDict() == {"country": "UK"}
    renamed = project(df, {"_id": 0, "town": "$address.city", "twice": F.col("age") * 2}).first()
    assert renamed.asDict() == {"town": "London", "twice": 60}
    with pytest.raises(ValueError):
        project(df, {"x": "plain"})


def test_distinct(people):
    assert {r["value"] for r in distinct_values(people, "tags").collect()} == {"admin", "user", "mod"}
    assert distinct_values(people, "absent").count() == 0


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark):
    c = Collection(spark, "orders", documents=True)
    docs = [{"_id": str(i), "customer": i % 3, "price": [i % 5, "text", None, i / 2][i % 4], "status": [f"s{i}", None, i, {"x": i}][i % 4], "note": "long " * 20} for i in range(40)]
    for d in docs[::7]:
        del d["price"], d["status"]
    c.insert_many(docs)
    return c, docs


def test_grouped_documents_are_not_sorted_as_a_whole(orders):
    c, docs = orders
    group = {"_id": "$customer", "list": {"$push": "$status"}, "one": {"$push": 1}, "first": {"$first": "$status"}, "last": {"$last": "$_id"}, "sum": {"$sum": "$price"}, "n": {"$sum": 1}, "low": {"$min": "$price"}}
    out = c.aggregate([{"$sort": {"price": -1, "_id": 1}}, {"$match": {"note": {"$exists": True}}}, {"$group": group}])
    assert "Sort [" not in optimised(out)
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().head()
    shuffled = node.children().head().output()  # what the window's groups are made of
    assert not {"doc", "data", "data_valid"} & {shuffled.apply(i).name() for i in range(shuffled.size())}

    def key(d):  # numbers, then texts; missing ones and nulls first in descending order
        p = d.get("price")
        return (0, 0) if p is None else (1, 0) if isinstance(p, str) else (2, -p)

    got = {r["_id"]: r for r in out.collect()}
    assert set(got) == {"0", "1", "2"}
    for k, r in got.items():
        mine = sorted((d for d in docs if str(d["customer"]) == k), key=lambda d: (key(d), d["_id"]))
        prices = [d["price"] for d in mine if isinstance(d.get("price"), (int, float))]
        assert [v and v.toPython() for v in r["list"]] == [d.get("status") for d in mine]
        assert [v is None for v in r["list"]] == ["status" not in d for d in mine]  # an explicit null is no missing field
        assert list(r["one"]) == [1] * len(mine) and r["n"] == len(mine) and r["sum"] == sum(prices)
        assert r["last"] == mine[-1]["_id"] and (r["first"] and r["first"].toPython()) == mine[0].get("status") and float(r["low"]) == min(prices)


def test_sorts_of_documents_compare_columns(orders):
    c, docs = orders
    ranked = [d["_id"] for d in sorted((d for d in docs if isinstance(d.get("price"), (int, float))), key=lambda d: (-d["price"], d["_id"]))]
    wanted = {"price": {"$type": "number"}}
    cursor = c.find(wanted).sort({"price": -1, "_id": 1})
    staged = c.aggregate([{"$match": wanted}, {"$sort": {"price": -1, "_id": 1}}, {"$addFields": {"k": 1}}])
    for plan in (cursor.to_sql(), optimised(staged)):
        sorts = [line for line in plan.split("\n") if "Sort [" in line]
        assert len(sorts) == 1 and "variant" not in sorts[0]
    assert [d["_id"] for d in cursor] == [r["_id"] for r in staged.collect()] == ranked
    assert [d["_id"] for d in c.find(wanted).sort({"price": -1, "_id": 1}).skip(2).limit(3)] == ranked[2:5]
    limited = c.aggregate([{"$match": wanted}, {"$sort": {"price": -1, "_id": 1}}, {"$limit": 4}, {"$group": {"_id": None, "ids": {"$push": "$_id"}}}]).first()
    assert list(limited["ids"]) == ranked[:4]
