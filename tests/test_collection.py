import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lodestone.collection import Collection, Database, discover
from lodestone.sources.documents import export_json, read_text, validate
from lodestone.sources import store
from lodestone.sources.store import ConcurrentWrite

PEOPLE = [
    {"_id": "1", "name": "Ada", "age": 30, "tags": ["a", "b"], "address": {"city": "London"}},
    {"_id": "2", "name": "Grace", "age": 40, "tags": ["b"], "seen": dt.datetime(2024, 1, 1)},
    {"_id": "3", "name": "Alan", "age": 50, "tags": []},
]


@pytest.fixture
def people(spark):
    c = Collection(spark, "people", documents=True)
    c.insert_many(PEOPLE)
    return c


def ids(cursor):
    return [d["_id"] for d in cursor]


def test_cursor(people):
    assert ids(people.find().sort({"age": -1})) == ["3", "2", "1"]
    assert ids(people.find().sort({"age": 1}).skip(1).limit(1)) == ["2"]
    assert ids(people.find().limit(0)) == []
    assert people.find({"tags": "b"}).count() == people.count_documents({"tags": "b"}) == 2
    assert people.find({"age": {"$gt": 35}}).sort({"_id": 1}).first()["name"] == "Grace"
    assert people.find_one({"name": "Nobody"}) is None
    assert people.find_one({"_id": "1"}, {"address.city": 1}) == {"address": {"city": "London"}, "_id": "1"}
    assert people.find_one({"_id": "1"}, {"tags": 0, "address": 0}) == {"_id": "1", "name": "Ada", "age": 30}
    assert people.find_one({"_id": "2"})["seen"] == dt.datetime(2024, 1, 1)
    cursor = people.find().sort({"_id": 1})
    assert [cursor.next()["_id"], cursor.next()["_id"], cursor.next()["_id"], cursor.next()] == ["1", "2", "3", None]
    assert sorted(people.distinct("tags")) == ["a", "b"] and people.estimated_document_count() == 3
    assert "Filter" in people.find({"age": 30}).to_sql()
    for bad in (lambda: people.find().limit(-1), lambda: people.find().skip(-1)):
        with pytest.raises(ValueError):
            bad()
    assert {r["_id"]: r["n"] for r in people.aggregate([{"$match": {"age": {"$gt": 30}}}, {"$group": {"_id": "$name", "n": {"$sum": "$age"}}}]).collect()} == {"Grace": 40.0, "Alan": 50.0}


def test_inserts_are_checked(people):
    with pytest.raises(ValueError):
        people.insert_one({"_id": "1"})
    with pytest.raises(ValueError):
        people.insert_many([{"_id": "8"}, {"_id": "8"}])
    assert people.count_documents() == 3
    made = people.insert_one({"name": "New", "x": float("nan")})
    assert re.fullmatch("[0-9a-f]{24}", made.inserted_ids[0]) and people.find_one({"name": "New"})["x"] is None
    loop = {}
    loop["self"] = loop
    for bad, error in (({"f": print}, TypeError), ({"r": re.compile("x")}, TypeError), (loop, ValueError), ({"a": [1, object()]}, TypeError)):
        with pytest.raises(error, match="document"):
            validate(bad)


def test_updates_and_deletes(people):
    assert people.update_one({"age": {"$gte": 40}}, {"$set": {"group.name": "senior"}}).modified_count == 1
    assert people.find_one({"_id": "2"})["group"] == {"name": "senior"} and "group" not in people.find_one({"_id": "3"})
    assert people.update_many({}, {"$inc": {"age": 1}, "$push": {"tags": "z"}}).matched_count == 3
    assert people.find_one({"_id": "1"})["age"] == 31 and people.count_documents({"tags": "z"}) == 3
    up = people.update_one({"name": "None"}, {"$set": {"name": "Up"}}, upsert=True)
    assert up.upserted_id and people.find_one({"_id": up.upserted_id})["name"] == "Up"
    people.replace_one({"_id": "3"}, {"name": "Alan T"})
    assert people.find_one({"_id": "3"}) == {"_id": "3", "name": "Alan T"}
    assert people.replace_one({"_id": "77"}, {"name": "R"}, upsert=True).upserted_id == "77"
    assert people.find_one_and_update({"_id": "1"}, {"$set": {"age": 1}})["age"] == 31
    assert people.find_one_and_update({"_id": "1"}, {"$set": {"age": 2}}, return_after=True, projection={"age": 1}) == {"age": 2, "_id": "1"}
    assert people.find_one_and_replace({"_id": "2"}, {"name": "G"}, return_after=True) == {"_id": "2", "name": "G"}
    assert people.find_one_and_delete({"_id": "2"})["name"] == "G" and people.find_one({"_id": "2"}) is None
    assert people.delete_one({"name": {"$exists": True}}).deleted_count == 1
    assert people.delete_many().deleted_count == 3 and people.count_documents() == 0
    with pytest.raises(ValueError):
        people.update_one({}, {"$rename": {"a": "b"}})


def test_broken_rows(spark):
    raw = [("good-1", '{"name":"Alice","code":"ACME"}'), ("good-2", '{"name":"Bob","code":"BETA"}'), ("bad-1", '{"name":"broken",'), ("empty", "")]
    c = Collection(spark, "raw", spark.createDataFrame(raw, "_id string, data string"), documents=True)
    assert ids(c.find({"code": "ACME"})) == ["good-1"]
    for query in ({"code": {"$ne": "ACME"}}, {"$nor": [{"code": "ACME"}]}, {"code": {"$not": {"$eq": "ACME"}}}):
        assert ids(c.find(query)) == ["good-2"]
    assert c.count_invalid_json() == 2 and {r["_id"] for r in c.find_invalid_json()} == {"bad-1", "empty"}
    assert c.find_one({"_id": "bad-1"})["__corrupted"] and c.find_one({"_id": "empty"}) == {"_id": "empty"}
    assert c.delete_many({}).deleted_count == 4
    assert read_text("x", json.dumps({"_id": "inner"}))["_id"] == "inner"
    assert read_text("x", '{\\"a\\": 1}') == {"_id": "x", "a": 1}


def test_indexes(people):
    assert people.create_index({"name": 1, "age": -1}) == "people_name_1_age_-1"
    people.create_index("name", unique=True, name="who")
    assert {i["name"]: i["unique"] for i in people.list_indexes()} == {"people_name_1_age_-1": False, "who": True}
    with pytest.raises(ValueError):
        people.insert_one({"name": "Ada"})
    people.drop_index("who")
    people.insert_one({"name": "Ada"})
    with pytest.raises(ValueError):
        people.create_index({"name": 1}, unique=True)
    assert people.drop_indexes() == 1 and people.list_indexes() == []


def test_typed_collection(spark):
    db = Database(spark)
    c = db.register("typed", spark.createDataFrame([("1", 5, "x"), ("2", 6, None)], "_id string, n long, s string"))
    c.update_many({"n": {"$gt": 5}}, {"$set": {"s": "big"}, "$inc": {"n": 10}})
    assert c.find().sort({"_id": 1}).to_array() == [{"_id": "1", "n": 5, "s": "x"}, {"_id": "2", "n": 16, "s": "big"}]
    c.insert_one({"_id": "3", "n": 1, "fresh": True})
    assert c.find_one({"fresh": True})["n"] == 1
    assert [r["n"] for r in db.sql("SELECT n FROM typed WHERE s = :s", {"s": "x"}).collect()] == [5]
    assert db.list_collections() == ["typed"] and db.list_collection_info()[0]["count"] == 3
    c.create_index("n")
    assert [r["n"] for r in c.clustered("typed_n_1", 1).collect()] == [1, 5, 16]
    db.register_function("twice", lambda x: x * 2, "long")
    assert db.sql("SELECT twice(n) AS m FROM typed WHERE _id = '1'").first()["m"] == 10


def test_stored_collections_and_change_stream(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Database(spark, path)
    users = db.collection("users")
    users.insert_one({"_id": "u1", "name": "Ann", "age": 30, "old": 1})
    users.update_one({"_id": "u1"}, {"$set": {"age": 31, "status": "on"}, "$unset": {"old": ""}})
    users.insert_one({"_id": "u2", "name": "Bob"})
    users.delete_one({"_id": "u1"})
    db.collection("other").insert_one({"_id": "o"})
    again = Database(spark, path)
    assert again.list_collections() == ["other", "users"] and ids(again.collection("users").find()) == ["u2"]
    events = users.watch(full_document="updateLookup", before="required").drain()
    assert [e["operationType"] for e in events] == ["insert", "update", "insert", "delete"]
    update, delete = events[1], events[3]
    assert update["updateDescription"] == {"updatedFields": {"age": "31", "status": '"on"'}, "removedFields": ["old"]}
    assert json.loads(update["fullDocument"])["age"] == 31 and json.loads(update["fullDocumentBeforeChange"])["age"] == 30
    assert delete["fullDocument"] is None and delete["documentKey"] == {"_id": "u1"} and delete["ns"]["coll"] == "users"
    checkpoint = str(tmp_path / "watch")
    assert len(users.watch({"operationType": {"$in": ["delete", "update"]}}).drain(checkpoint)) == 2
    users.delete_one({"_id": "u2"})
    assert [e["documentKey"]["_id"] for e in users.watch({"operationType": {"$in": ["delete", "update"]}}).drain(checkpoint)] == ["u2"]
    assert len(users.watch(buffer=2).drain()) == 5  # the bound is for streams that run on
    short = users.watch(buffer=2).start(interval="0 seconds")
    short.running.processAllAvailable()
    assert [e["operationType"] for e in short] == ["delete", "delete"]
    short.close()
    live = users.watch().start(interval="0 seconds")
    live.running.processAllAvailable()
    assert [e["operationType"] for e in live] == ["insert", "update", "insert", "delete", "delete"]
    live.close()
    assert discover(str(tmp_path), spark) == [f"file:{path}"] or discover(str(tmp_path), spark) == [path]
    stale = Database(spark, path).collection("users")
    stale.frame()
    frame, version = stale.frame(), stale._version
    users.insert_one({"_id": "u9"})
    with pytest.raises(ConcurrentWrite):
        db.store.commit("users", frame, None, version)
    with pytest.raises(ConcurrentWrite):
        stale.store.commit("users", frame, None, version)
    export_json(users.frame(), str(tmp_path / "out"), 1)
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    users.drop()
    assert "users" not in Database(spark, path).list_collections()
    with pytest.raises(ValueError):
        db.collection("__hidden")


def rows_of(db, name):
    return sorted((r["_id"], json.loads(r["data"])["n"]) for r in db.collection(name).frame().collect())


def test_of_two_writers_one_wins_and_nothing_of_the_other_is_seen(spark, tmp_path):
    path = str(tmp_path / "db")
    first, second = Database(spark, path), Database(spark, path)
    first.collection("c").insert_one({"_id": "1", "n": 0})
    checkpoint = str(tmp_path / "watch")
    assert len(first.collection("c").watch().drain(checkpoint)) == 1
    loser = second.collection("c")
    staged = second.store.commit_staged

    def late(*args, **kw):  # the other writer commits between the loser's write and its commit
        second.store.commit_staged = staged
        first.collection("c").update_one({"_id": "1"}, {"$set": {"n": 111}})
        return staged(*args, **kw)

    second.store.commit_staged = late
    with pytest.raises(ConcurrentWrite):
        loser.update_one({"_id": "1"}, {"$set": {"n": 222}})
    assert rows_of(Database(spark, path), "c") == [("1", 111)]
    assert [json.loads(r["full_document"])["n"] for r in first.store.log().orderBy("version").collect()] == [0, 111]
    assert [json.loads(e["fullDocument"])["n"] for e in first.collection("c").watch(full_document="updateLookup").drain(checkpoint)] == [111]
    second.collection("other").insert_one({"_id": "x", "n": 5})  # writers of other collections do not disturb
    first.collection("c").insert_one({"_id": "2", "n": 7})
    assert rows_of(second, "c") == [("1", 111), ("2", 7)] and rows_of(first, "other") == [("x", 5)]
    versions = [r["version"] for r in first.store.log().orderBy("version").collect()]
    assert len(set(versions)) == 4


def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    c = db.collection("c")
    c.insert_one({"_id": "1", "n": 0})
    path = db.store.stage("c", spark.createDataFrame([("9", '{"n":9}')], "_id string, data string"))
    db.store.staged(path).select(F.lit(0).alias("seq")).write.parquet(f"{db.store.root}/{path}/changes")
    again = Database(spark, str(tmp_path / "db"))
    assert rows_of(again, "c") == [("1", 0)] and len(again.collection("c").watch().drain()) == 1 and again.store.log().count() == 1
    again.store.vacuum("c")
    assert rows_of(again, "c") == [("1", 0)] and not again.store._exists(path)


def test_a_crash_after_the_commit_loses_no_log_row(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.store._publish = lambda *_: None
    db.collection("c").insert_one({"_id": "1", "n": 0})
    assert Database(spark, str(tmp_path / "db")).store.log().count() == 1


def test_pruning_and_compaction_replay_nothing(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    c = db.collection("c")
    for n in range(3):
        c.replace_one({"_id": "1"}, {"n": n}, upsert=True)
    checkpoint = str(tmp_path / "watch")
    assert len(c.watch().drain(checkpoint)) == 3
    assert db.store.compact_log((0, 0)) == 2 and [json.loads(r["full_document"])["n"] for r in db.store.log().collect()] == [2]
    assert c.watch().drain(checkpoint) == []
    c.replace_one({"_id": "1"}, {"n": 3})
    assert sorted(json.loads(r["full_document"])["n"] for r in db.store.log().collect()) == [2, 3]
    assert db.store.compact_log((0, 0)) == 1
    db.store.prune_log(db.store.log_top())
    assert db.store.log().count() == 0 and [json.loads(e["fullDocument"])["n"] for e in c.watch(full_document="all").drain(checkpoint)] == [3]
    c.delete_one({"_id": "1"})
    assert [e["operationType"] for e in c.watch().drain(checkpoint)] == ["delete"]
    assert [r["operation"] for r in Database(spark, str(tmp_path / "db")).store.log().collect()] == ["delete"]


@pytest.mark.parametrize("share", [0.25, 100])
def test_a_write_costs_its_own_rows_and_layers_are_merged(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(store, "MOST_LAYERS", 3)
    monkeypatch.setattr(store, "SMALL_SHARE", share)
    monkeypatch.setattr(store, "STATE_EVERY", 4)
    db = Database(spark, str(tmp_path / "db"))
    c = db.collection("c")
    c.insert_many([{"_id": f"{i:03}", "n": i} for i in range(300)])
    want = {f"{i:03}": i for i in range(300)}
    base = db.store.table("c").layers[0]
    for step in range(5):
        c.update_one({"_id": f"{step:03}"}, {"$set": {"n": -step}})
        c.delete_one({"_id": f"{200 + step}"})
        c.insert_one({"_id": f"x{step}", "n": step})
        want |= {f"{step:03}": -step, f"x{step}": step}
        del want[f"{200 + step}"]
        assert len(db.store.table("c").layers) <= 3
    assert (db.store.table("c").layers[0] == base) == (share == 100)  # where the small layers are small, the large one is not written again
    again = Database(spark, str(tmp_path / "db"))
    assert rows_of(db, "c") == rows_of(again, "c") == sorted(want.items())
    again.store.vacuum("c")
    assert rows_of(db, "c") == sorted(want.items()) and again.collection("c").find_one({"_id": "001"})["n"] == -1


def test_indexes_outlive_the_process(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    c = db.collection("c")
    c.insert_many([{"_id": "1", "n": 1, "k": "a"}, {"_id": "2", "n": 2}, {"_id": "3", "k": "b"}])
    name = c.create_index("n", unique=True)
    again = Database(spark, str(tmp_path / "db")).collection("c")
    assert again.list_indexes() == [{"name": name, "key": {"n": 1}, "unique": True}]
    for bad in (lambda: again.insert_one({"n": 2}), lambda: again.insert_many([{"n": 8}, {"n": 8}]), lambda: again.update_many({}, {"$set": {"n": 5}}), lambda: again.update_one({"_id": "1"}, {"$set": {"n": 2}})):
        with pytest.raises(ValueError, match="unique"):
            bad()
    again.update_one({"_id": "1"}, {"$set": {"n": 1, "k": "z"}})
    again.insert_one({"_id": "4"})
    assert c.count_documents() == 4 and c.find_one({"_id": "1"})["k"] == "z"
    again.create_index({"k": 1, "n": -1})
    assert len(Database(spark, str(tmp_path / "db")).collection("c").list_indexes()) == 2
    with pytest.raises(ValueError):
        c.insert_one({"_id": "5", "n": 2})
    assert c.drop_indexes() == 2 and again.list_indexes() == []


def test_typed_collections_take_layers_of_other_columns(spark, tmp_path):
    c = Database(spark, str(tmp_path / "db")).collection("t", documents=False)
    c.insert_many(spark.createDataFrame([("a", 1), ("b", 2)], "_id string, v long"))
    c.update_many({"v": 2}, {"$set": {"w": "new"}})
    c.insert_many([{"_id": "c", "v": 3, "w": "x"}])
    c.delete_one({"_id": "a"})
    assert sorted(map(tuple, c.frame().select("_id", "v", "w").collect())) == [("b", 2, "new"), ("c", 3, "x")]


def test_pipelines_change_documents(spark, tmp_path):
    c = Database(spark, str(tmp_path / "db")).collection("people")
    c.insert_many([{"_id": "1", "name": "Ada", "age": 30, "tags": ["a", "b"], "home": {"city": "L", "rooms": [1, None]}}, {"_id": "2", "name": "Bob", "age": 40, "tags": "b"}, {"_id": "3", "name": "Cy", "tags": []}, {"_id": "4", "name": None}])
    docs = lambda stages, **kw: [json.loads(r["data"]) | {"_id": r["_id"]} for r in c.aggregate(stages, **kw).collect()]
    assert sorted((d["_id"], d["tags"]) for d in docs([{"$unwind": "$tags"}])) == [("1", "a"), ("1", "b"), ("2", "b")]
    assert [(d["_id"], d["tags"], d["home"]) for d in docs([{"$unwind": "$tags"}, {"$match": {"tags": "a"}}])] == [("1", "a", {"city": "L", "rooms": [1, None]})]
    assert [d["home"] for d in docs([{"$unwind": {"path": "$home.rooms"}}])] == [{"city": "L", "rooms": 1}, {"city": "L", "rooms": None}]
    groups = {r["_id"]: [v.toPython() if v is not None else None for v in r["names"]] for r in c.aggregate([{"$unwind": "$tags"}, {"$sort": {"name": -1}}, {"$group": {"_id": "$tags", "names": {"$push": "$name"}}}]).collect()}
    assert groups == {"a": ["Ada"], "b": ["Bob", "Ada"]}
    every = c.aggregate([{"$group": {"_id": None, "ages": {"$push": "$age"}, "first": {"$first": "$name"}, "k": {"$push": 1}}}]).first()
    assert [v.toPython() if v is not None else None for v in every["ages"]] == [30, 40, None, None] and every["first"].toPython() == "Ada" and every["k"] == [1] * 4
    assert [d["_id"] for d in docs([{"$addFields": {"level": 3, "age": "x"}}, {"$match": {"level": 3, "age": "x", "name": "Bob"}}])] == ["2"]
    assert {r["_id"]: r["n"] for r in c.aggregate([{"$addFields": {"level": 3}}, {"$group": {"_id": "$level", "n": {"$sum": 1}}}]).collect()} == {"3": 4}
    assert sorted(d["was"] for d in docs([{"$match": {"age": {"$gt": 1}}}, {"$addFields": {"was": "$age"}}], expressions=True)) == [30, 40]
    out = c.aggregate([{"$match": {"_id": "1"}}, {"$project": {"age": 0, "home.city": 0, "nothing.here": 0}}])
    assert out.columns == ["_id", "data"] and json.loads(out.first()["data"]) == {"name": "Ada", "tags": ["a", "b"], "home": {"rooms": [1, None]}}
    assert c.find({"_id": "1"}).project({"tags": 0, "_id": 0}).frame().columns == ["data"]
    assert c.aggregate([{"$project": {"age": 0}}, {"$match": {"age": 30}}]).count() == 0


@pytest.fixture
def dated_orders(spark, tmp_path):
    days = [dt.datetime(1996, 1, 2), dt.datetime(2000, 2, 29), None]
    found = [(i, "FOP"[i % 3], 100000.0 * i, days[i % 3]) for i in range(7)]
    schema = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"
    spark.createDataFrame(found, schema).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path), found


@pytest.fixture
def nothing_fetched(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows go to the driver")

    kind = type(spark.range(1))  # the class behind DataFrame
    return lambda: [monkeypatch.setattr(kind, name, refuse) for name in ("toLocalIterator", "collect", "toPandas", "toArrow")], monkeypatch.undo


def test_map_gives_the_documents_of_iteration(spark, people):
    typed = Collection(spark, "typed", people.frame().select("_id", F.length("data").alias("n"), F.array(F.struct(F.lit(1).alias("x"))).alias("items")))
    for cursor in (lambda: people.find(), lambda: people.find({"age": {"$gt": 30}}).project({"name": 1}), lambda: people.find().sort({"age": -1}).skip(1).limit(1), lambda: typed.find().sort({"n": 1})):
        assert [r["d"] for r in cursor().map(lambda d: (repr(d),), "d string").collect()] == [repr(d) for d in cursor().to_array()]


def test_restored_dates_are_read_on_the_executors(spark, dated_orders, nothing_fetched):
    folder, found = dated_orders
    refuse, allow = nothing_fetched
    refuse()
    out = queries()["restored_dates"](spark, folder)
    allow()
    assert sorted(map(tuple, out.collect())) == [(k, d and str(d.date()), d and d.year) for k, _, _, d in found]


def test_array_of_any_size_stays_on_the_executors(spark, dated_orders, nothing_fetched):
    folder, found = dated_orders
    refuse, allow = nothing_fetched
    refuse()
    out = queries()["to_array"](spark, folder)
    allow()
    listed = Collection(spark, "orders", spark.read.parquet(f"{folder}/orders.parquet")).find({"o_totalprice": {"$gt": 300000}}).to_array()
    assert sorted(map(tuple, out.collect())) == sorted((d["o_orderkey"], d["o_orderstatus"]) for d in listed) == [(k, s) for k, s, p, _ in found if p > 300000]
