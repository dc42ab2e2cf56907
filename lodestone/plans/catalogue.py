"""The driver's queries over the given tables, each with the SQL that it must equal."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.filters import Root, compile_filter
from lodestone.operators.ordering import numbered, sort_columns
from lodestone.operators.pipeline import aggregate
from lodestone.operators.projection import project
from lodestone.operators.updates import update_frame
from lodestone.streaming.events import change_events, coalesced, compacted, top_level
from lodestone.tools.guided import build_filter
from lodestone.tools.inference import infer_schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# nested views of the flat tables


def orders_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as ``items``, in line order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")))).alias("items")
    )
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nested = nation.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation"))
    return table(spark, sf_dir, "customer").join(F.broadcast(nested), F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day with the kinds of its events in event order."""
    events = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    pairs = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return events.groupBy("user_id", "day").agg(F.transform(pairs, lambda p: p["event_type"]).alias("types"))


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON documents: ``k`` is a number, a text, null or missing."""
    k = F.get_json_object("props", "$.k").cast("int")
    doc = (
        F.when(k % 4 == 0, F.format_string('{"k": %d, "type": "%s"}', k, "event_type"))
        .when(k % 4 == 1, F.format_string('{"k": "%d", "type": "%s"}', k, "event_type"))
        .when(k % 4 == 2, F.format_string('{"k": null, "type": "%s"}', "event_type"))
        .otherwise(F.format_string('{"type": "%s", "tags": [%d, "x"]}', "event_type", k))
    )
    return table(spark, sf_dir, "events").select("event_id", F.try_parse_json(doc).alias("data"))


EVENT_DOCS_SQL = (
    "(SELECT event_id, k, event_type, CASE k % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'null' ELSE 'missing' END AS kind"
    " FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"
)
USER_EVENTS_SQL = "(SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(event_type ORDER BY event_id) AS types FROM events GROUP BY 1, 2)"
CUSTOMER_SQL = "(SELECT c.*, n_name, r_name FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def add_filter(name: str, source: str, columns: str, spec: dict[str, Any], where: str) -> None:
    """A filter over a flat table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return df.filter(compile_filter(spec, Root.of(df))).select(*columns.split(", "))

    query(name, f"SELECT {columns} FROM {source} WHERE {where}")(run)


ORDERS, CUSTOMER, PART = "o_orderkey, o_totalprice", "c_custkey, c_name", "p_partkey, p_name"
DAY = dt.datetime(1996, 1, 1)
for args in [
    ("eq_scalar", "orders", ORDERS, {"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
    ("ne", "orders", ORDERS, {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'"),
    ("gt", "orders", ORDERS, {"o_totalprice": {"$gt": 150000}}, "o_totalprice > 150000"),
    ("gte", "part", PART, {"p_size": {"$gte": 40}}, "p_size >= 40"),
    ("lt", "part", PART, {"p_size": {"$lt": 5}}, "p_size < 5"),
    ("lte", "customer", CUSTOMER, {"c_acctbal": {"$lte": 0}}, "c_acctbal <= 0"),
    ("type_bracket", "orders", ORDERS, {"o_orderstatus": {"$gt": 10}}, "false"),
    ("in", "customer", CUSTOMER, {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("nin", "customer", CUSTOMER, {"c_mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}}, "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ("in_empty", "customer", CUSTOMER, {"c_custkey": {"$in": []}}, "false"),
    ("nin_empty", "customer", CUSTOMER, {"c_custkey": {"$nin": []}}, "true"),
    ("range_and", "orders", ORDERS, {"$and": [{"o_totalprice": {"$gte": 50000}}, {"o_totalprice": {"$lt": 90000}}]}, "o_totalprice >= 50000 AND o_totalprice < 90000"),
    ("or", "orders", ORDERS, {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 300000}}]}, "o_orderstatus = 'P' OR o_totalprice > 300000"),
    ("nor", "orders", ORDERS, {"$nor": [{"o_orderstatus": "O"}, {"o_totalprice": {"$lt": 100000}}]}, "NOT (o_orderstatus = 'O' OR o_totalprice < 100000)"),
    ("not_field", "orders", ORDERS, {"o_totalprice": {"$not": {"$gt": 100000}}}, "NOT (o_totalprice > 100000)"),
    ("not_top", "orders", ORDERS, {"$not": {"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}}, "NOT (o_orderstatus = 'F' AND o_totalprice > 100000)"),
    ("regex", "part", PART, {"p_name": {"$regex": "^[a-m].*e$"}}, "regexp_matches(p_name, '^[a-m].*e$')"),
    ("regex_i", "customer", CUSTOMER, {"c_name": {"$regex": "CUSTOMER#0*1[0-9]+$", "$options": "i"}}, "regexp_matches(c_name, 'CUSTOMER#0*1[0-9]+$', 'i')"),
    ("regex_literal", "part", PART, {"p_type": re.compile("econ|promo$", re.I)}, "regexp_matches(p_type, 'econ|promo$', 'i')"),
    ("mod", "part", PART, {"p_size": {"$mod": [7, 3]}}, "p_size % 7 = 3"),
    ("type_typed", "part", PART, {"p_size": {"$type": ["number", "string"]}, "p_name": {"$type": 2}}, "true"),
    ("exists_typed", "customer", CUSTOMER, {"c_name": {"$exists": True}, "nothing": {"$exists": False}}, "true"),
    ("exists_top", "customer", CUSTOMER, {"$exists": {"c_name": True, "nothing": False}}, "true"),
    ("date_range", "orders", ORDERS, {"o_orderdate": {"$gte": DAY, "$lt": "1997-01-01T00:00:00.000Z"}}, "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'"),
    ("date_eq", "orders", ORDERS, {"o_orderdate": DAY}, "o_orderdate = TIMESTAMP '1996-01-01'"),
    ("text_search", "documents", "doc_id, n_chars", {"$text": {"$search": "THE AND"}}, "text ILIKE '%the and%' OR lang ILIKE '%the and%' OR source ILIKE '%the and%'"),
    ("unknown_lenient_base", "orders", ORDERS, {"o_orderstatus": "O", "o_totalprice": {"$gt": 1, "$lt": 60000}}, "o_orderstatus = 'O' AND o_totalprice > 1 AND o_totalprice < 60000"),
]:
    add_filter(*args)


@query("eq_contains_mode", "SELECT p_partkey FROM part WHERE p_name ILIKE '%anvil%' AND CAST(p_size AS VARCHAR) LIKE '%1%'")
def eq_contains_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return df.filter(compile_filter({"p_name": "ANVIL", "p_size": 1}, Root.of(df), eq_mode="contains")).select("p_partkey")


@query("unknown_operator_lenient", "SELECT p_partkey FROM part WHERE false")
def unknown_operator_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return df.filter(compile_filter({"p_name": {"$near": 1}}, Root.of(df), strict=False)).select("p_partkey")


def nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status F reads as null."""
    return table(spark, sf_dir, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("F")))


NULLED_SQL = "(SELECT *, nullif(o_orderstatus, 'F') AS status FROM orders)"
for name, spec, where in [
    ("eq_null", {"status": None}, "status IS NULL"),
    ("ne_null", {"status": {"$ne": None}}, "status IS NOT NULL"),
    ("ne_with_null", {"status": {"$ne": "O"}}, "status IS DISTINCT FROM 'O'"),
    ("in_null", {"status": {"$in": ["P", None]}}, "status = 'P' OR status IS NULL"),
    ("nin_null", {"status": {"$nin": ["P", None]}}, "status <> 'P' AND status IS NOT NULL"),
    ("not_on_missing", {"status": {"$not": {"$gt": "N"}}}, "status IS NULL OR NOT status > 'N'"),
    ("nor_on_missing", {"$nor": [{"status": "O"}]}, "status IS NULL OR status <> 'O'"),
    ("exists_false", {"status": {"$exists": False}}, "status IS NULL"),
]:
    query(name, f"SELECT o_orderkey, status FROM {NULLED_SQL} WHERE {where}")(
        lambda s, d, spec=spec: (lambda df: df.filter(compile_filter(spec, Root.of(df))).select("o_orderkey", "status"))(nulled(s, d))
    )

for name, spec, where in [
    ("all_scalar", {"types": {"$all": ["click", "view"]}}, "list_contains(types, 'click') AND list_contains(types, 'view')"),
    ("array_contains", {"types": "purchase"}, "list_contains(types, 'purchase')"),
    ("array_ne", {"types": {"$ne": "purchase"}}, "NOT list_contains(types, 'purchase')"),
    ("in_array", {"types": {"$in": ["purchase", "signup"]}}, "list_contains(types, 'purchase') OR list_contains(types, 'signup')"),
    ("size", {"types": {"$size": 3}}, "len(types) = 3"),
    ("array_index", {"types[0]": "click", "types.1": {"$ne": "click"}}, "types[1] = 'click' AND types[2] IS DISTINCT FROM 'click'"),
    ("elem_match_scalar", {"types": {"$elemMatch": {"$gte": "p", "$lt": "q"}}}, "len(list_filter(types, lambda x: x >= 'p' AND x < 'q')) > 0"),
    ("array_equality", {"types": ["view", "click"]}, "types = ['view', 'click']"),
]:
    query(name, f"SELECT user_id, day, len(types) AS n FROM {USER_EVENTS_SQL} WHERE {where}")(
        lambda s, d, spec=spec: (lambda df: df.filter(compile_filter(spec, Root.of(df))).select("user_id", "day", F.size("types").cast("long").alias("n")))(user_events(s, d))
    )

for name, spec, where in [
    ("elem_match", {"items": {"$elemMatch": {"qty": {"$gt": 45}, "flag": "R"}}}, "l_quantity > 45 AND l_returnflag = 'R'"),
    ("elem_match_top", {"$elemMatch": {"items": {"qty": {"$lt": 2}, "flag": {"$in": ["A", "N"]}}}}, "l_quantity < 2 AND l_returnflag IN ('A', 'N')"),
    ("in_objects", {"items": {"$in": [{"line": 7, "flag": "A"}]}}, "l_linenumber = 7 AND l_returnflag = 'A'"),
]:
    query(name, f"SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {where})")(
        lambda s, d, spec=spec: (lambda df: df.filter(compile_filter(spec, Root.of(df))).select("o_orderkey", "o_totalprice"))(orders_docs(s, d))
    )


@query(
    "all_objects",
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND l_returnflag = 'N')"
    " AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3 AND l_returnflag = 'R')",
)
def all_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_docs(spark, sf_dir)
    return df.filter(compile_filter({"items": {"$all": [{"line": 1, "flag": "N"}, {"line": 3, "flag": "R"}]}}, Root.of(df))).select("o_orderkey")


for name, spec, where in [
    ("doc_number_compare", {"k": {"$gt": 40}}, "kind = 'number' AND k > 40"),
    ("doc_string_compare", {"k": {"$gte": "5"}}, "kind = 'string' AND CAST(k AS VARCHAR) >= '5'"),
    ("doc_exists", {"k": {"$exists": True}}, "kind <> 'missing'"),
    ("doc_null", {"k": None}, "kind IN ('null', 'missing')"),
    ("doc_type_null", {"k": {"$type": "null"}}, "kind = 'null'"),
    ("doc_type", {"k": {"$type": "string"}}, "kind = 'string'"),
    ("doc_mod", {"k": {"$mod": [5, 0]}}, "kind = 'number' AND k % 5 = 0"),
    ("doc_ne", {"k": {"$ne": 40}}, "NOT (kind = 'number' AND k = 40)"),
    ("doc_in_mixed", {"k": {"$in": [4, "5", None]}}, "(kind = 'number' AND k = 4) OR (kind = 'string' AND k = 5) OR kind IN ('null', 'missing')"),
    ("doc_array", {"tags": "x", "tags[0]": {"$lt": 50}}, "kind = 'missing' AND k < 50"),
    ("doc_all", {"tags": {"$all": ["x", 3]}}, "kind = 'missing' AND k = 3"),
    ("doc_regex", {"k": {"$regex": "^1"}, "type": {"$in": ["click", "view"]}}, "kind IN ('number', 'string') AND CAST(k AS VARCHAR) LIKE '1%' AND event_type IN ('click', 'view')"),
]:
    query(name, f"SELECT event_id FROM {EVENT_DOCS_SQL} WHERE {where}")(
        lambda s, d, spec=spec: (lambda df: df.filter(compile_filter(spec, Root.of(df, "data"))).select("event_id"))(event_docs(s, d))
    )


@query("doc_sort", f"SELECT event_id, kind, row_number() OVER (ORDER BY CASE kind WHEN 'number' THEN 2 WHEN 'string' THEN 3 ELSE 1 END DESC, CASE WHEN kind = 'string' THEN CAST(k AS VARCHAR) END DESC, CASE WHEN kind = 'number' THEN k END DESC, event_id) AS place FROM {EVENT_DOCS_SQL}")
def doc_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_docs(spark, sf_dir)
    root = Root.of(df, "data")
    kind = F.when(root.value("k").missing(), "missing").when(root.value("k").null(), "null").when(root.value("k").type_is("string"), "string").otherwise("number")
    order = sort_columns({"k": -1}, root, "first")
    kept = df.select("event_id", kind.alias("kind"), *(F.struct(c).alias(f"s{i}") for i, c in enumerate(root.value("k").sort_keys())))
    assert len(order) == 3
    return numbered(kept, [F.col("s0.col1").desc_nulls_last(), F.col("s1.col1").desc_nulls_last(), F.col("s2.col1").desc_nulls_last(), F.col("event_id")]).select("event_id", "kind", "place")


@query("doc_group", f"SELECT CASE WHEN kind IN ('number', 'string') THEN CAST(k AS VARCHAR) END AS _id, count(*) AS n FROM {EVENT_DOCS_SQL} GROUP BY 1")
def doc_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(event_docs(spark, sf_dir), [{"$group": {"_id": "$k", "n": {"$sum": 1}}}], document="data")


@query("nested_path", f"SELECT c_custkey, n_name FROM {CUSTOMER_SQL} WHERE r_name = 'EUROPE' AND n_name <> 'NATION_3'")
def nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = customer_docs(spark, sf_dir)
    return df.filter(compile_filter({"nation.region.name": "EUROPE", "nation.name": {"$ne": "NATION_3"}}, Root.of(df))).select("c_custkey", F.col("nation.name").alias("n_name"))


@query("object_equality", f"SELECT c_custkey FROM {CUSTOMER_SQL} WHERE n_name = 'NATION_3' AND r_name = 'EUROPE'")
def object_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = customer_docs(spark, sf_dir)
    return df.filter(compile_filter({"nation": {"name": "NATION_3", "region": {"name": "EUROPE"}}}, Root.of(df))).select("c_custkey")


# projection, order, pages


@query("project_include", "SELECT c_name, c_acctbal FROM customer")
def project_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "customer"), {"c_name": 1, "c_acctbal": True})


@query("project_exclude", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def project_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "customer"), {"c_acctbal": 0, "c_mktsegment": 0})


@query("project_nested", f"SELECT c_custkey, r_name FROM {CUSTOMER_SQL}")
def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(customer_docs(spark, sf_dir), {"c_custkey": 1, "nation.region.name": 1}).select("c_custkey", F.col("nation.region.name").alias("r_name"))


@query("project_rename", f"SELECT c_name AS who, r_name AS region, c_custkey FROM {CUSTOMER_SQL}")
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(customer_docs(spark, sf_dir), [{"$project": {"who": "$c_name", "region": "$nation.region.name", "c_custkey": 1}}])


@query("project_id", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name FROM customer")
def project_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "customer").withColumn("_id", F.col("c_custkey").cast("string")), {"c_name": 1})


@query("sort_limit_skip", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def sort_limit_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.orderBy(*sort_columns({"o_totalprice": -1, "o_orderkey": 1}, Root.of(df), "first")).offset(20).limit(50).select("o_orderkey", "o_totalprice")


@query("sort_nulls_find", f"SELECT o_orderkey, status, row_number() OVER (ORDER BY status ASC NULLS FIRST, o_orderkey) AS place FROM {NULLED_SQL}")
def sort_nulls_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nulled(spark, sf_dir)
    return numbered(df, sort_columns({"status": 1, "o_orderkey": 1}, Root.of(df), "first")).select("o_orderkey", "status", "place")


@query("sort_nulls_pipeline", f"SELECT o_orderkey, status, row_number() OVER (ORDER BY status DESC NULLS FIRST, o_orderkey) AS place FROM {NULLED_SQL}")
def sort_nulls_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nulled(spark, sf_dir)
    return numbered(df, sort_columns({"status": -1, "o_orderkey": 1}, Root.of(df), "last")).select("o_orderkey", "status", "place")


@query("distinct_scalar", "SELECT DISTINCT c_mktsegment AS value FROM customer")
def distinct_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import distinct_values

    return distinct_values(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("distinct_array", "SELECT DISTINCT event_type AS value FROM events")
def distinct_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import distinct_values

    return distinct_values(user_events(spark, sf_dir), "types")


@query("count_docs", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.filter(compile_filter({"o_orderstatus": "O"}, Root.of(df))).agg(F.count("*").alias("n"))


# pipelines


def add_pipeline(name: str, source: Query, stages: list[dict[str, Any]], sql: str, order_by: str | None = None, flat: list[str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = aggregate(source(spark, sf_dir), stages, order_by=order_by)
        return out.selectExpr(*flat) if flat else out

    query(name, sql)(run)


def of(name: str) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, name)


SHIP = dt.datetime(1998, 9, 2)
add_pipeline(
    "pricing_summary",
    of("lineitem"),
    [
        {"$match": {"l_shipdate": {"$lte": SHIP}}},
        {"$group": {"_id": {"rf": "$l_returnflag", "ls": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "price": {"$avg": "$l_extendedprice"}, "n": {"$sum": 1}}},
        {"$sort": {"_id": 1}},
    ],
    "SELECT l_returnflag AS rf, l_linestatus AS ls, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    flat=["_id.rf", "_id.ls", "round(qty, 2) AS qty", "round(price, 2) AS price", "n"],
)
for name, source, group, sql in [
    ("group_sum", "orders", {"_id": "$o_orderstatus", "total": {"$sum": "$o_totalprice"}}, "SELECT o_orderstatus AS _id, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    ("group_avg", "orders", {"_id": "$o_orderpriority", "total": {"$avg": "$o_totalprice"}}, "SELECT o_orderpriority AS _id, round(avg(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    ("group_min", "part", {"_id": "$p_brand", "total": {"$min": "$p_retailprice"}}, "SELECT p_brand AS _id, round(min(p_retailprice), 2) AS total FROM part GROUP BY 1"),
    ("group_max", "part", {"_id": "$p_brand", "total": {"$max": "$p_retailprice"}}, "SELECT p_brand AS _id, round(max(p_retailprice), 2) AS total FROM part GROUP BY 1"),
    ("group_count", "events", {"_id": "$event_type", "total": {"$count": {}}}, "SELECT event_type AS _id, round(count(*), 2) AS total FROM events GROUP BY 1"),
    ("group_sum_constant", "events", {"_id": "$event_type", "total": {"$sum": 3}}, "SELECT event_type AS _id, round(3 * count(*), 2) AS total FROM events GROUP BY 1"),
    ("group_sum_text", "events", {"_id": "$event_type", "total": {"$sum": "$props"}}, "SELECT event_type AS _id, 0.0 AS total FROM events GROUP BY 1"),
]:
    add_pipeline(name, of(source), [{"$group": group}], sql.replace("round(", "round(CAST(", 1).replace(", 2)", " AS DOUBLE), 2)", 1) if "round(" in sql else sql.replace("0.0", "CAST(0 AS DOUBLE)"), flat=["_id", "round(CAST(total AS DOUBLE), 2) AS total"])
add_pipeline("group_null", of("lineitem"), [{"$group": {"_id": None, "n": {"$sum": 1}, "top": {"$max": "$l_quantity"}}}], "SELECT count(*) AS n, max(l_quantity) AS top FROM lineitem", flat=["n", "top"])
add_pipeline("group_const", of("orders"), [{"$group": {"_id": 5, "n": {"$sum": 1}}}], "SELECT CAST(5 AS BIGINT) AS _id, count(*) AS n FROM orders")
add_pipeline("group_empty", of("orders"), [{"$match": {"o_totalprice": {"$lt": 0}}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1}}], "SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0")
add_pipeline("group_null_key", nulled, [{"$group": {"_id": "$status", "n": {"$sum": 1}}}], f"SELECT status AS _id, count(*) AS n FROM {NULLED_SQL} GROUP BY 1")
add_pipeline(
    "group_compound",
    of("orders"),
    [{"$group": {"_id": {"s": "$o_orderstatus", "p": "$o_orderpriority"}, "n": {"$sum": 1}, "top": {"$max": "$o_totalprice"}}}],
    "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2",
    flat=["_id.s", "_id.p", "n", "top"],
)
add_pipeline(
    "group_push_ordered",
    of("events"),
    [{"$sort": {"ts": 1, "event_id": 1}}, {"$group": {"_id": "$user_id", "kinds": {"$push": "$event_type"}}}],
    "SELECT user_id AS _id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM events GROUP BY 1",
    flat=["_id", "array_join(kinds, ',') AS kinds"],
)
add_pipeline(
    "group_first_last",
    of("events"),
    [{"$sort": {"ts": -1, "event_id": -1}}, {"$group": {"_id": "$user_id", "newest": {"$first": "$event_id"}, "oldest": {"$last": "$event_id"}}}],
    "SELECT user_id AS _id, first(event_id ORDER BY ts DESC, event_id DESC) AS newest, last(event_id ORDER BY ts DESC, event_id DESC) AS oldest FROM events GROUP BY 1",
)
add_pipeline(
    "group_first_text_desc",
    of("customer"),
    [{"$sort": {"c_name": -1}}, {"$group": {"_id": "$c_mktsegment", "name": {"$first": "$c_name"}, "low": {"$last": "$c_name"}}}],
    "SELECT c_mktsegment AS _id, max(c_name) AS name, min(c_name) AS low FROM customer GROUP BY 1",
)
add_pipeline(
    "group_push_nulls",
    nulled,
    [{"$group": {"_id": "$o_custkey", "list": {"$push": "$status"}}}],
    f"SELECT o_custkey AS _id, string_agg(coalesce(status, '-'), '' ORDER BY o_orderkey) AS list FROM {NULLED_SQL} GROUP BY 1",
    order_by="o_orderkey",
    flat=["_id", "array_join(list, '', '-') AS list"],
)
add_pipeline("unwind_array", orders_docs, [{"$unwind": "$items"}, {"$group": {"_id": "$items.flag", "n": {"$sum": 1}, "qty": {"$sum": "$items.qty"}}}], "SELECT l_returnflag AS _id, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
add_pipeline("unwind_scalar", of("orders"), [{"$unwind": {"path": "$o_orderstatus"}}, {"$project": {"o_orderkey": 1, "o_orderstatus": 1}}], "SELECT o_orderkey, o_orderstatus FROM orders")
add_pipeline("unwind_drops", nulled, [{"$unwind": "$status"}, {"$project": {"o_orderkey": 1, "status": 1}}], f"SELECT o_orderkey, status FROM {NULLED_SQL} WHERE status IS NOT NULL")
add_pipeline(
    "unwind_match",
    orders_docs,
    [{"$unwind": "$items"}, {"$match": {"items.qty": {"$gte": 49}, "items.flag": "R"}}, {"$project": {"o_orderkey": 1, "line": "$items.line"}}],
    "SELECT l_orderkey AS o_orderkey, l_linenumber AS line FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'",
)
add_pipeline("add_fields", of("nation"), [{"$addFields": {"planet": "earth", "level": 3, "raw": "$n_name"}}, {"$project": {"n_name": 1, "planet": 1, "level": 1, "raw": 1}}], "SELECT n_name, 'earth' AS planet, CAST(3 AS BIGINT) AS level, '$n_name' AS raw FROM nation")
add_pipeline("count_stage", of("lineitem"), [{"$match": {"l_discount": {"$gt": 0.05}}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05")
add_pipeline("count_empty", of("lineitem"), [{"$match": {"l_quantity": {"$lt": 0}}}, {"$count": "n"}], "SELECT CAST(0 AS BIGINT) AS n")
add_pipeline("having", of("orders"), [{"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}, {"$match": {"n": {"$gte": 15}}}], "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
add_pipeline(
    "multi_stage",
    of("orders"),
    [
        {"$match": {"o_orderstatus": {"$in": ["O", "F"]}}},
        {"$match": {"o_totalprice": {"$gt": 20000}}},
        {"$group": {"_id": "$o_custkey", "spent": {"$sum": "$o_totalprice"}, "n": {"$sum": 1}}},
        {"$sort": {"n": -1, "_id": 1}},
        {"$skip": 5},
        {"$limit": 25},
        {"$project": {"_id": 1, "n": 1}},
    ],
    "SELECT o_custkey AS _id, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice > 20000 GROUP BY 1 ORDER BY n DESC, _id LIMIT 25 OFFSET 5",
)
add_pipeline("group_count_guided", of("customer"), [{"$group": {"_id": "$c_mktsegment", "count": {"$sum": 1}}}, {"$sort": {"count": -1}}], "SELECT c_mktsegment AS _id, count(*) AS count FROM customer GROUP BY 1")


# updates


def add_update(name: str, source: Query, where: dict[str, Any], update: dict[str, Any], columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir)
        return update_frame(df, compile_filter(where, Root.of(df)), update).selectExpr(*columns)

    query(name, sql)(run)


RICH = {"c_acctbal": {"$gt": 5000}}
for name, update, expression in [
    ("upd_set", {"$set": {"c_mktsegment": "VIP"}}, "c_custkey, c_acctbal, CASE WHEN c_acctbal > 5000 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment"),
    ("upd_inc", {"$inc": {"c_nationkey": 100}}, "c_custkey, CASE WHEN c_acctbal > 5000 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey"),
    ("upd_mul", {"$mul": {"c_acctbal": 2}}, "c_custkey, CASE WHEN c_acctbal > 5000 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal"),
    ("upd_min", {"$min": {"c_acctbal": 6000.0}}, "c_custkey, CASE WHEN c_acctbal > 5000 THEN least(c_acctbal, 6000.0) ELSE c_acctbal END AS c_acctbal"),
    ("upd_max", {"$max": {"c_acctbal": 6000.0}}, "c_custkey, CASE WHEN c_acctbal > 5000 THEN greatest(c_acctbal, 6000.0) ELSE c_acctbal END AS c_acctbal"),
    ("upd_unset", {"$unset": {"c_name": ""}}, "c_custkey, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_name END AS c_name"),
    ("upd_new_field", {"$inc": {"visits": 2}}, "c_custkey, CASE WHEN c_acctbal > 5000 THEN CAST(2 AS BIGINT) END AS visits"),
]:
    add_update(name, of("customer"), RICH, update, [re.sub(r".* AS ", "", c.strip()) for c in re.split(r",\s*(?![^(]*\))", re.sub(r"CASE .*? END AS ", "", expression))], f"SELECT {expression} FROM customer")
BUYER = {"types": "purchase"}
IS_BUYER = "list_contains(types, 'purchase')"
for name, update, changed in [
    ("upd_push", {"$push": {"types": {"$each": ["a", "b"]}}}, "types || ['a', 'b']"),
    ("upd_pull", {"$pull": {"types": "purchase"}}, "list_filter(types, lambda x: x <> 'purchase')"),
    ("upd_add_to_set", {"$addToSet": {"types": {"$each": ["view", "bonus", "bonus"]}}}, "CASE WHEN list_contains(types, 'view') THEN types ELSE types || ['view'] END || ['bonus']"),
    ("upd_pop_last", {"$pop": {"types": 1}}, "types[1:len(types) - 1]"),
    ("upd_pop_first", {"$pop": {"types": -1}}, "types[2:]"),
]:
    add_update(name, user_events, BUYER, update, ["user_id", "day", "array_join(types, ',') AS types"], f"SELECT user_id, day, coalesce(array_to_string(CASE WHEN {IS_BUYER} THEN {changed} ELSE types END, ','), '') AS types FROM {USER_EVENTS_SQL}")
add_update(
    "upd_nested",
    customer_docs,
    {"nation.region.name": "ASIA"},
    {"$set": {"nation.region.code": 7, "nation.name": "X"}},
    ["c_custkey", "nation.name AS nation", "nation.region.name AS region", "nation.region.code AS code"],
    f"SELECT c_custkey, CASE WHEN r_name = 'ASIA' THEN 'X' ELSE n_name END AS nation, r_name AS region, CASE WHEN r_name = 'ASIA' THEN CAST(7 AS BIGINT) END AS code FROM {CUSTOMER_SQL}",
)


def customers_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id"), "c_name", "c_acctbal")


@query("update_one", "SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN CAST(c_custkey AS VARCHAR) = (SELECT min(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_acctbal < 0) THEN 'debtor' ELSE c_name END AS c_name FROM customer")
def update_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Collection

    c = Collection(spark, "customers", customers_by_id(spark, sf_dir))
    c.update_one({"c_acctbal": {"$lt": 0}}, {"$set": {"c_name": "debtor"}})
    return c.frame().select("_id", "c_name")


@query("upsert", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name FROM customer UNION ALL SELECT 'new-1', 'New One'")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Collection

    c = Collection(spark, "customers", customers_by_id(spark, sf_dir))
    c.replace_one({"_id": "new-1"}, {"c_name": "New One", "c_acctbal": 1.0}, upsert=True)
    return c.frame().select("_id", "c_name")


@query("replace_one", "SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN c_custkey = 3 THEN 'Replaced' ELSE c_name END AS c_name, CASE WHEN c_custkey = 3 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def replace_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Collection

    c = Collection(spark, "customers", customers_by_id(spark, sf_dir))
    c.replace_one({"_id": "3"}, {"c_name": "Replaced"})
    return c.frame().select("_id", "c_name", "c_acctbal")


@query("delete_many", "SELECT CAST(c_custkey AS VARCHAR) AS _id FROM customer WHERE NOT c_acctbal < 1000")
def delete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Collection

    c = Collection(spark, "customers", customers_by_id(spark, sf_dir))
    c.delete_many({"c_acctbal": {"$lt": 1000}})
    return c.frame().select("_id")


@query("insert_many", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name FROM customer UNION ALL SELECT 'i1', 'One' UNION ALL SELECT 'i2', 'Two'")
def insert_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Collection

    c = Collection(spark, "customers", customers_by_id(spark, sf_dir))
    c.insert_many([{"_id": "i1", "c_name": "One", "c_acctbal": 1.5}, {"_id": "i2", "c_name": "Two", "c_acctbal": None}])
    return c.frame().select("_id", "c_name")


# changes: a log derived from the events


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a document; its events are writes in event order: first an insert, purchases delete, others update."""
    from pyspark.sql.window import Window

    line = Window.partitionBy("user_id").orderBy("event_id")
    doc = F.format_string('{"kind": "%s", "value": %d}', "event_type", F.floor("value"))
    before = F.lag(doc).over(line)
    op = F.when(F.row_number().over(line) == 1, "insert").when(F.col("event_type") == "purchase", "delete").otherwise("update")
    rows = table(spark, sf_dir, "events").withColumns({"op": op, "doc": doc, "before": before})
    return rows.select(
        F.lit(1).cast("long").alias("version"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("op").alias("operation"),
        F.lit("users").alias("collection"),
        F.col("user_id").cast("string").alias("document_id"),
        F.when(F.col("op") != "delete", F.col("doc")).alias("full_document"),
        F.col("before").alias("full_document_before"),
    )


LOG_SQL = (
    "(SELECT event_id, user_id, event_type, floor(value) AS v, row_number() OVER w AS rn, lag(event_type) OVER w AS kind_before, lag(floor(value)) OVER w AS v_before,"
    " row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back,"
    " CASE WHEN row_number() OVER w = 1 THEN 'insert' WHEN event_type = 'purchase' THEN 'delete' ELSE 'update' END AS op"
    " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"
)


@query("change_events", f"SELECT event_id AS seq, op AS operation_type, CAST(user_id AS VARCHAR) AS document_id, op <> 'delete' AS has_document FROM {LOG_SQL}")
def change_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = change_events(change_log(spark, sf_dir), full_document="updateLookup")
    return events.select(F.col("seq"), F.col("operationType").alias("operation_type"), F.col("documentKey._id").alias("document_id"), F.col("fullDocument").isNotNull().alias("has_document"))


CHANGED_SQL = """CASE WHEN event_type <> kind_before THEN '"' || event_type || '"' END AS kind, CASE WHEN v <> v_before THEN CAST(CAST(v AS BIGINT) AS VARCHAR) END AS value"""


@query("update_description", f"SELECT event_id AS seq, {CHANGED_SQL}, CAST(0 AS INT) AS removed FROM {LOG_SQL} WHERE op = 'update'")
def update_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = change_events(change_log(spark, sf_dir)).where("operationType = 'update'")
    changed = F.col("updateDescription.updatedFields")
    return events.select("seq", F.try_element_at(changed, F.lit("kind")).alias("kind"), F.try_element_at(changed, F.lit("value")).alias("value"), F.size("updateDescription.removedFields").alias("removed"))


@query("coalesce_log", f"SELECT CAST(user_id AS VARCHAR) AS document_id, op AS operation, event_id AS seq FROM {LOG_SQL} WHERE back = 1")
def coalesce_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalesced(change_log(spark, sf_dir)).select("document_id", "operation", "seq")


@query("compact_log", f"SELECT CAST(user_id AS VARCHAR) AS document_id, event_id AS seq, op AS operation FROM {LOG_SQL} l WHERE event_id <= (SELECT max(event_id) // 2 FROM events) OR back = 1")
def compact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    half = log.agg(F.max("seq").alias("top")).first()["top"] // 2
    return compacted(log, (1, half)).select("document_id", "seq", "operation")


@query("change_stream", f"SELECT event_id AS seq, op AS operation_type, CAST(user_id AS VARCHAR) AS document_id FROM {LOG_SQL} WHERE op IN ('insert', 'delete')")
def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change events by Structured Streaming: log folder -> filtered events -> Parquet sink with a checkpoint."""
    from lodestone.sources.folders import scratch
    from lodestone.streaming.events import LOG_SCHEMA

    folder = scratch(spark, "change_stream")
    change_log(spark, sf_dir).write.parquet(f"{folder}/log")
    events = change_events(spark.readStream.schema(LOG_SCHEMA).parquet(f"{folder}/log"))
    wanted = events.where(compile_filter({"operationType": {"$in": ["insert", "delete"]}, "ns.coll": "users"}, Root.of(events)))
    out = wanted.select("seq", F.col("operationType").alias("operation_type"), F.col("documentKey._id").alias("document_id"))
    out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("diff_documents", f"SELECT event_id AS seq, {CHANGED_SQL}, CAST(0 AS INT) AS n_unset FROM {LOG_SQL} WHERE op = 'update'")
def diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-level differences of each update's document pair, as column expressions."""
    rows = change_log(spark, sf_dir).where("operation = 'update'")
    old, new = top_level(F.col("full_document_before")), top_level(F.col("full_document"))
    rows = rows.select("seq", old.alias("old"), new.alias("new"))
    changed = F.map_filter("new", lambda k, v: ~v.eqNullSafe(F.try_element_at("old", k)))
    return rows.select("seq", F.try_element_at(changed, F.lit("kind")).alias("kind"), F.try_element_at(changed, F.lit("value")).alias("value"), F.size(F.array_except(F.map_keys("old"), F.map_keys("new"))).alias("n_unset"))


@query("prune_log", f"SELECT CAST(user_id AS VARCHAR) AS document_id, event_id AS seq, op AS operation FROM {LOG_SQL} WHERE event_id > (SELECT max(event_id) // 3 FROM events)")
def prune_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    third = log.agg(F.max("seq").alias("top")).first()["top"] // 3
    return log.where(F.struct("version", "seq") > F.struct(F.lit(1).cast("long").alias("version"), F.lit(third).cast("long").alias("seq"))).select("document_id", "seq", "operation")


@query("backfill_scan", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name FROM customer ORDER BY _id")
def backfill_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_by_id(spark, sf_dir).orderBy("_id").select("_id", "c_name")


@query("find_one", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name FROM customer WHERE c_acctbal > 9000 ORDER BY _id DESC LIMIT 1")
def find_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Collection

    c = Collection(spark, "customers", customers_by_id(spark, sf_dir))
    return c.find({"c_acctbal": {"$gt": 9000}}).sort({"_id": -1}).limit(1).project({"c_name": 1}).frame()


FIRST_RICH = "(SELECT min(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_acctbal > 9000)"


@query("delete_one", f"SELECT CAST(c_custkey AS VARCHAR) AS _id FROM customer WHERE CAST(c_custkey AS VARCHAR) <> {FIRST_RICH}")
def delete_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Collection

    c = Collection(spark, "customers", customers_by_id(spark, sf_dir))
    c.delete_one({"c_acctbal": {"$gt": 9000}})
    return c.frame().select("_id")


@query("find_one_and_update", f"SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN CAST(c_custkey AS VARCHAR) = {FIRST_RICH} THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def find_one_and_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Collection

    c = Collection(spark, "customers", customers_by_id(spark, sf_dir))
    c.find_one_and_update({"c_acctbal": {"$gt": 9000}}, {"$inc": {"c_acctbal": 1}})
    return c.frame().select("_id", "c_acctbal")


@query("update_many_documents", "SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN c_acctbal > 5000 THEN c_nationkey + 5 ELSE c_nationkey END AS nation, CASE WHEN c_acctbal > 5000 THEN 'x' END AS mark FROM customer")
def update_many_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document tier: JSON text in, JSON text out."""
    from lodestone.collection import Collection

    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.to_json(F.struct("c_acctbal", "c_nationkey")).alias("data"))
    c = Collection(spark, "customers", raw, documents=True)
    c.update_many({"c_acctbal": {"$gt": 5000}}, {"$inc": {"c_nationkey": 5}, "$push": {"notes.marks": "x"}})
    root = Root.of(c.rows(), "doc")
    return c.rows().select("_id", root.value("c_nationkey").number().cast("int").alias("nation"), root.value("notes.marks[0]").as_text().alias("mark"))


@query("unique_violations", "SELECT o_custkey AS k0, strftime(o_orderdate, '%Y-%m-%d') AS k1, count(*) AS count FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a unique index over two fields refuses, and why."""
    from lodestone.collection import Collection

    c = Collection(spark, "orders", table(spark, sf_dir, "orders"))
    try:
        c.create_index({"o_custkey": 1, "o_orderdate": 1}, unique=True)
    except ValueError:
        name = c.create_index({"o_custkey": 1, "o_orderdate": 1})
        return c.violations(name).withColumn("k1", F.date_format("k1", "yyyy-MM-dd"))
    raise AssertionError("the index was not refused")


@query("list_collections", "SELECT * FROM (VALUES ('customer'), ('nation'), ('region')) AS t(name)")
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Database

    db = Database(spark)
    for name in ("region", "customer", "nation"):
        db.register(name, table(spark, sf_dir, name))
    return spark.createDataFrame([(n,) for n in db.list_collections()], "name string")


@query("raw_sql_case", "SELECT c_mktsegment, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS debtors, count(*) * 2 AS twice FROM customer WHERE c_name LIKE 'Customer%' GROUP BY 1 ORDER BY debtors DESC")
def raw_sql_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Database

    db = Database(spark)
    db.register("customer", table(spark, sf_dir, "customer"))
    return db.sql("SELECT c_mktsegment, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS debtors, count(*) * 2 AS twice FROM customer WHERE c_name LIKE 'Customer%' GROUP BY 1 ORDER BY debtors DESC")


# tools


@query("schema_infer", "SELECT 'event_type' AS path, count(*) AS count, 'string' AS primary_type FROM events UNION ALL SELECT 'value', count(*), 'number' FROM events UNION ALL SELECT 'ts', count(*), 'date' FROM events")
def schema_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"))
    return infer_schema(df, sample=None).select("path", "count", F.col("primary_type"))


@query("guided_filter", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type ILIKE '%omo%' AND p_brand ILIKE 'brand#1%'")
def guided_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    spec = build_filter([("p_size", "number", "between", "10,20"), ("p_type", "string", "contains", "omo"), ("p_brand", "string", "startsWith", "Brand#1")], "all")
    return df.filter(compile_filter(spec, Root.of(df))).select("p_partkey")


@query("raw_sql", "SELECT c_mktsegment, round(avg(c_acctbal), 2) AS balance FROM customer WHERE c_name LIKE '%1%' AND c_acctbal BETWEEN 0 AND 8000 GROUP BY 1")
def raw_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.collection import Database

    db = Database(spark)
    db.register("customer", table(spark, sf_dir, "customer"))
    return db.sql("SELECT c_mktsegment, round(avg(c_acctbal), 2) AS balance FROM customer WHERE c_name LIKE '%1%' AND c_acctbal BETWEEN :low AND :high GROUP BY 1", {"low": 0, "high": 8000})


@query("find_invalid_json", "SELECT event_id FROM events WHERE event_id % 10 = 3")
def find_invalid_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.sources.documents import invalid_rows

    raw = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("_id"), F.when(F.col("event_id") % 10 == 3, '{"broken":').otherwise(F.col("props")).alias("data"))
    return invalid_rows(raw).select(F.col("_id").cast("long").alias("event_id"))


@query("corrupt_rows_skipped", "SELECT event_id FROM events WHERE event_id % 10 <> 3 AND CAST(json_extract_string(props, '$.k') AS INT) <> 5")
def corrupt_rows_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.sources.documents import documents_of

    raw = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("_id"), F.when(F.col("event_id") % 10 == 3, '{"broken":').otherwise(F.col("props")).alias("data"))
    docs = documents_of(raw)
    return docs.filter(F.col("data_valid") & compile_filter({"k": {"$ne": 5}}, Root.of(docs, "doc"))).select(F.col("_id").cast("long").alias("event_id"))


def queries() -> dict[str, Query]:
    import lodestone.plans.stored  # noqa: F401 - it registers its queries here

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


