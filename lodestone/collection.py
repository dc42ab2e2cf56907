"""Collections, cursors and databases over Spark frames.

A collection is typed (its columns are the fields) or a document collection (``_id``, ``data`` as JSON text). In a
database with a path, a write adds its own rows as a layer, with log rows and indexes that last; without one it replaces
the frame in memory.
"""

from __future__ import annotations

import itertools
import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.values import Doc, iso
from lodestone.operators.filters import Root, compile_filter
from lodestone.operators.ordering import SortSpec, sorted_rows
from lodestone.operators.pipeline import aggregate
from lodestone.operators.projection import project
from lodestone.operators.updates import apply_update, check, update_frame
from lodestone.sources.documents import DOC, PARSED, VALID, documents_of, invalid_rows, new_id, object_id, raw_documents, read_text, to_text, validate, with_parsed
from lodestone.sources.store import BEFORE, COMMITS, SnapshotStore
from lodestone.streaming.events import change_events

Filter = dict[str, Any]


def distinct_values(df: DataFrame, path: str, document: str | None = None) -> DataFrame:
    """The distinct values of a field as ``value``; arrays count by element, missing values do not."""
    value = Root.of(df, document).value(path)
    if isinstance(value, Doc):
        items = F.when(value.is_array(), F.transform(value.elements(), lambda e: F.to_json(e))).when(~value.missing(), F.array(F.to_json(value.col)))
        return df.select(F.explode(items).alias("value")).distinct()
    rows = df.select(F.explode(value.col).alias("value") if value.maybe_array() else value.col.alias("value"))
    return rows.where("value is not null").distinct()


def plain(row: Any) -> Any:
    """Rows and what they hold as dicts and lists."""
    if isinstance(row, T.Row):
        return {k: plain(v) for k, v in row.asDict().items()}
    if isinstance(row, list):
        return [plain(v) for v in row]
    if isinstance(row, T.VariantVal):
        return row.toPython()
    return row


@dataclass
class WriteResult:
    matched_count: int = 0
    modified_count: int = 0
    inserted_count: int = 0
    deleted_count: int = 0
    upserted_id: str | None = None
    inserted_ids: dict[int, str] = field(default_factory=dict)


def document_rows(df: DataFrame) -> DataFrame:
    """Whole documents as (_id, data), their text with all changes; other rows as they are."""
    if not {DOC, VALID} <= set(df.columns):
        return df
    return df.select(*(["_id"] if "_id" in df.columns else []), F.to_json(DOC).alias("data"))


class Cursor:
    """A lazy query; nothing runs before rows are asked for."""

    def __init__(self, collection: Collection, query: Filter | None, eq_mode: str = "exact"):
        self.collection, self.query, self.eq_mode = collection, query or {}, eq_mode
        self.order: SortSpec | None = None
        self.most: int | None = None
        self.offset = 0
        self.spec: dict[str, Any] | None = None

    def limit(self, n: int) -> Cursor:
        """At most n rows; 0 gives none."""
        if n < 0:
            raise ValueError("limit must not be negative")
        self.most = n
        return self

    def skip(self, n: int) -> Cursor:
        if n < 0:
            raise ValueError("skip must not be negative")
        self.offset = n
        return self

    def sort(self, spec: SortSpec) -> Cursor:
        self.order = spec
        return self

    def project(self, spec: dict[str, Any]) -> Cursor:
        self.spec = spec
        return self

    def _rows(self) -> DataFrame:
        c = self.collection
        df = c.matching(self.query, self.eq_mode)
        if self.order:
            df = sorted_rows(df, self.order, c.root(df), "first")
        if self.offset:
            df = df.offset(self.offset)
        return df if self.most is None else df.limit(self.most)

    def frame(self) -> DataFrame:
        """The result as a frame."""
        df, c = self._rows(), self.collection
        return document_rows(project(df, self.spec, c.root(df))) if self.spec else df if not c.documents else df.select("_id", "data")

    def to_array(self) -> list[dict[str, Any]]:
        """The documents as a list on the driver; ``map`` takes results of any size."""
        return list(self)

    def _source(self) -> tuple[DataFrame, Callable[[T.Row], dict[str, Any]]]:
        """The rows that are read, and what makes a document of one."""
        if not self.collection.documents:
            return self.frame(), plain
        spec = self.spec

        def document(row: T.Row) -> dict[str, Any]:
            doc = read_text(row["_id"], row["data"])
            return project_document(doc, spec) if spec else doc

        return self._rows().select("_id", "data"), document

    def __iter__(self) -> Iterator[dict[str, Any]]:
        df, document = self._source()
        yield from (document(r) for r in df.toLocalIterator())

    def map(self, function: Callable[[dict[str, Any]], tuple], schema: str) -> DataFrame:
        """What a function makes of each document, as rows of a schema. The executors read the documents; none goes to the driver."""
        df, document = self._source()
        made = F.udf(lambda row: function(document(row)), T.StructType.fromDDL(schema), useArrow=False).asNondeterministic()  # called once a row
        return df.select(made(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("made")).select("made.*")

    def next(self) -> dict[str, Any] | None:
        if not hasattr(self, "_iterator"):
            self._iterator = iter(self)
        return next(self._iterator, None)

    def first(self) -> dict[str, Any] | None:
        self.most = 1
        return next(iter(self), None)

    def count(self) -> int:
        """Rows that match the filter, limit and skip aside."""
        return self.collection.matching(self.query, self.eq_mode).count()

    def to_sql(self) -> str:
        """The optimised plan."""
        return self.frame()._jdf.queryExecution().optimizedPlan().toString()

    def explain(self, mode: str = "formatted") -> None:
        self.frame().explain(mode)


def project_document(doc: dict[str, Any], spec: dict[str, Any]) -> dict[str, Any]:
    """A projection on one Python document."""
    from lodestone.operators.projection import mode_of
    from lodestone.operators.updates import get_path, set_path, unset_path

    if mode_of(spec) == "exclude":
        out = json.loads(json.dumps(doc, default=iso))
        for path, keep in spec.items():
            if not keep:
                unset_path(out, path)
        return out
    out = {}
    for path, keep in spec.items():
        source = keep[1:] if isinstance(keep, str) else path
        if keep and path != "_id" and (value := get_path(doc, source)) is not None:
            set_path(out, path, value)
    if spec.get("_id", True):
        out["_id"] = doc["_id"]
    return out


class Collection:
    def __init__(self, spark: SparkSession, name: str, frame: DataFrame | None = None, store: SnapshotStore | None = None, documents: bool = False):
        self.spark, self.name, self.store, self.documents = spark, name, store, documents
        self._frame, self._version = frame, 0
        self._indexes: dict[str, tuple[tuple[tuple[str, int], ...], bool]] = {}
        self.memory_log: list[DataFrame] = []
        if documents and frame is None and store is None:
            self._frame = spark.createDataFrame([], "_id string, data string")

    # reading

    def frame(self) -> DataFrame:
        """All rows of the newest version."""
        return self._stored().drop(PARSED)

    def _stored(self) -> DataFrame:
        if self.store is not None:
            self._version = self.store.version(self.name)
            if self._version:
                return self.store.read(self.name)
            if self._frame is None:
                return self.spark.createDataFrame([], "_id string, data string" if self.documents else "_id string")
        if self._frame is None:
            return self.spark.createDataFrame([], "_id string")
        return self._frame

    def root(self, df: DataFrame) -> Root:
        return Root.of(df, DOC if self.documents else None)

    def rows(self) -> DataFrame:
        return documents_of(self._stored()) if self.documents else self.frame()

    def condition(self, df: DataFrame, query: Filter | None, eq_mode: str = "exact") -> Column:
        query = query or {}
        c = compile_filter(query, self.root(df), eq_mode=eq_mode)
        guarded = self.documents and any(k != "_id" for k in query)
        return F.col(VALID) & c if guarded else c

    def matching(self, query: Filter | None, eq_mode: str = "exact") -> DataFrame:
        df = self.rows()
        return df.filter(self.condition(df, query, eq_mode)) if query else df

    def find(self, query: Filter | None = None, eq_mode: str = "exact") -> Cursor:
        return Cursor(self, query, eq_mode)

    def find_one(self, query: Filter | None = None, projection: dict[str, Any] | None = None) -> dict[str, Any] | None:
        cursor = self.find(query)
        return (cursor.project(projection) if projection else cursor).first()

    def count_documents(self, query: Filter | None = None) -> int:
        return self.matching(query).count()

    def estimated_document_count(self) -> int:
        return self.frame().count()

    def distinct(self, path: str, query: Filter | None = None) -> list[Any]:
        """The distinct values as a list; ``distinct_values`` gives them as a frame."""
        found = (r["value"] for r in distinct_values(self.matching(query), path, DOC if self.documents else None).toLocalIterator())
        return [json.loads(v) for v in found] if self.documents else list(found)

    def aggregate(self, pipeline: list[dict[str, Any]], expressions: bool = False) -> DataFrame:
        df = self.rows()
        if self.documents:
            df = df.where(VALID)
        return document_rows(aggregate(df, pipeline, order_by="_id" if "_id" in df.columns else None, document=DOC if self.documents else None, expressions=expressions))

    def find_invalid_json(self) -> list[dict[str, Any]]:
        """The broken rows as a list; ``invalid_rows`` of the frame gives them as a frame."""
        return [r.asDict() for r in invalid_rows(self.frame()).toLocalIterator()] if self.documents else []

    def count_invalid_json(self) -> int:
        return invalid_rows(self.frame()).count() if self.documents else 0

    # writing

    def _json(self, df: DataFrame) -> Column:
        if self.documents:
            return F.col("data")
        return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "_id" and not c.startswith("__"))))

    def _keys(self, df: DataFrame, index: str) -> DataFrame:
        """The values that an index holds, without rows that lack one."""
        paths = [p for p, _ in self.indexes[index]]
        base = documents_of(df) if self.documents else df
        root = self.root(base)
        keyed = [root.value(p).as_text() if self.documents else root.value(p).col for p in paths]
        return base.select(*(k.alias(f"k{i}") for i, k in enumerate(keyed))).dropna()

    def _check_unique(self, new: DataFrame, rest: DataFrame | None) -> None:
        """Raise where rows of ``new`` share a unique index's values with each other or with ``rest``."""
        for name in self.unique:
            keyed = self._keys(new, name)
            repeated = keyed.groupBy(*keyed.columns).count().where("count > 1")
            if not repeated.isEmpty() or (rest is not None and not keyed.join(self._keys(rest, name), keyed.columns, "left_semi").isEmpty()):
                raise ValueError(f"duplicate value for unique index {name}")

    def insert_one(self, doc: dict[str, Any]) -> WriteResult:
        return self.insert_many([doc])

    def insert_many(self, docs: list[dict[str, Any]] | DataFrame) -> WriteResult:
        """Append documents or a whole frame; a duplicate _id is an error and nothing is written."""
        ids: dict[int, str] = {}
        if isinstance(docs, DataFrame):
            new = docs if "_id" in docs.columns else docs.withColumn("_id", new_id())
        elif not docs:
            return WriteResult()
        elif self.documents:
            docs = [{**d, "_id": d.get("_id") or object_id()} for d in docs]
            new = raw_documents(self.spark, docs)
            ids = {i: d["_id"] for i, d in enumerate(docs)}
        else:
            stored = [{**validate(d), "_id": d.get("_id") or object_id()} for d in docs]
            ids = {i: d["_id"] for i, d in enumerate(stored)}
            schema = self.frame().schema
            known = {f.name for f in schema.fields}
            extra = sorted({k for d in stored for k in d} - known)
            lines = self.spark.createDataFrame([(to_text(d),) for d in stored], "j string")
            added = F.schema_of_json(to_text({k: next(d[k] for d in stored if k in d) for k in extra})) if extra else None
            parsed = lines.select(F.from_json("j", schema).alias("v"), *([F.from_json("j", added).alias("x")] if extra else []))
            new = parsed.select("v.*", *(["x.*"] if extra else []))
        old = self.frame()
        if self.store is None:
            self._check_new(new, old, list(ids.values()))
            self._frame = old.unionByName(new, allowMissingColumns=True)
            self.memory_log.append(self._inserted(new))
            return WriteResult(inserted_count=len(ids) or new.count(), inserted_ids=ids)
        path = self._stage(new)
        staged = self.store.staged(path)
        try:
            self._check_new(staged, old, list(ids.values()))
        except ValueError:
            self.store.discard(path)
            raise
        self._version = self.store.commit_staged(self.name, path, self._inserted(staged), self._version)
        return WriteResult(inserted_count=len(ids) or staged.count(), inserted_ids=ids)

    def _stage(self, rows: DataFrame) -> str:
        return self.store.stage(self.name, with_parsed(rows) if self.documents and "data" in rows.columns else rows)

    def _check_new(self, new: DataFrame, old: DataFrame, ids: list[str]) -> None:
        if "_id" in old.columns and (self.store is None or self._version):
            same = old.where(F.col("_id").isin(ids)) if 0 < len(ids) <= 1000 else new.select("_id").join(old.select("_id"), "_id", "left_semi")
            if not same.isEmpty():
                raise ValueError("duplicate _id")
        if not new.groupBy("_id").count().where("count > 1").isEmpty():
            raise ValueError("duplicate _id")
        self._check_unique(new, old)

    def _inserted(self, new: DataFrame) -> DataFrame:
        return new.select(F.lit("insert").alias("operation"), F.col("_id").alias("document_id"), self._json(new).alias("full_document"), F.lit(None).cast("string").alias("full_document_before"))

    def _pick(self, query: Filter | None) -> str | None:
        """The first match: the smallest _id."""
        return self.matching(query).agg(F.min("_id").alias("id")).first()["id"]

    def _apply(self, hit_of: Callable[[DataFrame], Column], change: Callable[[DataFrame, Column], DataFrame], operation: str) -> None:
        """Rewrite the rows that ``hit_of`` marks and log them."""
        df = self.rows()
        before = df.withColumn("__hit", F.coalesce(hit_of(df), F.lit(False))).withColumn(BEFORE, self._json(df))
        if self.store is not None:  # only the rows that change are written
            before = before.where("__hit")
        after = change(before, F.col("__hit"))
        kept = [c for c in after.columns if c not in ("__hit", BEFORE, DOC, VALID)]

        def logged(rows: DataFrame) -> DataFrame:
            new = F.col("data") if self.documents else F.to_json(F.struct(*(F.col(f"`{c}`") for c in kept if c != "_id")))
            return rows.select(F.lit(operation).alias("operation"), F.col("_id").alias("document_id"), new.alias("full_document"), F.col(BEFORE).alias("full_document_before"))

        if self.store is None:
            out = after.select(*(f"`{c}`" for c in kept))
            self._check_unique(out, None)
            self._frame = out
            self.memory_log.append(logged(after.where("__hit")))
            return
        path = self._stage(after.select(*(f"`{c}`" for c in kept), BEFORE))
        staged = self.store.staged(path)
        try:
            if self.unique:
                self._check_unique(staged, self.frame().join(staged.select("_id"), "_id", "left_anti"))
        except ValueError:
            self.store.discard(path)
            raise
        self._version = self.store.commit_staged(self.name, path, logged(staged), self._version, gone="rows")

    def _rewrite(self, update: dict[str, Any]) -> Callable[[DataFrame, Column], DataFrame]:
        check(update)
        if not self.documents:
            return lambda df, hit: update_frame(df, hit, update)

        @F.pandas_udf("string")
        def changed(data: pd.Series) -> pd.Series:
            return data.map(lambda t: to_text(validate(apply_update(json.loads(t), update))))

        return lambda df, hit: df.withColumn("data", F.when(hit, changed(F.when(hit, F.col("data")).otherwise(F.lit("{}")))).otherwise(F.col("data")))

    def _write(self, query: Filter | None, update: dict[str, Any], many: bool) -> WriteResult:
        if many:
            n = self.matching(query).count()
            if n:
                self._apply(lambda df: self.condition(df, query), self._rewrite(update), "update")
            return WriteResult(n, n)
        identity = self._pick(query)
        if identity is None:
            return WriteResult()
        self._apply(lambda df: F.col("_id") == identity, self._rewrite(update), "update")
        return WriteResult(1, 1)

    def update_one(self, query: Filter, update: dict[str, Any], upsert: bool = False) -> WriteResult:
        """Update the match with the smallest _id. An upsert inserts what ``$set`` holds."""
        check(update)
        result = self._write(query, update, many=False)
        if not result.matched_count and upsert:
            made = self.insert_one(dict(update.get("$set", {})))
            return WriteResult(upserted_id=made.inserted_ids[0])
        return result

    def update_many(self, query: Filter, update: dict[str, Any]) -> WriteResult:
        return self._write(query, update, many=True)

    def replace_one(self, query: Filter, doc: dict[str, Any], upsert: bool = False) -> WriteResult:
        identity = self._pick(query)
        if identity is None:
            if not upsert:
                return WriteResult()
            wanted = query.get("_id")
            made = self.insert_one({**doc, "_id": doc.get("_id") or (wanted if isinstance(wanted, str) else object_id())})
            return WriteResult(upserted_id=made.inserted_ids[0])
        stored = validate({k: v for k, v in doc.items() if k != "_id"})
        if self.documents:
            change = lambda df, hit: df.withColumn("data", F.when(hit, F.lit(to_text(stored))).otherwise(F.col("data")))
        else:

            def change(df: DataFrame, hit: Column) -> DataFrame:
                for f in self.frame().schema.fields:
                    if f.name != "_id" and f.name not in stored:
                        df = df.withColumn(f.name, F.when(~hit, F.col(f"`{f.name}`")))
                return update_frame(df, hit, {"$set": stored}) if stored else df

        self._apply(lambda df: F.col("_id") == identity, change, "replace")
        return WriteResult(1, 1)

    def _delete(self, hit_of: Callable[[DataFrame], Column]) -> int:
        df = self.rows()
        marked = df.withColumn("__hit", F.coalesce(hit_of(df), F.lit(False)))
        gone = marked.where("__hit").select("*" if "_id" in df.columns else F.lit(None).cast("string").alias("_id"), self._json(df).alias(BEFORE))

        def logged(rows: DataFrame) -> DataFrame:
            return rows.select(F.lit("delete").alias("operation"), F.col("_id").alias("document_id"), F.lit(None).cast("string").alias("full_document"), F.col(BEFORE).alias("full_document_before"))

        if self.store is None:
            n = gone.count()
            if n:
                self._frame = marked.where("not __hit").select(*(f"`{c}`" for c in self.frame().columns))
                self.memory_log.append(logged(gone))
            return n
        path = self.store.stage(self.name, gone=gone.select("_id", BEFORE))
        staged = self.store.staged(path, "gone")
        n = staged.count()
        if not n:
            self.store.discard(path)
            return 0
        self._version = self.store.commit_staged(self.name, path, logged(staged), self._version, rows=False, gone="gone")
        return n

    def delete_one(self, query: Filter) -> WriteResult:
        identity = self._pick(query)
        return WriteResult(deleted_count=0 if identity is None else self._delete(lambda df: F.col("_id") == identity))

    def delete_many(self, query: Filter | None = None) -> WriteResult:
        """Delete all matches; the empty filter purges broken rows too."""
        return WriteResult(deleted_count=self._delete(lambda df: self.condition(df, query)))

    def _found(self, query: Filter) -> dict[str, Any] | None:
        identity = self._pick(query)
        return None if identity is None else self.find_one({"_id": identity})

    def find_one_and_update(self, query: Filter, update: dict[str, Any], return_after: bool = False, upsert: bool = False, projection: dict[str, Any] | None = None) -> dict[str, Any] | None:
        old = self._found(query)
        if old is None:
            made = self.update_one(query, update, upsert)
            out = self.find_one({"_id": made.upserted_id}) if made.upserted_id and return_after else None
        else:
            self.update_one({"_id": old["_id"]}, update)
            out = self.find_one({"_id": old["_id"]}) if return_after else old
        return project_document(out, projection) if out and projection else out

    def find_one_and_replace(self, query: Filter, doc: dict[str, Any], return_after: bool = False, upsert: bool = False, projection: dict[str, Any] | None = None) -> dict[str, Any] | None:
        old = self._found(query)
        made = self.replace_one({"_id": old["_id"]} if old else query, doc, upsert)
        identity = old["_id"] if old else made.upserted_id
        out = (self.find_one({"_id": identity}) if identity else None) if return_after else old
        return project_document(out, projection) if out and projection else out

    def find_one_and_delete(self, query: Filter, projection: dict[str, Any] | None = None) -> dict[str, Any] | None:
        old = self._found(query)
        if old is not None:
            self.delete_one({"_id": old["_id"]})
        return project_document(old, projection) if old and projection else old

    # indexes are stored metadata, a uniqueness rule and a hint for the layout

    def _all_indexes(self) -> dict[str, tuple[tuple[tuple[str, int], ...], bool]]:
        if self.store is None:
            return self._indexes
        return {name: (keys, unique) for name, keys, unique in self.store.table(self.name).indexes}

    def _keep_indexes(self, indexes: dict[str, tuple[tuple[tuple[str, int], ...], bool]]) -> None:
        if self.store is None:
            self._indexes = indexes
        else:
            self.store.set_indexes(self.name, [(name, keys, unique) for name, (keys, unique) in indexes.items()])

    @property
    def indexes(self) -> dict[str, tuple[tuple[str, int], ...]]:
        return {name: keys for name, (keys, _) in self._all_indexes().items()}

    @property
    def unique(self) -> set[str]:
        return {name for name, (_, unique) in self._all_indexes().items() if unique}

    def create_index(self, spec: dict[str, int] | str, unique: bool = False, name: str | None = None) -> str:
        keys = tuple({spec: 1}.items() if isinstance(spec, str) else spec.items())
        if not keys:
            raise ValueError("an index needs a field")
        name = name or "_".join([self.name, *(f"{p.replace('.', '_')}_{d}" for p, d in keys)])
        before = self._all_indexes()
        self._keep_indexes({**before, name: (keys, unique)})
        if unique and not self.violations(name).isEmpty():
            self._keep_indexes(before)
            raise ValueError(f"duplicate value for unique index {name}")
        return name

    def violations(self, name: str) -> DataFrame:
        """The values of an index that more than one row has (``k0``.., ``count``)."""
        keyed = self._keys(self.frame(), name)
        return keyed.groupBy(*keyed.columns).count().where("count > 1")

    def list_indexes(self) -> list[dict[str, Any]]:
        return [{"name": n, "key": dict(keys), "unique": unique} for n, (keys, unique) in self._all_indexes().items()]

    def drop_index(self, name: str) -> None:
        before = self._all_indexes()
        if name in before:
            self._keep_indexes({n: x for n, x in before.items() if n != name})

    def drop_indexes(self) -> int:
        n = len(self._all_indexes())
        if n:
            self._keep_indexes({})
        return n

    def clustered(self, name: str, partitions: int | None = None) -> DataFrame:
        """The rows laid out for an index: range-partitioned and sorted by its keys, so that Parquet ranges prune."""
        df = self.frame()
        keys = [Root.of(df).value(p).col for p, _ in self.indexes[name]]
        ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
        return ranged.sortWithinPartitions(*keys)

    def drop(self) -> None:
        if self.store is not None:
            self.store.drop(self.name)
        self._frame, self._indexes = None, {}

    def watch(self, query: Filter | None = None, full_document: str = "default", before: str = "off", buffer: int = 1000) -> ChangeStream:
        if self.store is None:
            raise ValueError("watch() needs a database with a path")
        return ChangeStream(self, query, full_document, before, buffer)


class ChangeStream:
    """Change events of a collection by Structured Streaming over the log of committed writes.

    A new stream starts at the log's beginning; with a checkpoint folder it goes on where it stopped.
    """

    def __init__(self, collection: Collection, query: Filter | None, full_document: str, before: str, buffer: int):
        self.collection, self.query, self.full_document, self.before = collection, query or {}, full_document, before
        self.buffer: deque[dict[str, Any]] = deque(maxlen=buffer)
        self.running = None

    def frame(self) -> DataFrame:
        """The events as a streaming frame."""
        c = self.collection
        events = change_events(c.store.log_stream().where(F.col("collection") == c.name), self.full_document, self.before)
        return events.where(compile_filter(self.query, Root.of(events))) if self.query else events

    def _take(self, batch: DataFrame, _: int) -> None:
        newest = batch.orderBy(F.desc("version"), F.desc("seq")).limit(self.buffer.maxlen or 1000)
        self.buffer.extend(plain(r) for r in reversed(newest.collect()))

    def start(self, checkpoint: str | None = None, interval: str = "1 second", handler: Callable[[DataFrame, int], None] | None = None) -> ChangeStream:
        writer = self.frame().writeStream.foreachBatch(handler or self._take).trigger(processingTime=interval)
        self.running = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
        return self

    def drain(self, checkpoint: str | None = None) -> list[dict[str, Any]]:
        """All events that are there now, as a list; the buffer's bound does not apply (``start`` with a handler keeps events distributed)."""
        found: list[dict[str, Any]] = []

        def take(batch: DataFrame, _: int) -> None:
            found.extend(plain(r) for r in batch.orderBy("version", "seq").toLocalIterator())

        writer = self.frame().writeStream.foreachBatch(take).trigger(availableNow=True)
        (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
        return found

    def next(self) -> dict[str, Any] | None:
        """The oldest buffered event, taken out."""
        if not self.buffer and self.running is not None:
            self.running.processAllAvailable()
        return self.buffer.popleft() if self.buffer else None

    def __iter__(self) -> Iterator[dict[str, Any]]:
        return iter(self.next, None)

    def close(self) -> None:
        if self.running is not None:
            self.running.stop()


class Database:
    """Named collections of one session; with ``path`` they are stored there."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.store = SnapshotStore(spark, path) if path else None
        self.open: dict[str, Collection] = {}

    def collection(self, name: str, documents: bool = True) -> Collection:
        if name.startswith("_") or not name.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"bad collection name {name!r}")
        if name not in self.open:
            self.open[name] = Collection(self.spark, name, store=self.store, documents=documents)
        return self.open[name]

    def register(self, name: str, frame: DataFrame, documents: bool = False) -> Collection:
        """A frame as a collection (in memory)."""
        self.open[name] = Collection(self.spark, name, frame, documents=documents)
        return self.open[name]

    def list_collections(self) -> list[str]:
        return sorted({*self.open, *(self.store.names() if self.store else ())})

    def list_collection_info(self) -> list[dict[str, Any]]:
        out = []
        for name in self.list_collections():
            df = self.collection(name).frame()
            out.append({"name": name, "count": df.count(), "is_document": {"_id", "data"} <= set(df.columns), "fields": df.columns})
        return out

    def sql(self, statement: str, args: dict[str, Any] | list[Any] | None = None) -> DataFrame:
        """Spark SQL over the collections as views, with bound parameters."""
        for name in self.list_collections():
            self.collection(name).frame().createOrReplaceTempView(name.replace("-", "_"))
        return self.spark.sql(statement, args=args) if args else self.spark.sql(statement)

    def register_function(self, name: str, function: Any, kind: Any = None) -> None:
        self.spark.udf.register(name, function, kind) if kind is not None else self.spark.udf.register(name, function)


def discover(path: str, spark: SparkSession, depth: int = 2, limit: int = 50) -> list[str]:
    """Folders below ``path`` that hold stored collections, newest first."""
    store = SnapshotStore(spark, path)
    todo, found = deque([(path.rstrip("/"), 0)]), []
    while todo:
        at, level = todo.popleft()
        p = store.jvm.org.apache.hadoop.fs.Path(at)
        fs = p.getFileSystem(store.conf)
        folders = [s for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
        if any(s.getPath().getName() == COMMITS for s in folders):
            found.append((max(s.getModificationTime() for s in folders), at))
        elif level < depth:
            todo.extend((str(s.getPath()), level + 1) for s in folders)
    return [at for _, at in itertools.islice(sorted(found, reverse=True), limit)]
