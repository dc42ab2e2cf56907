"""Change events: the same column expressions serve batch frames and Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a change log. Documents are JSON text; (version, seq) orders the log.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("operation", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("full_document", T.StringType()),
        T.StructField("full_document_before", T.StringType()),
    ]
)


def position() -> Column:
    return F.struct("version", "seq")


def top_level(document: Column) -> Column:
    """Top-level fields of a JSON object as map<string, canonical JSON>; empty where it is null or broken."""
    fields = F.try_parse_json(document).cast("map<string,variant>")
    return F.coalesce(F.transform_values(fields, lambda _, v: F.to_json(v)), F.create_map().cast("map<string,string>"))


def change_events(log: DataFrame, full_document: str = "default", before: str = "off", database: str = "lodestone") -> DataFrame:
    """Log rows as change events.

    ``full_document``: ``default`` gives the document on inserts only, anything else on inserts, updates and
    replacements. ``before`` other than ``off`` adds the document before updates, replacements and deletes.
    """
    op, after, prior = F.col("operation"), F.col("full_document"), F.col("full_document_before")
    shown = op == "insert" if full_document == "default" else op.isin("insert", "update", "replace")
    rows = log.withColumns({"__new": top_level(after), "__old": top_level(prior)})
    changed = F.map_filter(F.col("__new"), lambda k, v: ~v.eqNullSafe(F.try_element_at(F.col("__old"), k)))
    removed = F.array_except(F.map_keys("__old"), F.map_keys("__new"))
    description = F.struct(changed.alias("updatedFields"), removed.alias("removedFields"))
    return rows.select(
        F.concat_ws("-", "version", "seq").alias("_id"),
        "version",
        "seq",
        op.alias("operationType"),
        F.col("timestamp").alias("clusterTime"),
        F.struct(F.col("document_id").alias("_id")).alias("documentKey"),
        F.struct(F.lit(database).alias("db"), F.col("collection").alias("coll")).alias("ns"),
        F.when(shown, after).alias("fullDocument"),
        F.when(op.isin("update", "replace", "delete") & F.lit(before != "off"), prior).alias("fullDocumentBeforeChange"),
        F.when(op == "update", description).alias("updateDescription"),
    )


def coalesced(log: DataFrame) -> DataFrame:
    """The last log row of each document (a partial aggregate, so a hot document shuffles one row per task)."""
    latest = log.groupBy("collection", "document_id").agg(F.max_by(F.struct(*[c for c in log.columns if c not in ("collection", "document_id")]), position()).alias("last"))
    return latest.select("collection", "document_id", "last.*").select(*log.columns)


def compacted(log: DataFrame, floor: tuple[int, int]) -> DataFrame:
    """The log with only each document's last row above ``floor``; rows at or below it stay."""
    at = F.struct(F.lit(floor[0]).cast("long").alias("version"), F.lit(floor[1]).cast("long").alias("seq"))
    return log.where(position() <= at).unionByName(coalesced(log.where(position() > at)))
