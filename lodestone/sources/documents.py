"""The document tier: rows of (_id, data) where data is JSON text, read as VARIANT.

Broken text never fails a query. Filtered reads skip broken rows; unfiltered reads return them with a marker.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.values import iso, parse_iso

DOC, VALID = "doc", "data_valid"
#: The column of stored rows that holds the parsed text.
PARSED = "__parsed"
ISO_MILLIS = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$")


def documents_of(raw: DataFrame) -> DataFrame:
    """Adds ``doc`` (VARIANT, null where the text is broken) and ``data_valid``; stored documents have been parsed already."""
    doc = F.col(PARSED) if PARSED in raw.columns else F.try_parse_json("data")
    return raw.withColumns({DOC: doc, VALID: doc.isNotNull()}).drop(PARSED)


def with_parsed(raw: DataFrame) -> DataFrame:
    """Rows as they are stored: the text and beside it what it parses to."""
    return raw.withColumn(PARSED, F.try_parse_json("data"))


def invalid_rows(raw: DataFrame) -> DataFrame:
    """Rows whose text is not JSON; a null text is empty, not broken."""
    return raw.where(F.col("data").isNotNull() & F.try_parse_json("data").isNull())


def new_id() -> Column:
    """24 hexadecimal digits."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 24)


def object_id() -> str:
    return uuid.uuid4().hex[:24]


def validate(value: Any, path: str = "document", seen: tuple[int, ...] = ()) -> Any:
    """A storable copy: dates become ISO text, NaN and infinities null; what JSON cannot hold raises with its path."""
    if value is None or isinstance(value, (bool, str, int)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (dt.datetime, dt.date)):
        return iso(value)
    if isinstance(value, re.Pattern):
        raise TypeError(f"{path}: a regular expression cannot be stored")
    if callable(value):
        raise TypeError(f"{path}: a function cannot be stored")
    if id(value) in seen:
        raise ValueError(f"{path}: a document cannot contain itself")
    if isinstance(value, dict):
        return {str(k): validate(v, f"{path}.{k}", (*seen, id(value))) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [validate(v, f"{path}[{i}]", (*seen, id(value))) for i, v in enumerate(value)]
    raise TypeError(f"{path}: {type(value).__name__} cannot be stored")


def to_text(doc: dict[str, Any]) -> str:
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


def restore_dates(value: Any) -> Any:
    """Texts in the exact form that dates are written in become datetimes."""
    if isinstance(value, str) and len(value) == 24 and ISO_MILLIS.match(value):
        found = parse_iso(value)
        return found if found is not None and iso(found) == value else value
    if isinstance(value, dict):
        return {k: restore_dates(v) for k, v in value.items()}
    if isinstance(value, list):
        return [restore_dates(v) for v in value]
    return value


def read_text(identity: str, data: str | None) -> dict[str, Any]:
    """A stored row as a document; broken text gets one repair attempt, then a marker."""
    if not data:
        return {"_id": identity}
    try:
        doc = json.loads(data)
    except json.JSONDecodeError as error:
        try:
            doc = json.loads(json.loads(f'"{data}"')) if '\\"' in data else None
        except (json.JSONDecodeError, TypeError):
            doc = None
        if not isinstance(doc, dict):
            return {"_id": identity, "__corrupted": True, "__original": data, "__error": str(error)}
    if not isinstance(doc, dict):
        return {"_id": identity, "__corrupted": True, "__original": data, "__error": "not an object"}
    return restore_dates({"_id": identity, **doc})


def raw_documents(spark: SparkSession, docs: list[dict[str, Any]]) -> DataFrame:
    """Python documents as (_id, data); ids are made where they are missing."""
    rows = []
    for doc in docs:
        stored = validate(doc)
        identity = stored.pop("_id", None) or object_id()
        if not isinstance(identity, str):
            raise TypeError("_id must be a string")
        rows.append((identity, to_text(stored)))
    return spark.createDataFrame(rows, "_id string, data string")


def export_json(df: DataFrame, path: str, limit: int | None = None) -> None:
    """JSON lines, one file per partition, written by the executors."""
    (df if limit is None else df.limit(limit)).write.mode("overwrite").json(path)
