"""Update operators as column rewrites.

Typed frames are updated by native expressions; ``apply_update`` is the same language on one Python document and
serves the document tier, whose JSON text Spark cannot rewrite in place.
"""

from __future__ import annotations

import copy
import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.paths import parse
from lodestone.functions.values import canonical, iso, literal_of, type_of

OPERATORS = ("$set", "$unset", "$inc", "$mul", "$min", "$max", "$push", "$pull", "$addToSet", "$pop", "$currentDate")
Rewrite = Callable[[Column | None, T.DataType | None], tuple[Column, T.DataType]]
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def check(update: dict[str, Any]) -> None:
    if not update or not all(k.startswith("$") for k in update):
        raise ValueError("an update needs operators such as $set")
    for op in update:
        if op not in OPERATORS:
            raise ValueError(f"unknown update operator {op}")


def field_type(dtype: T.DataType | None, name: str) -> T.DataType | None:
    return dtype[name].dataType if isinstance(dtype, T.StructType) and name in dtype.names else None


def rebuilt(col: Column | None, dtype: T.DataType | None, names: list[str], rewrite: Rewrite) -> tuple[Column, T.DataType]:
    """A struct with the field at ``names`` rewritten; missing parents are made, other parents replaced."""
    if not names:
        return rewrite(col, dtype)
    name, rest = names[0], names[1:]
    fields: list[tuple[str, Column, T.DataType]] = []
    if isinstance(dtype, T.StructType) and col is not None:
        fields = [(f.name, col.getField(f.name), f.dataType) for f in dtype.fields]
    old = next(((c, t) for n, c, t in fields if n == name), (None, None))
    new, new_type = rebuilt(old[0], old[1], rest, rewrite)
    kept = [(n, new, new_type) if n == name else (n, c, t) for n, c, t in fields]
    if name not in [n for n, *_ in fields]:
        kept.append((name, new, new_type))
    return F.struct(*(c.alias(n) for n, c, _ in kept)), T.StructType([T.StructField(n, t) for n, _, t in kept])


def wider(a: T.DataType | None, value: Any) -> T.DataType:
    """The number type that holds both."""
    if a is not None and isinstance(a, NUMERIC):
        return T.DoubleType() if isinstance(value, float) and not isinstance(a, (T.FloatType, T.DoubleType, T.DecimalType)) else a
    return type_of(value)


def rewrite_for(op: str, arg: Any) -> Rewrite:
    def literal(value: Any, dtype: T.DataType | None) -> tuple[Column, T.DataType]:
        kind = dtype if dtype is not None and (value is None or compatible(value, dtype)) else type_of(value)
        return literal_of(value, kind), kind

    def run(col: Column | None, dtype: T.DataType | None) -> tuple[Column, T.DataType]:
        if op == "$set":
            return literal(arg, dtype)
        if op == "$unset":
            kind = dtype or T.StringType()
            return F.lit(None).cast(kind), kind
        if op in ("$inc", "$mul"):
            if col is not None and not isinstance(dtype, NUMERIC):
                return col, dtype  # not a number: stays
            kind = wider(dtype, arg)
            old = F.coalesce(col.cast(kind), F.lit(0).cast(kind)) if col is not None else F.lit(0).cast(kind)
            return (old + F.lit(arg) if op == "$inc" else old * F.lit(arg)).cast(kind), kind
        if op in ("$min", "$max"):
            new, kind = literal(arg, dtype)
            if col is None:
                return new, kind
            if kind != dtype:
                return col, dtype
            return (F.least if op == "$min" else F.greatest)(col, new), kind
        if op == "$currentDate":
            return current_date(arg, dtype)
        return array_rewrite(op, arg, col, dtype)

    return run


def compatible(value: Any, dtype: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(value, int):
        return isinstance(dtype, NUMERIC)
    if isinstance(value, float):
        return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))
    if isinstance(value, dict):
        return isinstance(dtype, T.StructType) and all(k in dtype.names and (v is None or compatible(v, dtype[k].dataType)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return isinstance(dtype, T.ArrayType) and all(v is None or compatible(v, dtype.elementType) for v in value)
    if isinstance(value, (dt.datetime, dt.date)):
        return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.StringType))
    return isinstance(dtype, T.StringType)


def current_date(arg: Any, dtype: T.DataType | None) -> tuple[Column, T.DataType]:
    kind = arg.get("$type") if isinstance(arg, dict) else "date" if arg is True else None
    if kind == "timestamp":
        return F.unix_millis(F.current_timestamp()), T.LongType()
    if kind != "date":
        raise ValueError(f"$currentDate takes true or {{$type: 'date' | 'timestamp'}}, not {arg!r}")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.current_timestamp().cast(dtype), dtype
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), T.StringType()


def array_rewrite(op: str, arg: Any, col: Column | None, dtype: T.DataType | None) -> tuple[Column, T.DataType]:
    if op == "$pop":
        if not isinstance(dtype, T.ArrayType) or col is None:
            return (col if col is not None else F.lit(None).cast("string")), dtype or T.StringType()
        less = F.greatest(F.size(col) - 1, F.lit(0))
        return F.when(F.size(col) <= 0, col).otherwise(F.slice(col, 2 if arg == -1 else 1, less)), dtype
    if op == "$pull":
        if not isinstance(dtype, T.ArrayType) or col is None:
            return (col if col is not None else F.lit(None).cast("string")), dtype or T.StringType()
        if arg is not None and not compatible(arg, dtype.elementType):
            return col, dtype
        gone = literal_of(arg, dtype.elementType)
        return F.filter(col, lambda e: ~e.eqNullSafe(gone)), dtype
    items = list(arg["$each"]) if isinstance(arg, dict) and "$each" in arg else [arg]
    if col is not None and not isinstance(dtype, T.ArrayType):
        if op == "$push":
            return col, dtype  # not an array: stays
        col, dtype = None, None  # $addToSet replaces it
    kind = dtype if isinstance(dtype, T.ArrayType) else T.ArrayType(type_of(items[0]) if items else T.StringType())
    new = F.array(*(literal_of(i, kind.elementType) for i in items)).cast(kind)
    old = F.coalesce(col, F.array().cast(kind)) if col is not None else F.array().cast(kind)
    if op == "$push":
        return F.concat(old, new), kind
    return F.concat(old, F.array_except(new, old)), kind


def steps(update: dict[str, Any]) -> list[tuple[str, str, Any]]:
    check(update)
    return [(op, path, arg) for op, fields in update.items() for path, arg in fields.items()]


def update_frame(df: DataFrame, matched: Column, update: dict[str, Any]) -> DataFrame:
    """The frame with the update applied where ``matched`` is true. Operators apply in order."""
    columns = list(df.columns)
    flag = "__matched"
    df = df.withColumn(flag, F.coalesce(matched, F.lit(False)))
    for op, path, arg in steps(update):
        first, *rest = (str(s) for s in parse(path))
        if first == "_id":
            raise ValueError("_id cannot be updated")
        exists = first in df.columns
        if op == "$unset" and not exists:
            continue
        old, dtype = (F.col(f"`{first}`"), df.schema[first].dataType) if exists else (None, None)
        new, kind = rebuilt(old, dtype, rest, rewrite_for(op, arg))
        keep = adapted(old, dtype, kind) if exists else F.lit(None).cast(kind)
        if exists and kind != dtype and not castable(dtype, kind):
            raise TypeError(f"{op} changes the type of {path} from {dtype.simpleString()} to {kind.simpleString()}; use the document tier")
        df = df.withColumn(first, F.when(F.col(flag), new).otherwise(keep))
        if first not in columns:
            columns.append(first)
    return df.select(*(f"`{c}`" for c in columns))


def castable(old: T.DataType | None, new: T.DataType) -> bool:
    if isinstance(old, NUMERIC) and isinstance(new, NUMERIC):
        return True
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return all(f.name in new.names and castable(f.dataType, new[f.name].dataType) for f in old.fields)
    return old == new


def adapted(col: Column, old: T.DataType, new: T.DataType) -> Column:
    """A column in a wider type: numbers are cast, fields that a struct gains are null."""
    if old == new:
        return col
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        parts = [(adapted(col.getField(f.name), old[f.name].dataType, f.dataType) if f.name in old.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    return col.cast(new)


# one Python document


def get_path(doc: Any, path: str) -> Any:
    for s in parse(path):
        if isinstance(doc, dict):
            doc = doc.get(str(s))
        elif isinstance(doc, list) and isinstance(s, int):
            doc = doc[s] if s < len(doc) else None
        else:
            return None
    return doc


def set_path(doc: dict[str, Any], path: str, value: Any) -> None:
    *parents, leaf = parse(path)
    at: Any = doc
    for s in parents:
        if isinstance(at, list) and isinstance(s, int) and s < len(at):
            at = at[s]
            continue
        below = at.get(str(s))
        if not isinstance(below, (dict, list)):
            below = at[str(s)] = {}
        at = below
    if isinstance(at, list) and isinstance(leaf, int):
        at += [None] * (leaf + 1 - len(at))
        at[leaf] = value
    else:
        at[str(leaf)] = value


def unset_path(doc: dict[str, Any], path: str) -> None:
    *parents, leaf = parse(path)
    at: Any = get_path(doc, ".".join(map(str, parents))) if parents else doc
    if isinstance(at, dict):
        at.pop(str(leaf), None)


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def apply_update(doc: dict[str, Any], update: dict[str, Any], now: dt.datetime | None = None) -> dict[str, Any]:
    """The document after the update; the argument is left as it is."""
    doc = copy.deepcopy(doc)
    now = now or dt.datetime.now(dt.timezone.utc)
    for op, path, arg in steps(update):
        old = get_path(doc, path)
        if op == "$set":
            set_path(doc, path, arg)
        elif op == "$unset":
            unset_path(doc, path)
        elif op in ("$inc", "$mul"):
            base = old if is_number(old) else 0
            if op == "$mul":
                set_path(doc, path, base * arg)
            elif is_number(old) or not old:
                set_path(doc, path, base + arg)
        elif op in ("$min", "$max"):
            same = type(old) is type(arg) or (is_number(old) and is_number(arg))
            if old is None or (same and (arg < old if op == "$min" else arg > old)):
                set_path(doc, path, arg)
        elif op == "$currentDate":
            kind = arg.get("$type") if isinstance(arg, dict) else "date" if arg is True else None
            if kind not in ("date", "timestamp"):
                raise ValueError(f"$currentDate takes true or {{$type: 'date' | 'timestamp'}}, not {arg!r}")
            set_path(doc, path, iso(now) if kind == "date" else int(now.timestamp() * 1000))
        elif op == "$pop":
            if isinstance(old, list) and old:
                set_path(doc, path, old[1:] if arg == -1 else old[:-1])
        elif op == "$pull":
            if isinstance(old, list):
                set_path(doc, path, [e for e in old if canonical(e) != canonical(arg)])
        else:
            items = list(arg["$each"]) if isinstance(arg, dict) and "$each" in arg else [arg]
            if op == "$push":
                if old is None or isinstance(old, list):
                    set_path(doc, path, [*(old or []), *items])
            else:
                kept = list(old) if isinstance(old, list) else []
                seen = {canonical(e) for e in kept}
                for item in items:
                    if canonical(item) not in seen:
                        seen.add(canonical(item))
                        kept.append(item)
                set_path(doc, path, kept)
    return doc
