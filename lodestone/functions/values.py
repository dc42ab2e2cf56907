"""One view of a field, whether it is a typed column or part of a VARIANT document.

Comparisons are bracketed by type: a number never compares with a text. All results follow SQL's three-valued
logic; callers that negate use ``holds`` first.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.paths import Segment, variant_path

#: BSON type codes and aliases (fixed values).
TYPE_NAMES = {
    1: "number", 2: "string", 3: "object", 4: "array", 8: "bool", 9: "date", 10: "null", 16: "int", 18: "long",
    "double": "number", "number": "number", "string": "string", "object": "object", "array": "array", "bool": "bool", "boolean": "bool", "date": "date", "null": "null", "int": "int", "long": "long",
}
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
Pred = Callable[["Value"], Column]


def false() -> Column:
    return F.lit(False)


def true() -> Column:
    return F.lit(True)


def holds(c: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(c, false())


def iso(value: dt.datetime | dt.date) -> str:
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value.isoformat(timespec="milliseconds") + "Z"


def parse_iso(text: str) -> dt.datetime | None:
    try:
        value = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def kind_of(value: Any) -> str:
    """number, string, bool, date, null, array or object."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (dt.datetime, dt.date)):
        return "date"
    if isinstance(value, (list, tuple)):
        return "array"
    if isinstance(value, dict):
        return "object"
    raise TypeError(f"unsupported value in a filter: {value!r}")


def canonical(value: Any) -> str:
    """JSON with sorted keys and without blanks, numbers as Spark writes them from a variant."""

    def plain(x: Any) -> Any:
        if isinstance(x, (dt.datetime, dt.date)):
            return iso(x)
        if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class Value:
    col: Column

    def child(self, segments: tuple[Segment, ...]) -> Value:
        raise NotImplementedError

    def missing(self) -> Column:
        raise NotImplementedError

    def null(self) -> Column:
        """Null or missing."""
        raise NotImplementedError

    def equals(self, other: Any) -> Column:
        raise NotImplementedError

    def compare(self, op: str, other: Any) -> Column:
        raise NotImplementedError

    def maybe_array(self) -> bool:
        raise NotImplementedError

    def is_array(self) -> Column:
        raise NotImplementedError

    def any_element(self, pred: Pred) -> Column:
        raise NotImplementedError

    def size_is(self, n: int) -> Column:
        raise NotImplementedError

    def type_is(self, name: str) -> Column:
        raise NotImplementedError

    def as_text(self) -> Column:
        raise NotImplementedError

    def number(self) -> Column:
        raise NotImplementedError

    def sort_keys(self) -> list[Column]:
        raise NotImplementedError

    def either(self, pred: Pred) -> Column:
        """The predicate on the value itself or, for an array, on one of its elements."""
        return pred(self) | self.any_element(pred) if self.maybe_array() else pred(self)


def operation(op: str, a: Column, b: Column) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b, "eq": a == b}[op]


NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)


class Typed(Value):
    """A column with a static type; a null field is a missing field."""

    def __init__(self, col: Column, dtype: T.DataType):
        self.col, self.dtype = col, dtype

    def child(self, segments: tuple[Segment, ...]) -> Value:
        value: Value = self
        for i, s in enumerate(segments):
            if isinstance(value, Doc):
                return value.child(segments[i:])
            kind = value.dtype  # type: ignore[attr-defined]
            if isinstance(kind, T.StructType) and str(s) in kind.names:
                value = wrap(value.col.getField(str(s)), kind[str(s)].dataType)
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                value = wrap(F.try_element_at(value.col, F.lit(str(s))), kind.valueType)
            elif isinstance(kind, T.ArrayType) and isinstance(s, int):
                value = wrap(F.get(value.col, F.lit(s)), kind.elementType)
            else:
                return Absent()
        return value

    def missing(self) -> Column:
        return self.col.isNull()

    null = missing

    def kind(self) -> str:
        d = self.dtype
        for kind, types in (("number", NUMBERS), ("string", (T.StringType,)), ("bool", (T.BooleanType,)), ("date", DATES), ("array", (T.ArrayType,)), ("object", (T.StructType, T.MapType))):
            if isinstance(d, types):
                return kind
        return "other"

    def literal(self, other: Any) -> Column | None:
        """The other side as a literal of a comparable type, or None where the types never meet."""
        mine, theirs = self.kind(), kind_of(other)
        if mine == "date":
            value = other if theirs == "date" else parse_iso(other) if theirs == "string" else None
            if value is None:
                return None
            if not isinstance(value, dt.datetime):
                value = dt.datetime(value.year, value.month, value.day)
            if value.tzinfo:
                value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
            return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz" if isinstance(self.dtype, T.TimestampNTZType) else "timestamp")
        if mine == "string" and theirs == "date":
            return F.lit(iso(other))
        if mine != theirs or mine in ("array", "object"):
            return None
        if mine == "number" and isinstance(self.dtype, T.LongType) and isinstance(other, int):
            return F.lit(other).cast("bigint") if -(1 << 63) <= other < 1 << 63 else F.lit(float(other))
        return F.lit(other)

    def equals(self, other: Any) -> Column:
        if other is None:
            return self.null()
        if isinstance(other, dict) and isinstance(self.dtype, T.StructType):
            return F.to_json(self.col) == F.to_json(literal_of(other, self.dtype)) if set(other) <= set(self.dtype.names) else false()
        if isinstance(other, (list, tuple)) and isinstance(self.dtype, T.ArrayType):
            return self.col == literal_of(list(other), self.dtype)
        value = self.literal(other)
        return false() if value is None else self.col == value

    def compare(self, op: str, other: Any) -> Column:
        value = self.literal(other)
        return false() if value is None else operation(op, self.col, value)

    def maybe_array(self) -> bool:
        return isinstance(self.dtype, T.ArrayType)

    def is_array(self) -> Column:
        return self.col.isNotNull() if self.maybe_array() else false()

    def any_element(self, pred: Pred) -> Column:
        if not self.maybe_array():
            return false()
        return F.exists(self.col, lambda e: holds(pred(wrap(e, self.dtype.elementType))))  # type: ignore[attr-defined]

    def size_is(self, n: int) -> Column:
        return F.size(self.col) == n if self.maybe_array() else false()

    def type_is(self, name: str) -> Column:
        mine = self.kind()
        if name in ("int", "long"):
            whole = isinstance(self.dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            return self.col.isNotNull() if whole else false()
        if name == "null":
            return self.col.isNull()
        return self.col.isNotNull() if mine == name else false()

    def as_text(self) -> Column:
        if self.kind() in ("array", "object"):
            return F.to_json(self.col)
        if self.kind() == "date":
            return F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return self.col.cast("string")

    def number(self) -> Column:
        return self.col if self.kind() == "number" else F.lit(None).cast("double")

    def sort_keys(self) -> list[Column]:
        return [F.to_json(self.col) if self.kind() == "object" else self.col]


class Absent(Value):
    """A path that the schema does not have: missing in every row."""

    dtype = T.NullType()

    @property
    def col(self) -> Column:  # type: ignore[override]
        return F.lit(None)

    def child(self, segments: tuple[Segment, ...]) -> Value:
        return self

    def missing(self) -> Column:
        return true()

    def null(self) -> Column:
        return true()

    def equals(self, other: Any) -> Column:
        return true() if other is None else false()

    def compare(self, op: str, other: Any) -> Column:
        return false()

    def maybe_array(self) -> bool:
        return False

    def is_array(self) -> Column:
        return false()

    def any_element(self, pred: Pred) -> Column:
        return false()

    def size_is(self, n: int) -> Column:
        return false()

    def type_is(self, name: str) -> Column:
        return false()

    def as_text(self) -> Column:
        return F.lit(None).cast("string")

    def number(self) -> Column:
        return F.lit(None).cast("double")

    def sort_keys(self) -> list[Column]:
        return [F.lit(None).cast("string")]


class Doc(Value):
    """A VARIANT: SQL null is missing, variant null is an explicit null."""

    def __init__(self, col: Column):
        self.col = col

    def child(self, segments: tuple[Segment, ...]) -> Value:
        return Doc(F.try_variant_get(self.col, variant_path(segments), "variant")) if segments else self

    def tag(self) -> Column:
        return F.schema_of_variant(self.col)

    def missing(self) -> Column:
        return self.col.isNull()

    def null(self) -> Column:
        return self.col.isNull() | F.is_variant_null(self.col)

    def is_number(self) -> Column:
        return self.tag().rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")

    def _get(self, kind: str) -> Column:
        return F.try_variant_get(self.col, "$", kind)

    def number(self) -> Column:
        return F.when(self.is_number(), self._get("double"))

    def text(self) -> Column:
        return F.when(self.tag() == "STRING", self._get("string"))

    def truth(self) -> Column:
        return F.when(self.tag() == "BOOLEAN", self._get("boolean"))

    def equals(self, other: Any) -> Column:
        kind = kind_of(other)
        if kind == "null":
            return self.null()
        if kind in ("array", "object"):
            return F.to_json(self.col) == F.lit(canonical(other))
        return self.compare("eq", other)

    def compare(self, op: str, other: Any) -> Column:
        kind = kind_of(other)
        if kind == "number":
            return operation(op, self.number(), F.lit(float(other)))
        if kind == "string":
            return operation(op, self.text(), F.lit(other))
        if kind == "date":
            return operation(op, self.text(), F.lit(iso(other)))
        if kind == "bool":
            return operation(op, self.truth(), F.lit(other))
        return false()

    def maybe_array(self) -> bool:
        return True

    def is_array(self) -> Column:
        return self.tag().startswith("ARRAY")

    def elements(self) -> Column:
        return F.when(self.is_array(), self._get("array<variant>"))

    def any_element(self, pred: Pred) -> Column:
        return F.exists(self.elements(), lambda e: holds(pred(Doc(e))))

    def size_is(self, n: int) -> Column:
        return F.size(self.elements()) == n

    def type_is(self, name: str) -> Column:
        tag = self.tag()
        if name == "number":
            return self.is_number()
        if name in ("int", "long"):
            return tag == "BIGINT"
        if name == "string":
            return tag == "STRING"
        if name == "date":
            return self.text().rlike(ISO)
        if name == "bool":
            return tag == "BOOLEAN"
        if name == "null":
            return tag == "VOID"
        return tag.startswith("ARRAY") if name == "array" else tag.startswith("OBJECT")

    def as_text(self) -> Column:
        return F.when(F.is_variant_null(self.col), F.lit(None)).otherwise(F.when(self.tag() == "STRING", self._get("string")).otherwise(F.to_json(self.col)))

    def sort_keys(self) -> list[Column]:
        rank = F.when(self.null(), None).when(self.is_number() | (self.tag() == "BOOLEAN"), F.lit(1)).otherwise(F.lit(2))
        number = F.coalesce(self.number(), self.truth().cast("double"))
        return [rank, number, F.when(rank == 2, self.as_text())]


def fields_of(document: Column) -> Column:
    """The fields of an object as a map; empty for what is no object."""
    return F.coalesce(F.try_variant_get(document, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def with_field(document: Column, names: list[str], value: Column) -> Column:
    """The document with a field set; parents that are no objects become objects."""
    name, *below = names
    fields = fields_of(document)
    inner = with_field(F.try_element_at(fields, F.lit(name)), below, value) if below else value
    return F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), inner)))


def without_field(document: Column, names: list[str]) -> Column:
    """The document without a field; as it is where the field's parent is no object."""
    name, *below = names
    fields = fields_of(document)
    rest = F.map_filter(fields, lambda k, _: k != name)
    if not below:
        return F.when(F.map_contains_key(fields, name), F.to_variant_object(rest)).otherwise(document)
    inner = F.try_element_at(fields, F.lit(name))
    is_object = F.schema_of_variant(inner).startswith("OBJECT")
    return F.when(is_object, F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(name), without_field(inner, below))))).otherwise(document)


def as_variant(value: Any) -> Column:
    """A Python value as a variant literal."""
    return F.parse_json(F.lit(canonical(value)))


def wrap(col: Column, dtype: T.DataType) -> Value:
    return Doc(col) if isinstance(dtype, T.VariantType) else Typed(col, dtype)


def literal_of(value: Any, dtype: T.DataType) -> Column:
    """A Python value as a literal of the given type (nested types included)."""
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.StructType):
        return F.struct(*(literal_of(value.get(f.name), f.dataType).alias(f.name) for f in dtype.fields))
    if isinstance(dtype, T.ArrayType):
        return F.array(*(literal_of(v, dtype.elementType) for v in value)).cast(dtype)
    if isinstance(dtype, T.VariantType):
        return F.parse_json(F.lit(canonical(value)))
    if isinstance(value, (dt.datetime, dt.date)) and isinstance(dtype, T.StringType):
        return F.lit(iso(value))
    if isinstance(value, str) and isinstance(dtype, DATES):
        value = parse_iso(value)
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast(dtype)
    return F.lit(value).cast(dtype)


def type_of(value: Any) -> T.DataType:
    """The column type for a new field that holds this Python value."""
    kind = kind_of(value)
    if kind == "object":
        return T.StructType([T.StructField(k, type_of(v)) for k, v in value.items()])
    if kind == "array":
        return T.ArrayType(type_of(value[0]) if value else T.StringType())
    if kind == "number":
        return T.LongType() if isinstance(value, int) else T.DoubleType()
    return {"string": T.StringType(), "bool": T.BooleanType(), "date": T.TimestampType(), "null": T.StringType()}[kind]
