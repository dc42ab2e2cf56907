"""Filters: the JSON predicate language compiled to one Column.

The same compiler serves find, count, update, delete and every ``$match``. Negations are two-valued: what a
condition does not know to be true, its negation takes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import patterns
from lodestone.functions.paths import parse
from lodestone.functions.values import TYPE_NAMES, Absent, Doc, Typed, Value, false, holds, kind_of, true, wrap

#: Operators that a field may carry.
FIELD_OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$not", "$all", "$elemMatch", "$regex", "$options", "$size", "$type", "$mod")
LOGICAL = ("$and", "$or", "$nor", "$not", "$text", "$exists", "$elemMatch", "$all")


class Root:
    """Where paths start: the columns of a frame, plus the fields of its document column if it has one."""

    def __init__(self, schema: T.StructType, document: str | None = None):
        self.schema, self.document = schema, document

    @classmethod
    def of(cls, df: DataFrame, document: str | None = None) -> Root:
        return cls(df.schema, document)

    def value(self, path: str) -> Value:
        first, *rest = parse(path)
        if str(first) in self.schema.names and (str(first) == "_id" or self.document is None):
            return wrap(F.col(f"`{first}`"), self.schema[str(first)].dataType).child(tuple(rest))
        if self.document is not None:
            return Doc(F.col(self.document)).child((first, *rest))
        return Absent()

    def texts(self) -> list[Column]:
        """What ``$text`` searches: every string of the row, keys included for documents."""
        if self.document is not None:
            return [F.to_json(F.col(self.document))]
        return [F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in self.schema.fields if isinstance(f.dataType, (T.StringType, T.ArrayType, T.StructType))]


class ElementRoot(Root):
    """Paths within an array element."""

    def __init__(self, element: Value):
        self.element = element

    def value(self, path: str) -> Value:
        return self.element.child(parse(path))

    def texts(self) -> list[Column]:
        return [self.element.as_text()]


class Compiler:
    def __init__(self, strict: bool = True, eq_mode: str = "exact"):
        if eq_mode not in ("exact", "contains"):
            raise ValueError("eq_mode must be 'exact' or 'contains'")
        self.strict, self.eq_mode = strict, eq_mode

    def unknown(self, what: str) -> Column:
        if self.strict:
            raise ValueError(f"unknown operator {what}")
        return false()

    # documents

    def document(self, root: Root, query: dict[str, Any]) -> Column:
        if not isinstance(query, dict):
            raise TypeError("a filter must be a mapping")
        parts = [self.entry(root, k, v) for k, v in query.items()]
        return reduce(lambda a, b: a & b, parts) if parts else true()

    def entry(self, root: Root, key: str, arg: Any) -> Column:
        if not key.startswith("$"):
            return self.field(root, key, arg)
        if key in ("$and", "$or", "$nor"):
            if not isinstance(arg, (list, tuple)) or not arg:
                raise ValueError(f"{key} needs a list of filters")
            parts = [self.document(root, q) for q in arg]
            if key == "$and":
                return reduce(lambda a, b: a & b, parts)
            either = reduce(lambda a, b: a | b, parts)
            return either if key == "$or" else ~holds(either)
        if key == "$not":
            return ~holds(self.document(root, arg))
        if key == "$text":
            return self.search(root, arg)
        if key in ("$exists", "$elemMatch", "$all") and isinstance(arg, dict):
            return self.document(root, {path: {key: v} for path, v in arg.items()})
        return self.unknown(key)

    def search(self, root: Root, arg: Any) -> Column:
        wanted = arg.get("$search") if isinstance(arg, dict) else arg
        if not isinstance(wanted, str) or not wanted.strip():
            return false()
        parts = [holds(F.contains(F.lower(c), F.lit(wanted.lower()))) for c in root.texts()]
        return reduce(lambda a, b: a | b, parts) if parts else false()

    # fields

    def field(self, root: Root, path: str, arg: Any) -> Column:
        value = root.value(path)
        if path == "_id" and arg is not None and not isinstance(arg, (str, dict, re.Pattern)) and isinstance(value, Typed) and isinstance(value.dtype, T.StringType):
            raise TypeError("_id is a string")
        return self.condition(value, arg)

    def condition(self, value: Value, arg: Any) -> Column:
        if isinstance(arg, re.Pattern):
            return self.regex(value, arg.pattern, patterns.flags_of(arg))
        if isinstance(arg, dict) and arg and all(k.startswith("$") for k in arg):
            parts = [self.operator(value, op, x, arg) for op, x in arg.items() if op != "$options"]
            return reduce(lambda a, b: a & b, parts) if parts else self.unknown("$options")
        return self.equal(value, arg)

    def equal(self, value: Value, arg: Any) -> Column:
        if self.eq_mode == "contains" and kind_of(arg) in ("string", "number", "bool"):
            text = str(arg).lower() if not isinstance(arg, bool) else str(int(arg))
            return F.contains(F.lower(value.as_text()), F.lit(text))
        if arg is None:
            return value.null()
        return value.either(lambda v: v.equals(arg))

    def operator(self, value: Value, op: str, arg: Any, whole: dict[str, Any]) -> Column:
        if op == "$eq":
            return self.equal(value, arg)
        if op == "$ne":
            if arg is None:
                return ~value.null()
            return ~holds(self.equal(value, arg))
        if op in ("$gt", "$gte", "$lt", "$lte"):
            return value.either(lambda v: v.compare(op[1:], arg))
        if op in ("$in", "$nin"):
            if not isinstance(arg, (list, tuple)):
                raise TypeError(f"{op} needs a list")
            found = self.one_of(value, list(arg))
            return found if op == "$in" else ~holds(found)
        if op == "$exists":
            return ~value.missing() if arg else value.missing()
        if op == "$not":
            return ~holds(self.condition(value, arg))
        if op == "$all":
            return self.all_of(value, arg)
        if op == "$elemMatch":
            return self.element(value, arg)
        if op == "$regex":
            pattern, options = (arg.pattern, patterns.flags_of(arg)) if isinstance(arg, re.Pattern) else (arg, "")
            return self.regex(value, pattern, options + whole.get("$options", ""))
        if op == "$size":
            return value.size_is(int(arg))
        if op == "$type":
            names = [TYPE_NAMES.get(x) for x in (arg if isinstance(arg, (list, tuple)) else [arg])]
            return reduce(lambda a, b: a | b, [value.type_is(n) if n else false() for n in names]) if names else false()
        if op == "$mod":
            return self.modulo(value, arg)
        return self.unknown(op)

    def one_of(self, value: Value, items: list[Any]) -> Column:
        if not items:
            return false()
        plain = [x for x in items if kind_of(x) not in ("object", "array", "null")]
        parts = []
        if isinstance(value, Typed) and not value.maybe_array():
            literals = [x for x in (value.literal(i) for i in plain) if x is not None]
            if literals:
                parts.append(value.col.isin(literals))
        else:
            parts += [value.either(lambda v, x=x: v.equals(x)) for x in plain]
        if None in items:
            parts.append(value.null())
        for x in items:
            if isinstance(x, dict):
                parts += [value.equals(x), value.any_element(lambda e, x=x: self.subset(e, x))]
            elif isinstance(x, (list, tuple)):
                parts.append(value.either(lambda v, x=x: v.equals(x)))
        return reduce(lambda a, b: a | b, parts) if parts else false()

    def all_of(self, value: Value, items: Any) -> Column:
        if not isinstance(items, (list, tuple)):
            raise TypeError("$all needs a list")
        if not items:
            return false()
        need = [value.any_element(lambda e, x=x: self.subset(e, x) if isinstance(x, dict) else e.equals(x)) for x in items]
        return reduce(lambda a, b: a & b, [value.is_array(), *need])

    def subset(self, element: Value, wanted: dict[str, Any]) -> Column:
        """The element has all listed properties with these values."""
        parts = [element.child((k,)).equals(v) for k, v in wanted.items()]
        return reduce(lambda a, b: a & b, parts) if parts else element.type_is("object")

    def element(self, value: Value, query: dict[str, Any]) -> Column:
        if not isinstance(query, dict):
            raise TypeError("$elemMatch needs a mapping")
        scalar = bool(query) and all(k in FIELD_OPERATORS for k in query)
        one: Callable[[Value], Column] = (lambda e: self.condition(e, query)) if scalar else (lambda e: self.document(ElementRoot(e), query))
        return value.any_element(one)

    def regex(self, value: Value, pattern: str, options: str) -> Column:
        java = patterns.to_java(pattern, options)
        if not patterns.compiles(java):
            return false()
        return value.either(lambda v: false() if isinstance(v, Typed) and v.kind() in ("array", "object") else v.as_text().rlike(java))

    def modulo(self, value: Value, arg: Any) -> Column:
        if not isinstance(arg, (list, tuple)) or len(arg) != 2 or not arg[0]:
            return false()
        divisor, remainder = (int(x) for x in arg)
        return value.either(lambda v: F.try_mod(v.number().cast("long") if not isinstance(v, Doc) else F.when(F.abs(v.number()) < 9e18, v.number()).cast("long"), F.lit(divisor).cast("long")) == remainder)


def compile_filter(query: dict[str, Any] | None, root: Root, strict: bool = True, eq_mode: str = "exact") -> Column:
    """A filter as a Column over the root's frame. ``strict=False`` turns unknown operators into 'no match'."""
    return Compiler(strict, eq_mode).document(root, query or {})
