"""Projections: inclusion, exclusion, nesting, renames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.paths import parse
from lodestone.functions.values import without_field
from lodestone.operators.filters import Root


def mode_of(spec: dict[str, Any]) -> str:
    """include or exclude, as the first deciding entry besides ``_id`` says; only ``_id: 0`` excludes."""
    flags = [bool(v) for k, v in spec.items() if k != "_id" and isinstance(v, (bool, int, float))]
    if any(flags) or any(not isinstance(v, (bool, int, float)) for v in spec.values()):
        return "include"
    if flags:
        return "exclude"
    return "exclude" if "_id" in spec and not spec["_id"] else "include"


def exclude(df: DataFrame, paths: list[str]) -> DataFrame:
    for path in paths:
        first, *rest = (str(s) for s in parse(path))
        if first not in df.columns:
            continue
        if not rest:
            df = df.drop(first)
            continue
        kind: T.DataType = df.schema[first].dataType
        for name in rest:
            if not (isinstance(kind, T.StructType) and name in kind.names):
                break
            kind = kind[name].dataType
        else:
            df = df.withColumn(first, F.col(f"`{first}`").dropFields(".".join(f"`{n}`" for n in rest)))
    return df


def exclude_from_document(df: DataFrame, document: str, paths: list[str]) -> DataFrame:
    """Exclusion within a VARIANT column; ``_id`` is a column of its own."""
    doc = F.col(f"`{document}`")
    for path in paths:
        if path != "_id":
            doc = without_field(doc, [str(s) for s in parse(path)])
    df = df.withColumn(document, doc)
    return df.drop("_id") if "_id" in paths else df


def nested(df: DataFrame, tree: dict[str, Any], prefix: tuple[str, ...], root: Root) -> Column:
    """The part of a nested field that the tree of names keeps; null where its parent is null."""
    parts = []
    for name, below in tree.items():
        path = (*prefix, name)
        value = root.value(".".join(path))
        parts.append((value.col if below is True else nested(df, below, path, root)).alias(name))
    return F.when(root.value(".".join(prefix)).col.isNotNull(), F.struct(*parts))


def project(df: DataFrame, spec: dict[str, Any] | None, root: Root | None = None) -> DataFrame:
    """Apply a projection. Values: 1/True, 0/False, ``"$path"`` (rename) or a Column (computed)."""
    if not spec:
        return df
    root = root or Root.of(df)
    if mode_of(spec) == "exclude":
        gone = [k for k, v in spec.items() if not v]
        return exclude(df, gone) if root.document is None else exclude_from_document(df, root.document, gone)
    keep_id = "_id" in df.columns and bool(spec.get("_id", True)) and not isinstance(spec.get("_id"), (str, Column))
    tree: dict[str, Any] = {}
    columns: dict[str, Column] = {}
    for key, value in spec.items():
        if isinstance(value, Column):
            columns[key] = value
        elif isinstance(value, str):
            if not value.startswith("$"):
                raise ValueError(f"a projected string must be a field path like '$a.b', not {value!r}")
            columns[key] = root.value(value[1:]).col
        elif value and key != "_id":
            names = [str(s) for s in parse(key)]
            at = tree
            for name in names[:-1]:
                at = at.setdefault(name, {})
                if at is True:
                    break
            else:
                at[names[-1]] = True
    known = set(df.columns) if root.document is None else None
    out = []
    for name, below in tree.items():
        if known is not None and name not in known:
            continue
        out.append((root.value(name).col if below is True else nested(df, below, (name,), root)).alias(name))
    out += [c.alias(k) for k, c in columns.items()]
    if keep_id:
        out.append(F.col("_id"))
    return df.select(*out) if out else df.select(F.struct().alias("_empty")).drop("_empty")
