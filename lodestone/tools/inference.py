"""Schema inference: the fields of a collection, their types and how often they are present.

Rows are flattened to (path, type, value, what an array holds) by nested expressions to a given depth - typed columns by
their schema, documents by their VARIANT - and counted once per distinct combination. Types and values are both read
from those counts; no row is collected and no value is shortened before values are told apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
#: How deep, how many distinct values are offered, how few count as few, how many examples are shown (fixed values).
MAX_DEPTH, MAX_DISTINCT, LOW_CARDINALITY, EXAMPLES = 3, 25, 12, 5
ENTRY = "struct<path:string,kind:string,value:string,elements:array<string>,fields:array<string>>"
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def kind_of_variant(v: Column) -> Column:
    tag = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull() | (tag == "VOID"), "null")
        .when(tag == "STRING", F.when(text.rlike(ISO_DATE), "date").otherwise("string"))
        .when(tag == "BOOLEAN", "boolean")
        .when(tag.startswith("ARRAY"), "array")
        .when(tag.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def entry(path: Column, kind: Column, value: Column, elements: Column | None = None, fields: Column | None = None) -> Column:
    none = F.lit(None).cast("array<string>")
    return F.struct(path.alias("path"), kind.alias("kind"), value.alias("value"), (none if elements is None else elements).alias("elements"), (none if fields is None else fields).alias("fields")).cast(ENTRY)


def entries(v: Column, prefix: Column, depth: int, most: int) -> Column:
    """The fields of an object and, to the depth, those below them."""
    fields = F.map_entries(F.when(F.schema_of_variant(v).startswith("OBJECT"), v.cast("map<string,variant>")))

    def own(e: Column) -> Column:
        kind = kind_of_variant(e["value"])
        items = F.when(kind == "array", F.try_variant_get(e["value"], "$", "array<variant>"))
        inner = F.array_sort(F.array_distinct(F.transform(items, kind_of_variant)))
        keys = F.array_sort(F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")), F.array().cast("array<string>"))))))
        shown = F.when(kind.isin("string", "date"), F.try_variant_get(e["value"], "$", "string")).when(kind.isin("number", "boolean"), F.to_json(e["value"]))
        return entry(F.concat(prefix, e["key"]), kind, shown, inner, keys)

    empty = F.array().cast(f"array<{ENTRY}>")
    mine = F.coalesce(F.transform(fields, own), empty)
    if depth >= most:
        return mine
    below = F.flatten(F.coalesce(F.transform(fields, lambda e: entries(e["value"], F.concat(prefix, e["key"], F.lit(".")), depth + 1, most)), F.array().cast(f"array<array<{ENTRY}>>")))
    return F.concat(mine, below)


def typed_kind(dtype: T.DataType, col: Column) -> Column:
    if isinstance(dtype, T.VariantType):
        return kind_of_variant(col)
    if isinstance(dtype, T.StringType):
        return F.when(col.rlike(ISO_DATE), "date").otherwise("string")
    for kind, types in (("number", NUMBERS), ("boolean", (T.BooleanType,)), ("date", (T.DateType, T.TimestampType, T.TimestampNTZType)), ("array", (T.ArrayType,)), ("object", (T.StructType, T.MapType))):
        if isinstance(dtype, types):
            return F.lit(kind)
    return F.lit("string")


def element_kind(dtype: T.DataType) -> Callable[[Column], Column]:
    return lambda x: F.when(x.isNull(), "null").otherwise(typed_kind(dtype, x))


def typed_entries(schema: T.StructType, of: Column | None, prefix: str, depth: int, most: int) -> list[Column]:
    """One array per column or nested field with its entry, empty where it is null."""
    out = []
    empty = F.array().cast(f"array<{ENTRY}>")
    for f in schema.fields:
        col, dtype, path = F.col(f"`{f.name}`") if of is None else of.getField(f.name), f.dataType, prefix + f.name
        if isinstance(dtype, T.VariantType):
            value = F.when(kind_of_variant(col).isin("string", "date"), F.try_variant_get(col, "$", "string")).when(kind_of_variant(col).isin("number", "boolean"), F.to_json(col))
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX" if isinstance(dtype, T.TimestampType) else "yyyy-MM-dd'T'HH:mm:ss.SSS")
        elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)):
            value = F.lit(None).cast("string")
        else:
            value = col.cast("string")
        elements = fields = None
        if isinstance(dtype, T.ArrayType):
            inner = dtype.elementType
            elements = F.array_sort(F.array_distinct(F.transform(col, element_kind(inner))))
            fields = F.when(F.size(col) > 0, F.array(*map(F.lit, sorted(inner.names)))) if isinstance(inner, T.StructType) else None
        out.append(F.when(col.isNotNull(), F.array(entry(F.lit(path), typed_kind(dtype, col), value, elements, fields))).otherwise(empty))
        if isinstance(dtype, T.StructType) and depth < most:
            out += typed_entries(dtype, col, path + ".", depth + 1, most)
        if isinstance(dtype, T.VariantType) and depth < most:
            out.append(F.coalesce(entries(col, F.lit(path + "."), depth + 1, most), empty))
    return out


def infer_schema(df: DataFrame, document: str | None = None, sample: int | None = 200, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(path, depth, types, primary_type, count, presence, examples, element_types, element_fields, distinct_values, low_cardinality).

    ``types`` is ordered by frequency; the primary type is the most frequent that is not null. ``sample=None`` reads
    all rows. ``distinct_values`` is null where there are more than 25. A typed null counts as a missing field.
    """
    rows = df if sample is None else df.limit(sample)
    if document:
        rows = rows.where(F.col(document).isNotNull())
        found = entries(F.col(document), F.lit(""), 0, max_depth)
    else:
        found = F.concat(F.array().cast(f"array<{ENTRY}>"), *typed_entries(df.schema, None, "", 0, max_depth))
    total = rows.count()
    counted = rows.select(F.explode(found).alias("e")).select("e.*").groupBy("path", "kind", "value", "elements", "fields").agg(F.count("*").alias("n"))
    kinds = counted.groupBy("path", "kind").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("elements"))).alias("elements"), F.array_distinct(F.flatten(F.collect_set("fields"))).alias("fields"))
    by_path = kinds.groupBy("path").agg(
        F.sum("n").alias("count"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind"))), lambda x: x["kind"]).alias("types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("elements")))).alias("element_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("element_fields"),
    )
    scalar = counted.where("value is not null").groupBy("path", "value").agg(F.sum("n").alias("n"))
    ranked = scalar.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "value"))).where(F.col("r") <= MAX_DISTINCT + 1)
    values = ranked.groupBy("path").agg(F.count("*").alias("kinds"), F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("all"))
    out = by_path.join(values, "path", "left")
    depth = F.size(F.split("path", r"\.")) - 1
    known = F.filter("types", lambda t: t != "null")
    return out.select(
        "path",
        depth.alias("depth"),
        "types",
        F.coalesce(F.get(known, F.lit(0)), F.lit("null")).alias("primary_type"),
        "count",
        (F.col("count") / F.lit(max(total, 1))).alias("presence"),
        F.slice(F.coalesce("all", F.array().cast("array<string>")), 1, EXAMPLES).alias("examples"),
        "element_types",
        "element_fields",
        F.when(F.col("kinds") <= MAX_DISTINCT, F.col("all")).alias("distinct_values"),
        (F.coalesce("kinds", F.lit(0)).between(1, LOW_CARDINALITY)).alias("low_cardinality"),
    ).orderBy(F.desc(F.col("path") == "_id"), "depth", F.desc("count"), "path")


@dataclass
class Field:
    """One inferred field on the driver."""

    path: str
    depth: int
    types: list[str]
    primary_type: str
    count: int
    presence: float
    examples: list[str]
    element_types: list[str]
    distinct_values: list[str] | None
    low_cardinality: bool
    element_fields: list[str] = field(default_factory=list)


def fields_of(schema: DataFrame) -> list[Field]:
    return [Field(**r.asDict()) for r in schema.collect()]


def default_columns(fields: list[Field], most: int = 6) -> list[str]:
    """Columns worth showing: ``_id``, then shallow scalars that at least half of the rows have."""
    good = [f.path for f in fields if f.path == "_id" or (f.depth == 0 and f.primary_type not in ("object", "array", "null") and f.presence >= 0.5)]
    return sorted(good, key=lambda p: p != "_id")[:most]


def describe_field(f: Field) -> str:
    parts = [" | ".join(f.types)]
    if f.element_types:
        parts.append(f"of {', '.join(f.element_types)}")
    if f.element_fields:
        parts.append(f"with {', '.join(f.element_fields)}")
    if f.presence < 1:
        parts.append(f"in {round(100 * f.presence)}% of documents")
    if f.low_cardinality and f.distinct_values:
        parts.append("one of " + ", ".join(f.distinct_values))
    elif f.examples:
        parts.append("such as " + ", ".join(f.examples[:3]))
    return "; ".join(parts)


