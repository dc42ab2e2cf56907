"""Sort specifications and arrival order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.values import Doc
from lodestone.operators.filters import Root
from lodestone.sources.folders import scratch

SortSpec = dict[str, int] | list[tuple[str, int]]


def pairs(spec: SortSpec) -> list[tuple[str, int]]:
    items = list(spec.items()) if isinstance(spec, dict) else list(spec)
    for key, direction in items:
        if direction not in (1, -1):
            raise ValueError(f"sort direction of {key!r} must be 1 or -1")
    return items


def directed(c: Column, direction: int, nulls: str) -> Column:
    """``nulls='first'``: missing values are smallest (cursors); ``'last'``: largest (pipelines)."""
    if nulls == "first":
        return c.asc_nulls_first() if direction > 0 else c.desc_nulls_last()
    return c.asc_nulls_last() if direction > 0 else c.desc_nulls_first()


def sort_columns(spec: SortSpec, root: Root, nulls: str) -> list[Column]:
    """Order expressions of a sort specification."""
    return [directed(c, direction, nulls) for key, direction in pairs(spec) for c in root.value(key).sort_keys()]


def sorted_rows(df: DataFrame, spec: SortSpec, root: Root, nulls: str) -> DataFrame:
    """The rows in an order. A sort computes its expressions in every comparison, so keys that are no plain fields are computed before it, once a row."""
    made: dict[str, Column] = {}
    order = []
    for key, direction in pairs(spec):
        value = root.value(key)
        for c in value.sort_keys():
            if isinstance(value, Doc) or isinstance(value.dtype, (T.StructType, T.MapType)):
                name = f"__s{len(made)}"
                made[name], c = c, F.col(name)
            order.append(directed(c, direction, nulls))
    return df.withColumns(made).orderBy(*order).drop(*made) if made else df.orderBy(*order)


def encodable(dtype: T.DataType, direction: int) -> bool:
    """Whether one ascending struct field can stand for this sort key."""
    return direction > 0 or isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def encoded(df: DataFrame, spec: SortSpec) -> list[Column] | None:
    """Ascending struct fields that order rows as a pipeline's ``$sort`` would, or None."""
    root, out = Root.of(df), []
    for key, direction in pairs(spec):
        value = root.value(key)
        dtype = getattr(value, "dtype", None)
        if dtype is None or not encodable(dtype, direction):
            return None
        c: Column = value.col
        if direction < 0:
            if isinstance(dtype, T.BooleanType):
                c = -c.cast("int")
            elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                c = -F.unix_micros(c.cast("timestamp"))
            else:
                c = -c.cast("double" if isinstance(dtype, (T.FloatType, T.DoubleType)) else "decimal(38,0)")
        out += [value.col.isNull() if direction > 0 else value.col.isNotNull(), c]
    return out


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Every row with its 1-based position in an order; only one count per range partition reaches the driver."""
    spark = df.sparkSession
    path = scratch(spark, "ordered")
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged.withColumn("__mid", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    part = F.shiftright("__mid", 33)
    offsets, total = [], 0
    for r in sorted(stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((r["part"], total))
        total += r["n"]
    placed = stored.withColumn("__part", part).join(F.broadcast(spark.createDataFrame(offsets, "__part long, __before long")), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__mid", "__part", "__before")


def as_constant(value: Any) -> bool:
    return not (isinstance(value, str) and value.startswith("$"))
