"""Aggregation pipelines: a fold of DataFrame -> DataFrame stages.

Rows have no arrival order in Spark. Where a stage needs one (``$first``, ``$last``, ``$push``) it is the last
``$sort``, then the given ``order_by``; with neither it is the scan order of the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.paths import parse
from lodestone.functions.values import Doc, Value, as_variant, literal_of, type_of, with_field
from lodestone.operators.filters import Root, compile_filter
from lodestone.operators.ordering import SortSpec, as_constant, directed, encoded, pairs, sorted_rows
from lodestone.operators.projection import project

ARRIVAL = "__arrival"
ORDERED = ("$first", "$last", "$push")


@dataclass
class State:
    """The frame so far and the order that its rows are in."""

    df: DataFrame
    document: str | None = None
    order: list[tuple[str, int]] = field(default_factory=list)
    strict: bool = True
    expressions: bool = False

    def root(self) -> Root:
        return Root.of(self.df, self.document)


def value_of(state: State, expression: Any) -> Value | None:
    """The field that ``"$path"`` names; None for a constant."""
    return None if as_constant(expression) else state.root().value(expression[1:])


def column_of(state: State, expression: Any) -> Column:
    if isinstance(expression, Column):
        return expression
    value = value_of(state, expression)
    if value is None:
        return literal_of(expression, type_of(expression))
    return value.col


def group_key(state: State, expression: Any) -> Column:
    """A key that can be grouped: variants group by their canonical JSON text."""
    value = value_of(state, expression)
    if isinstance(value, Doc):
        return value.as_text()
    return column_of(state, expression)


def match(state: State, arg: Any) -> State:
    return replace(state, df=state.df.filter(compile_filter(arg, state.root(), state.strict)))


def project_stage(state: State, arg: Any) -> State:
    out = project(state.df, arg, state.root())
    return replace(state, df=out, document=state.document if state.document in out.columns else None)


def add_fields(state: State, arg: dict[str, Any]) -> State:
    """Constants (dotted keys are plain names). With ``expressions`` on, ``"$path"`` is evaluated too."""
    columns = {}
    document = F.col(f"`{state.document}`") if state.document else None
    for name, value in arg.items():
        computed = isinstance(value, Column) or (state.expressions and not as_constant(value))
        if document is not None and name != "_id":
            added = column_of(state, value) if computed else as_variant(value)
            document = with_field(document, [name], added if not computed or isinstance(value_of(state, value) if isinstance(value, str) else None, Doc) else added.cast("variant"))
        else:
            columns[name] = column_of(state, value) if computed else literal_of(value, type_of(value))
    if document is not None:
        columns[state.document] = document
    return replace(state, df=state.df.withColumns(columns))


def sort(state: State, arg: SortSpec) -> State:
    order = pairs(arg)
    return replace(state, df=sorted_rows(state.df, order, state.root(), "last"), order=order)


def count(state: State, arg: Any) -> State:
    if not isinstance(arg, str) or not arg or arg.startswith("$"):
        raise ValueError("$count needs a field name")
    return replace(state, df=state.df.agg(F.count(F.lit(1)).alias(arg)), document=None, order=[])


def limit(state: State, arg: int) -> State:
    if arg < 0:
        raise ValueError("$limit must not be negative")
    return replace(state, df=state.df.limit(arg))


def skip(state: State, arg: int) -> State:
    if arg < 0:
        raise ValueError("$skip must not be negative")
    return replace(state, df=state.df.offset(arg))


def unwind(state: State, arg: Any) -> State:
    """One row per array element; scalars stay; null, missing and empty arrays go."""
    path = arg["path"] if isinstance(arg, dict) else arg
    if not isinstance(path, str) or not path.startswith("$"):
        raise ValueError("$unwind needs a path like '$items'")
    path = path[1:]
    df, root = state.df, state.root()
    value = root.value(path)
    names = path.split(".")
    if isinstance(value, Doc):
        items = F.when(value.is_array(), value.elements()).when(~value.null(), F.array(value.col))
    elif value.maybe_array():
        items = value.col
    else:
        return replace(state, df=df.filter(~value.null()))
    marked = df.select("*", F.posexplode(items).alias("__at", "__item"))
    if state.document is not None and path != "_id":
        out = marked.withColumn(state.document, with_field(F.col(f"`{state.document}`"), [str(s) for s in parse(path)], F.col("__item")))
    elif isinstance(value, Doc) and len(names) > 1:
        out = marked.withColumn(names[0], with_field(F.col(f"`{names[0]}`"), names[1:], F.col("__item")))
    elif len(names) == 1:
        out = marked.withColumn(names[0], F.col("__item"))
    else:
        out = marked.withColumn(names[0], F.col(names[0]).withField(".".join(names[1:]), F.col("__item")))
    drop = ["__item", "__at"]
    if ARRIVAL in df.columns:  # elements arrive in array order
        out = out.withColumn(ARRIVAL, F.struct(F.col(ARRIVAL).alias("a"), F.col("__at").alias("b")))
    return replace(state, df=out.drop(*drop))


# $group


def number(state: State, expression: Any) -> Column:
    """The numbers among the values; others count as null."""
    value = value_of(state, expression)
    if value is not None:
        return value.number()
    return F.lit(expression if isinstance(expression, (int, float)) and not isinstance(expression, bool) else None)


def extreme(state: State, arg: Any, least: bool) -> Column:
    value = value_of(state, arg)
    if isinstance(value, Doc):
        keys = F.struct(*value.sort_keys())
        known = F.when(~value.null(), keys)
        return (F.min_by if least else F.max_by)(F.to_json(value.col), known)
    return (F.min if least else F.max)(column_of(state, arg))


def accumulate(state: State, op: str, arg: Any, order: Column | None) -> Column:
    if op == "$sum":
        if as_constant(arg):
            return F.count(F.lit(1)) * F.lit(arg if isinstance(arg, (int, float)) and not isinstance(arg, bool) else 0)
        total = F.sum(number(state, arg))
        return F.coalesce(total, F.lit(0))
    if op == "$avg":
        return F.avg(number(state, arg))
    if op in ("$min", "$max"):
        return extreme(state, arg, op == "$min")
    if op == "$count":
        return F.count(F.lit(1))
    item = column_of(state, arg)
    if op == "$push" and isinstance(value_of(state, arg), Doc):  # variants have no order: their text is sorted along
        pairs = F.collect_list(F.struct(order.alias("o"), F.to_json(item).alias("v")))
        return F.transform(F.array_sort(pairs), lambda p: F.parse_json(p["v"]))
    if op == "$push":
        pairs = F.collect_list(F.struct(order.alias("o"), item.alias("v")))
        return F.transform(F.array_sort(pairs), lambda p: p["v"])
    # the payload is wrapped so that a null value of the first row is kept
    return (F.min_by if op == "$first" else F.max_by)(F.struct(item.alias("v")), order)["v"]


def narrowed(state: State, keys: dict[str, Column], accumulators: list[tuple[str, str, Any]], tie: list[Column]) -> tuple[DataFrame, list[tuple[str, str, Any]]]:
    """Rows with their number in their group (``__line``), reduced to the keys and to what the accumulators take: whole documents are not shuffled and sorted."""
    inputs: dict[str, Column] = {}
    taken = []
    for name, op, arg in accumulators:
        column = f"__v{len(inputs)}"
        if isinstance(arg, Column) or not as_constant(arg):
            inputs[column] = column_of(state, arg)
            arg = F.col(column) if isinstance(arg, Column) else f"${column}"
        taken.append((name, op, arg))
    root = state.root()
    order = [(c, direction) for key, direction in pairs(state.order) for c in root.value(key).sort_keys()]
    sorted_by = {f"__s{i}": c for i, (c, _) in enumerate(order)}
    df = state.df.select(*(c.alias(name) for name, c in {**keys, **sorted_by, **inputs}.items()), *tie)
    line = Window.partitionBy(*keys).orderBy(*(directed(F.col(name), direction, "last") for name, (_, direction) in zip(sorted_by, order)), *tie)
    return df.withColumn("__line", F.row_number().over(line)).drop(*sorted_by), taken


def group(state: State, arg: dict[str, Any]) -> State:
    if "_id" not in arg:
        raise ValueError("$group needs an _id")
    key = arg["_id"]
    compound = isinstance(key, dict)
    keys = {f"__k{i}": group_key(state, v) for i, v in enumerate(key.values())} if compound else {"__k0": group_key(state, key)}
    accumulators: list[tuple[str, str, Any]] = []
    for name, spec in arg.items():
        if name == "_id":
            continue
        if not isinstance(spec, dict) or len(spec) != 1:
            raise ValueError(f"accumulator {name!r} must have one operator")
        op, value = next(iter(spec.items()))
        if op not in ("$sum", "$avg", "$min", "$max", "$push", "$first", "$last", "$count"):
            raise NotImplementedError(f"accumulator {op}")
        accumulators.append((name, op, value))
    df = state.df
    order: Column | None = None
    if any(op in ORDERED for _, op, _ in accumulators):
        tie = [F.col(ARRIVAL)] if ARRIVAL in df.columns else []
        fields = encoded(df, state.order) if state.document is None else None
        if fields is not None:
            order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate([*fields, *tie]))) if fields or tie else None
        if order is None:
            df, accumulators = narrowed(state, keys, accumulators, tie)
            state, keys, order = replace(state, document=None), {k: F.col(k) for k in keys}, F.col("__line")
    inner = replace(state, df=df)
    grouped = df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(*[accumulate(inner, op, v, order).alias(name) for name, op, v in accumulators] or [F.count(F.lit(1)).alias("__n")])
    if compound:
        identity = F.struct(*(F.col(k).alias(name) for k, name in zip(keys, key)))
    else:
        identity = F.col("__k0")
    out = grouped.select(identity.alias("_id"), *(F.col(f"`{name}`") for name, _, _ in accumulators))
    return replace(state, df=out, document=None, order=[])


STAGES: dict[str, Callable[[State, Any], State]] = {
    "$match": match,
    "$project": project_stage,
    "$addFields": add_fields,
    "$sort": sort,
    "$limit": limit,
    "$skip": skip,
    "$count": count,
    "$group": group,
    "$unwind": unwind,
}


def merged(pipeline: list[dict[str, Any]]) -> list[tuple[str, Any]]:
    """The stages, checked; neighbouring matches become one."""
    out: list[tuple[str, Any]] = []
    for stage in pipeline:
        if not isinstance(stage, dict) or len(stage) != 1:
            raise ValueError(f"a stage must have one key: {stage!r}")
        name, arg = next(iter(stage.items()))
        if name not in STAGES:
            raise NotImplementedError(f"stage {name}")
        if name == "$match" and out and out[-1][0] == "$match":
            out[-1] = ("$match", {"$and": [out[-1][1], arg]})
        else:
            out.append((name, arg))
    return out


def needs_arrival(stages: list[tuple[str, Any]]) -> bool:
    return any(name == "$group" and any(op in ORDERED for k, spec in arg.items() if k != "_id" and isinstance(spec, dict) for op in spec) for name, arg in stages)


def order_unused(later: list[tuple[str, Any]]) -> bool:
    """Whether rows need not lie in order: stages of single rows come next, then one that orders its groups itself or counts."""
    return next((name for name, _ in later if name in ("$limit", "$skip", "$group", "$count")), None) in ("$group", "$count")


def aggregate(df: DataFrame, pipeline: list[dict[str, Any]], order_by: str | None = None, document: str | None = None, strict: bool = True, expressions: bool = False) -> DataFrame:
    """Run a pipeline over a frame. ``order_by`` names the column that stands for arrival order.

    ``document`` names a VARIANT column whose fields are the rows' fields; stages that change documents rewrite it.
    """
    stages = merged(pipeline)
    if needs_arrival(stages):
        df = df.withColumn(ARRIVAL, F.col(order_by) if order_by else F.monotonically_increasing_id())
    state = State(df, document, [], strict, expressions)
    for i, (name, arg) in enumerate(stages):
        if name == "$sort" and order_unused(stages[i + 1 :]):
            state = replace(state, order=pairs(arg))
        else:
            state = STAGES[name](state, arg)
    return state.df.drop(ARRIVAL) if ARRIVAL in state.df.columns else state.df
