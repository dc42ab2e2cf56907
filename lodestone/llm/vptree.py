"""Approximate nearest neighbours through one vantage-point tree per shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` rows by a hash of their id; each shard's tree is built once. Queries
are dealt to blocks of ``BLOCK_ROWS``; every block meets every shard once, which is the stated query set against all
rows in blocks, and a tree travels once to ``BLOCKS_AT_ONCE`` blocks. A block walks a tree together: at a node the
distances of all its live queries to the vantage point are one matrix step, and each side of the node's radius is
entered only by queries whose best distance so far does not exclude it. The bound is relaxed by ``factor``: at 1 the
search is exact, above 1 it cuts more. Where no factor is given each tree takes the largest of ``FACTORS`` at which
``CALIBRATION`` of its own points, as queries, find ``RECALL`` of their exact neighbours. The shards' best k are merged
per query.

A node's vantage point is, of a few drawn, the one whose distances spread most; where no drawn point parts the rest
into two sides of some size (all distances alike), the node is a leaf. Trees are built and walked without recursion.

Equal vectors are one point of a tree that remembers its k+1 smallest ids: no more can be among k nearest, ties
going to smaller ids. Vectors that are null, zero, of another length than the most common, or hold null or
non-finite components take no part; rows with a null id neither. Rows that share an id are one query (the
smallest of their vectors) and are never each other's neighbours. With fewer than k candidates all are returned; an
empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import bound_batches, shuffle_width

SHARD_ROWS, BLOCK_ROWS, BLOCKS_AT_ONCE, LEAF = 8192, 256, 64, 256
#: Vantage points drawn at a node, points that their spread is told from, least share of a side.
DRAWN, SEEN, LEAST_SIDE = 8, 128, 1 / 32
#: How a tree chooses its factor; the README has the recall measured with it.
FACTORS, RECALL, CALIBRATION = (8.0, 7.0, 6.0, 5.0, 4.0, 2.0), 0.95, 64


@dataclass
class Tree:
    """Nodes in arrays; a leaf has left = -1 and points begin..end-1, an inner node a vantage point and a radius."""

    points: np.ndarray
    ids: list[np.ndarray]
    vantage: list[int]
    radius: list[float]
    left: list[int]
    right: list[int]
    begin: list[int]
    end: list[int]
    factor: float = 1.0


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, in double precision, by differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(1, b.size))
    for at in range(0, len(a), step):
        d = a[at : at + step, None, :] - b[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def build(ids: np.ndarray, vectors: np.ndarray, keep: int) -> Tree:
    """A tree over the distinct vectors; each keeps the ``keep`` smallest of its ids."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)]
    starts = np.flatnonzero(new)
    points = vectors[starts].astype(np.float64)
    owners = [np.unique(part)[:keep] for part in np.split(ids, starts[1:])]
    place = np.arange(len(points))
    tree = Tree(points, [], [], [], [], [], [], [])
    rng = np.random.default_rng(len(points))

    def add(begin: int, end: int) -> int:
        for values, value in ((tree.vantage, -1), (tree.radius, 0.0), (tree.left, -1), (tree.right, -1), (tree.begin, begin), (tree.end, end)):
            values.append(value)
        return len(tree.left) - 1

    todo = [add(0, len(points))]
    while todo:
        me = todo.pop()
        begin, end = tree.begin[me], tree.end[me]
        if end - begin <= LEAF:
            continue
        mine = place[begin:end]
        drawn, seen = rng.choice(mine, min(DRAWN, len(mine)), replace=False), rng.choice(mine, min(SEEN, len(mine)), replace=False)
        spread = distances(points[drawn], points[seen]).var(axis=1)
        for vantage in drawn[np.argsort(-spread)].tolist():
            d = distances(points[vantage : vantage + 1], points[mine])[0]
            rank = np.argsort(d, kind="stable")
            d = d[rank]
            sides = [int(np.searchsorted(d, d[len(d) // 2], side=side)) for side in ("left", "right")]
            middle = min(sides, key=lambda m: abs(2 * m - len(d)))
            if min(middle, len(d) - middle) >= LEAST_SIDE * len(d):
                break
        else:
            continue
        place[begin:end] = mine[rank]
        tree.vantage[me], tree.radius[me] = vantage, float((d[middle - 1] + d[middle]) / 2)
        tree.left[me], tree.right[me] = add(begin, begin + middle), add(begin + middle, end)
        todo += [tree.left[me], tree.right[me]]
    back = np.empty(len(place), np.int64)
    back[place] = np.arange(len(place))
    tree.points = points[place]
    tree.ids = [owners[i] for i in place]
    tree.vantage = [int(back[v]) if v >= 0 else -1 for v in tree.vantage]
    return tree


def search(tree: Tree, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances, points, points of the leaves entered) of each query's k nearest distinct points found (inf, -1 where there are fewer)."""
    best = np.full((len(queries), k), np.inf)
    who = np.full((len(queries), k), -1, np.int64)
    entered = np.zeros(len(queries), np.int64)
    first_id = np.array([i[0] for i in tree.ids], np.int64)
    norm_q, norm_p = (queries * queries).sum(axis=1), (tree.points * tree.points).sum(axis=1)

    def scan(node: int, live: np.ndarray) -> None:
        begin, end = tree.begin[node], tree.end[node]
        entered[live] += end - begin
        # squares by a matrix product, good to rounding, tell which points can be among the nearest; these get exact distances
        square = norm_p[begin:end] - 2 * queries[live] @ tree.points[begin:end].T
        slack = 1e-9 * (norm_q[live] + norm_p[begin:end].max())
        bound = best[live, -1] ** 2 - norm_q[live]
        if end - begin > k:
            bound = np.minimum(bound, np.partition(square, k - 1, axis=1)[:, k - 1] + slack)
        q, p = np.nonzero(square <= (bound + slack)[:, None])
        if not len(q):
            return
        some = np.unique(q)
        d = np.empty(len(q))
        step = max(1, (1 << 20) // queries.shape[1])
        for at in range(0, len(q), step):
            gap = queries[live[q[at : at + step]]] - tree.points[begin + p[at : at + step]]
            d[at : at + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        q = np.concatenate([q, np.repeat(some, k)])
        d = np.concatenate([d, best[live[some]].ravel()])
        p = np.concatenate([p + begin, who[live[some]].ravel()])
        order = np.lexsort((np.where(p >= 0, first_id[p], np.iinfo(np.int64).max), d, q))
        q, d, p = q[order], d[order], p[order]
        starts = np.searchsorted(q, some)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        kept = rank < k
        best[live[some]], who[live[some]] = d[kept].reshape(-1, k), p[kept].reshape(-1, k)

    todo: list[tuple[int, np.ndarray, np.ndarray | None]] = [(0, np.arange(len(queries)), None)] if len(tree.points) else []
    while todo:
        node, live, gap = todo.pop()
        if gap is not None:
            live = live[gap * factor <= best[live, -1] * (1 + 1e-12)]
        if not len(live):
            continue
        if tree.left[node] < 0:
            scan(node, live)
            continue
        v, radius = tree.vantage[node], tree.radius[node]
        d = distances(queries[live], tree.points[v : v + 1])[:, 0]
        inside, gap, left, right = d <= radius, np.abs(d - radius), tree.left[node], tree.right[node]
        # near sides come last onto the stack, so they are searched first
        todo += [(right, live[inside], gap[inside]), (left, live[~inside], gap[~inside]), (right, live[~inside], None), (left, live[inside], None)]
    return best, who, entered


def calibrated(tree: Tree, k: int) -> float:
    """The largest factor at which points of the tree find enough of their k nearest."""
    queries = tree.points[np.random.default_rng(3).choice(len(tree.points), min(CALIBRATION, len(tree.points)), replace=False)]
    truth = np.sort(distances(queries, tree.points), axis=1)[:, :k]
    truth = np.pad(truth, ((0, 0), (0, k - truth.shape[1])), constant_values=np.inf)
    known = np.isfinite(truth)
    for factor in FACTORS:
        found = search(tree, queries, k, factor)[0]
        # a place is right when its distance is not above the last exact one
        if (found <= np.where(known, truth, 0).max(axis=1)[:, None])[known].mean() >= RECALL:
            return factor
    return 1.0


def usable(vector: Column) -> Column:
    """Whether a vector takes part, its length aside."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, queries: Column, k: int = 10, factor: float | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of each row that meets ``queries``; rows are (vec_id, embedding)."""
    spark = rows.sparkSession
    bound_batches(spark)
    valid = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = F.size("embedding").alias("size")
    sizes = valid.groupBy(size).agg(F.count("*").alias("n"), F.count_if(queries).alias("q")).orderBy(F.desc("n"), "size").limit(1).collect()
    width, n, q = (sizes[0]["size"], sizes[0]["n"], sizes[0]["q"]) if sizes else (1, 0, 0)
    valid = valid.where(F.size("embedding") == width)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // BLOCK_ROWS))

    def matrix(column: pd.Series) -> np.ndarray:
        return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, width))

    def plant(part: pd.DataFrame) -> pd.DataFrame:
        tree = build(part["vec_id"].to_numpy(np.int64), matrix(part["embedding"]), k + 1)
        tree.factor = calibrated(tree, k + 1) if factor is None else factor
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "tree": [pickle.dumps(tree, 5)]})

    def block(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(part["block"].iloc[0])], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [matrix(part["embedding"]).tobytes()]})

    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    trees = valid.withColumn("shard", home).groupBy("shard").applyInPandas(plant, "shard int, tree binary")
    asked = valid.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(block, "block int, ids binary, vectors binary")
    # a tree goes ahead of its blocks, once to each run of them
    runs = F.col("block") / F.lit(BLOCKS_AT_ONCE)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks_met = asked.select(every(shards).alias("shard"), F.floor(runs).cast("int").alias("run"), F.lit(1).alias("kind"), "ids", "vectors", F.lit(None).cast("binary").alias("tree"))
    trees_met = trees.select("shard", every(-(-blocks // BLOCKS_AT_ONCE)).alias("run"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("vectors"), "tree")
    met = blocks_met.unionByName(trees_met).repartition(shuffle_width(spark), "shard", "run").sortWithinPartitions("shard", "run", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree | None = None
        for batch in batches:
            for raw_ids, raw, data in zip(*(batch.column(c) for c in ("ids", "vectors", "tree"))):
                if data.is_valid:
                    tree = pickle.loads(data.as_py())
                    continue
                ids = np.frombuffer(raw_ids.as_py(), np.int64)
                vectors = np.frombuffer(raw.as_py(), np.float64).reshape(len(ids), width)
                found, who, _ = search(tree, vectors, k + 1, tree.factor)
                out_q, out_v, out_s = [], [], []
                for i, query in enumerate(ids.tolist()):
                    pairs = [(d, v) for d, p in zip(found[i].tolist(), who[i].tolist()) if p >= 0 for v in tree.ids[p].tolist() if v != query]
                    for d, v in sorted(pairs)[:k]:
                        out_q.append(query)
                        out_v.append(v)
                        out_s.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    near = met.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def nearest_query(rows: DataFrame) -> DataFrame:
    return nearest(rows, F.col("vec_id") % 100 == 0)
