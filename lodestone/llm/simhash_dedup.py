"""SimHash near-duplicate groups through BK-trees.

A document's fingerprint takes bit i where more than half of its word shingles' hashes have it. Documents link
where fingerprints differ in at most ``radius`` bits; a group is what links connect.

Each distinct fingerprint is one tree entry. Masks of fingerprint bits name shards (the masked bits); a shard holds
a BK-tree: children keyed by the integer Hamming distance to their parent, a search follows only edges within the
radius of its own distance. The 64 bits are cut into radius+m blocks, two fingerprints within the radius agree on m
whole blocks at least, so all sets of m blocks together miss no pair. m grows with the number of fingerprints, so
shards stay small; every m is exact.

Groups by shingle similarity (``similar_groups``) are a matter of ``similar_sets``: longer fingerprints, BK-trees in
shards by shared shingles, and each link verified, for no radius of fingerprints holds all pairs of a similarity and no
others.

The trees travel by shuffle, not by broadcast, because all of them together
grow with the corpus. A shard above ``SHARD_LIMIT`` entries is cut into parts and each pair of parts is a tree of
its own, so no task holds an unbounded group. A tree search takes what it finds out of the tree: links form a
spanning forest, never all pairs of a group.

Null or empty text has fingerprint zero, which links like any other; repeated doc_ids are kept as rows and share
a group; rows without a doc_id link like any other, but never name a group: a group of such rows only has a null
component_id. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bk_tree import forest
from lodestone.llm.common import bound_batches, cut, map_batches, shuffle_width, spread, tidy
from lodestone.llm.components import components
from lodestone.llm.similar_sets import similar_sets

SHARD_LIMIT = 2048
#: Shards are sized for about this many fingerprints each, if these are spread evenly.
SHARD_AIM = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles (A-Z lower-cased, repeats included)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((digest(g, 42) for g in grams), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long: the fingerprint as a signed number) for every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(spread(source), one, "doc_id long, fp long")


def block_masks(radius: int, count: int) -> list[int]:
    """Masks such that any two fingerprints within the radius agree on one of them."""
    m = 1
    while m < 4 and count > SHARD_AIM << (64 * m // (radius + m)):
        m += 1
    blocks = radius + m
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, m)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def search_shards(members: DataFrame, radius: int) -> DataFrame:
    """``members`` (shard keys.., fp), sorted by shard within partitions -> links (a > b)."""
    keys = ["mask_no", "bits", "part_a", "part_b"]
    bound_batches(members.sparkSession)

    def links(fps: np.ndarray) -> list[tuple[int, int]]:
        values = fps.tolist()
        found = forest(fps.view(np.uint64).tolist(), radius)
        return [(max(values[i], values[j]), min(values[i], values[j])) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the shard that is not complete yet

        def emit(table: np.ndarray) -> pa.RecordBatch | None:
            if not len(table):
                return None
            starts = np.flatnonzero(np.r_[True, (table[1:, :4] != table[:-1, :4]).any(axis=1)])
            ends = np.r_[starts[1:], len(table)]
            out: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                out += links(np.ascontiguousarray(table[s:e, 4]))
            a = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for batch in batches:
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, "fp"]], axis=1)
            if not len(table):
                continue
            held.append(table)
            if (table[-1, :4] == held[0][0, :4]).all():
                continue
            whole = np.concatenate(held)
            last = int(np.flatnonzero((whole[:, :4] != whole[-1, :4]).any(axis=1))[-1]) + 1
            if (out := emit(whole[:last])) is not None:
                yield out
            held = [whole[last:]]
        if held and (out := emit(np.concatenate(held))) is not None:
            yield out
        tidy()

    return members.mapInArrow(run, "a long, b long")


def link_fingerprints(classes: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """``classes`` (fp), distinct -> links (a, b) of fingerprints that span the groups."""
    shards = F.explode(F.array(*(F.struct(F.lit(i).alias("mask_no"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for i, m in enumerate(masks))))
    members = classes.select("fp", shards.alias("s")).select("fp", "s.mask_no", "s.bits")
    large = cut(members.groupBy("mask_no", "bits").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_LIMIT).select("mask_no", "bits", F.ceil(F.col("n") / SHARD_LIMIT).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    sized = members.join(large, ["mask_no", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = sized.withColumn("other", other).select("mask_no", "bits", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "fp")
    keys = ["mask_no", "bits", "part_a", "part_b"]
    # in the order of fingerprints a group's root is its smallest one in the shard, so shards of different masks tell the same links
    return search_shards(cells.repartition(shuffle_width(classes.sparkSession), *keys).sortWithinPartitions(*keys, "fp"), radius)


def near_duplicate_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row: 64-bit fingerprints linked within the radius, no pair missed."""
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(link_fingerprints(classes, block_masks(radius, classes.count()), radius)).withColumnRenamed("node", "fp")
    labelled = cut(classes.join(labels, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    names = cut(labelled.groupBy("component").agg(F.min("first").alias("component_id")))
    groups = cut(labelled.join(names, "component").select("fp", "component_id"))
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row: documents linked whose shingle sets have this Jaccard similarity or more.

    Rows without a doc_id take no part: their component_id is null.
    """
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("component_id"))
    return similar_sets(docs.where("doc_id is not null"), shingle, similarity).union(nameless)


def dedup_query(docs: DataFrame) -> DataFrame:
    found = near_duplicate_groups(docs, shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near-duplicates: of each group the smallest doc_id stays (all rows without a doc_id stay)."""
    groups = similar_sets(docs.where("doc_id is not null"), shingle, similarity)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
