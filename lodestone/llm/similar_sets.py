"""Groups of documents whose sets of word shingles have a Jaccard similarity of at least a threshold, exactly.

A document is the set of the hashes of its word shingles; equal sets are one class. Two sets A and B of similarity
t or more share t * max(|A|, |B|) shingles at least. So, in any one order of all shingles, the first
|A| - ceil(t |A|) + 1 of A and those of B have one in common (prefix filter), whatever the sizes and however many
documents there are: as candidates no pair is missed.

The filter is applied twice, in two orders. In the first, shingles that no other document has come first: a document
with a prefix full of those is similar to none and leaves. Only counts are needed for that: half of all shingles (by a
bit of their hash; the other half comes last in the order) travel as 32-bit keys, grouped by document within ranges of
the hash that grow in number with the table, and each range tells how many of a document's keys stand alone. A key that
two shingles happen to share counts as shared, which keeps a document and loses none.

What stays - copies of any kind - goes through the second order, which puts frequent shingles last (it is measured on
repeats within batches and changes the work, never the result). A prefix shingle names a shard, so similar sets share
one. Candidates are linked in a shard by SimHash fingerprints of 256 bits, of distinct shingles, in a BK-tree: those
within ``RADIUS`` bits whose sizes allow the threshold. At similarity 0.8 a bit differs with a chance of 0.19 at most
(sets of 4 and 5 shingles; 0.152 for large ones), so the chance that a pair lies beyond the radius is computed at 3e-11
for those and below 1e-15 for large ones. Unrelated documents that happen to share shingles lie within it with a chance
of 4e-6, so they do not chain into components that grow with the table. Other thresholds get a radius by the same law.
A search takes what it finds out of its tree, so links span groups; they are joined to components. Members' texts are
then read again and every link is verified on the sets themselves. A component above
``CELL_SHINGLES`` is cut by set sizes and then into parts, each pair of parts is a cell of its own. A verified member
leaves the search, so links span groups and are never all of their pairs.

Null or empty text is the empty set, equal to other empty sets and similar to nothing else; ties and repeated rows are
one class; an empty table gives no rows; other columns are not read. The input must give the same rows in the same
order when a lost task is run again, as stored tables do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bk_tree import forest
from lodestone.llm.common import bound_batches, cut, map_batches, shuffle_width, tidy
from lodestone.llm.components import components

#: Shingles of a candidate component, or of a part of it, that are searched at once.
CELL_SHINGLES = 1 << 20
#: The order of shingles knows about so many frequent ones; all others count as equally rare.
FREQUENT = 1 << 17
#: Keys of a range of the hash that one task counts.
RANGE_KEYS, LEAST_RANGES = 1 << 18, 64
#: Entries of a BK-tree.
SHARD_LIMIT = 2048
#: 64-bit words of a fingerprint, and how many of its bits similar sets may differ in.
WORDS, RADIUS = 4, 92
#: Distinct words whose hash a worker remembers.
REMEMBERED = 200_000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Room for rounding in comparisons with the threshold.
EPS = 1e-9


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (A-Z lower-cased); a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    grams = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        grams = grams * BASE + h[i : i + n]
    grams ^= grams >> np.uint64(32)
    grams *= MIX
    grams ^= grams >> np.uint64(29)
    return np.unique(grams)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set as two signed numbers."""
    hi, lo = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(hi), int(lo)


def simhash(s: np.ndarray) -> np.ndarray:
    """The SimHash of a set, as ``WORDS`` signed numbers: a bit is one where over half of the shingles' hashes have it."""
    votes = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(s), 1 << 14):
        h = s[at : at + (1 << 14), None] + BASE * np.arange(1, WORDS + 1, dtype=np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        votes += np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(s), bitorder="little").view(np.int64)


def prefix_length(n: int, similarity: float) -> int:
    """How many of a set's n shingles, in the common order, meet those of every set as similar as that."""
    return n - math.ceil(similarity * n - EPS) + 1 if n else 0


def verified_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that span the groups which pairs of sets with this Jaccard similarity or more form."""
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i]))
    if len(order) < 2:
        return []
    distinct, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    edges = np.cumsum([0, *(len(sets[i]) for i in order)])
    own = [ids[a:b] for a, b in zip(edges, edges[1:])]
    seen = np.zeros(len(distinct), np.int32)
    # what is still searched, in the order of sizes: places in ``order``, their sizes, starts and shingles
    left, flat = np.arange(len(order)), ids
    sizes = np.diff(edges)
    starts = edges[:-1]
    alive = np.ones(len(order), bool)
    links: list[tuple[int, int]] = []
    for root in range(len(order)):
        if not alive[root]:
            continue
        alive[root] = False
        todo = [root]
        while todo:
            if 2 * np.count_nonzero(alive[left]) <= len(left):
                left = left[alive[left]]
                if not len(left):
                    return links
                flat = np.concatenate([own[i] for i in left])
                sizes = np.array([len(own[i]) for i in left])
                starts = np.cumsum(sizes) - sizes
            i = todo.pop()
            n = len(own[i])
            low, high = np.searchsorted(sizes, [similarity * n - EPS, n / similarity + EPS])
            if low >= high:
                continue
            seen[own[i]] = 1
            end = starts[high] if high < len(starts) else len(flat)
            common = np.add.reduceat(seen[flat[starts[low] : end]], starts[low:high] - starts[low])
            seen[own[i]] = 0
            near = left[low:high][common + EPS >= similarity * (n + sizes[low:high] - common)]
            for j in near[alive[near]].tolist():
                alive[j] = False
                links.append((order[root], order[j]))
                todo.append(j)
    return links


def scan(source: DataFrame, shingle: int, ranges: int) -> DataFrame:
    """One row per batch and range of the hash (``docs``, ``counts``: keys of which documents, ``keys``), and one per batch (range -1) for its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            head = np.empty((len(sets), 4), np.int64)
            head[:, 0], head[:, 1:3], head[:, 3] = batch.column("id").to_numpy(zero_copy_only=False), np.array([set_key(x) for x in sets]).reshape(-1, 2), sizes
            grams = np.concatenate([np.zeros(0, np.uint64), *sets])
            doc = np.repeat(np.arange(len(sets)), sizes)
            half = (grams & np.uint64(1)) == 0
            grams, doc = grams[half], doc[half]
            at = ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            at, doc, keys = at[order], doc[order].astype(np.uint32), (grams[order] >> np.uint64(1)).astype(np.uint32)
            runs = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[runs, len(at)]).astype(np.uint32)
            first = np.flatnonzero(np.r_[True, at[runs][1:] != at[runs][:-1]]) if len(runs) else runs
            rows = [(-1, b"", b"", head.tobytes())]
            for a, b in zip(first, np.r_[first[1:], len(runs)]):
                end = runs[b] if b < len(runs) else len(at)
                rows.append((int(at[runs[a]]), doc[runs[a:b]].tobytes(), counts[a:b].tobytes(), keys[runs[a] : end].tobytes()))
            where, docs, n, data = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array([part + number] * len(rows), pa.int64()), pa.array(where, pa.int32()), *(pa.array(x, pa.binary()) for x in (docs, n, data))], names=["batch", "range", "docs", "counts", "keys"])
            number += 1
        HASHES.clear()
        tidy()

    return source.mapInArrow(run, "batch long, range int, docs binary, counts binary, keys binary")


def alone(group: pa.Table) -> pa.Table:
    """Per batch of one range: how many keys of which documents no other document has."""
    if group.column("range")[0].as_py() < 0:
        return group.select(["batch", "docs", "counts", "keys"])
    keys = [np.frombuffer(x.as_py(), np.uint32) for x in group.column("keys")]
    _, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    once = np.split(n[inverse] == 1, np.cumsum([len(k) for k in keys])[:-1])
    docs, counts = [], []
    for mine, d, c in zip(once, group.column("docs"), group.column("counts")):
        c = np.frombuffer(c.as_py(), np.uint32).astype(np.int64)
        sums = np.add.reduceat(mine.astype(np.uint32), np.cumsum(c) - c)
        docs.append(np.frombuffer(d.as_py(), np.uint32)[sums > 0].tobytes())
        counts.append(sums[sums > 0].astype(np.uint32).tobytes())
    return pa.table({"batch": group.column("batch"), "docs": pa.array(docs, pa.binary()), "counts": pa.array(counts, pa.binary()), "keys": pa.nulls(len(docs), pa.binary())})


def print_sets(source: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, hi, lo, size, near) of every row: its class, and whether another class can be similar."""
    letters = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, letters // 12 // RANGE_KEYS)

    def combine(group: pa.Table) -> pa.Table:
        heads = [x.as_py() for x in group.column("keys")]
        head = np.frombuffer(next(x for x in heads if x is not None), np.int64).reshape(-1, 4)
        total = np.zeros(len(head), np.int64)
        for d, c in zip(group.column("docs"), group.column("counts")):
            total[np.frombuffer(d.as_py(), np.uint32)] += np.frombuffer(c.as_py(), np.uint32)
        need = np.array([prefix_length(n, similarity) for n in head[:, 3].tolist()], np.int64)
        columns = [pa.array(head[:, i].copy()) for i in range(4)]
        return pa.table([*columns, pa.array((total < need) & (need > 0))], names=["id", "hi", "lo", "size", "near"])

    # the rows of documents are dealt by their batch, so that they do not meet in one task
    dealt = F.when(F.col("range") >= 0, F.col("range").cast("long")).otherwise(-1 - F.col("batch"))
    counted = scan(source, shingle, ranges).withColumn("deal", dealt).groupBy("deal").applyInArrow(alone, "batch long, docs binary, counts binary, keys binary")
    return cut(counted.groupBy("batch").applyInArrow(combine, "id long, hi long, lo long, size long, near boolean"))


def frequent_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Shingles in the order from the less to the most frequent, of those that repeat within batches."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s for _, s in sets_of(batch, shingle)]
        kinds, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["gram", "n"])

    counts = cut(map_batches(texts, one, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    least, kept = 1 << 62, 0
    for r in sorted(counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("kinds")).collect(), key=lambda r: -r["n"]):
        kept += r["kinds"]
        if kept > FREQUENT:
            break
        least = r["n"]
    table = counts.where(F.col("n") >= least).toArrow()
    gram, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    return gram[np.lexsort((gram, n))]


def similar_sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text), none without a doc_id; component_id the smallest doc_id that links reach."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    prints = print_sets(source, shingle, similarity)
    classes = cut(prints.groupBy("hi", "lo").agg(F.min("id").alias("node")))
    # of a class one row counts; ids that repeat with other texts share a node
    heads = prints.where("near").join(classes.select("hi", "lo", F.col("node").alias("id")), ["hi", "lo", "id"]).select("id", "hi", "lo").distinct()
    labels = components(verified(cut(pressed(source).join(heads, "id")), shingle, similarity))
    groups = cut(classes.join(labels, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component_id")))
    return prints.join(groups, ["hi", "lo"]).select(F.col("id").alias("doc_id"), "component_id")


def pressed(source: DataFrame) -> DataFrame:
    """(id, z): the texts as they are shuffled."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([press.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "z"])

    return map_batches(source, one, "id long, z binary")


def sets_of(table: pa.RecordBatch | pa.Table, shingle: int) -> list[tuple[tuple[int, int, int], np.ndarray]]:
    """The sets of the rows (id, hi, lo, z) whose text has the set that the row names."""
    unpress = zstandard.ZstdDecompressor()
    found = []
    for i, hi, lo, z in zip(*(table.column(c).to_pylist() for c in ("id", "hi", "lo", "z"))):
        s = shingle_set(unpress.decompress(z).decode("utf-8", "surrogatepass"), shingle)
        if set_key(s) == (hi, lo):  # an id that repeats with other texts has several
            found.append(((i, hi, lo), s))
    return found


def radius(similarity: float) -> int:
    """The radius for a threshold: as many standard deviations above the expected distance as ``RADIUS`` is for 0.8, all bits at most."""
    bits = 64 * WORDS

    def expected(t: float) -> float:
        return math.acos(min(1.0, 2 * t / (1 + t))) / math.pi

    def deviation(p: float) -> float:
        return math.sqrt(bits * p * (1 - p)) + 1

    reach = (RADIUS - bits * expected(0.8)) / deviation(expected(0.8))
    return min(bits, math.ceil(bits * expected(similarity) + reach * deviation(expected(similarity)) - EPS))


def shard_links(members: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``members`` (gram, part_a, part_b, id, size, fingerprint), sorted within partitions -> links (a, b) that span the groups of each shard."""

    def links(shard: np.ndarray) -> list[tuple[int, int]]:
        entries: dict[tuple[int, int], int] = {}
        out = []
        data = shard[:, 5:].tobytes()
        for at, (i, n) in enumerate(shard[:, 3:5].tolist()):
            first = entries.setdefault((int.from_bytes(data[8 * WORDS * at : 8 * WORDS * (at + 1)], "little"), n), i)
            if first != i:
                out.append((i, first))
        if len(entries) > 1:
            values, sizes = zip(*entries)
            ids = list(entries.values())
            out += [(ids[j], ids[i]) for i, j in forest(list(values), radius, list(sizes), similarity - EPS)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the shard that is not complete yet

        def emit(table: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (table[1:, :3] != table[:-1, :3]).any(axis=1)])
            ends = np.r_[starts[1:], len(table)]
            out: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                out += links(table[s:e])
            ends = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64, copy=False)
            if not len(table):
                continue
            held.append(table)
            if (table[-1, :3] == held[0][0, :3]).all():
                continue
            whole = np.concatenate(held)
            last = int(np.flatnonzero((whole[:, :3] != whole[-1, :3]).any(axis=1))[-1]) + 1
            yield emit(whole[:last])
            held = [whole[last:].copy()]
        if held:
            yield emit(np.concatenate(held))
        tidy()

    return members.mapInArrow(run, "a long, b long")


def candidate_links(prints: DataFrame, similarity: float) -> DataFrame:
    """``prints`` (id, size, fingerprint, prefix) -> links (a, b): in shards by prefix shingle, those that BK-trees find."""
    fingerprint = [f"f{i}" for i in range(WORDS)]
    members = prints.select("id", "size", *fingerprint, F.explode("prefix").alias("gram"))
    # of a shard above the limit each pair of parts is a tree of its own; there are few of them: each has more rows than the limit
    large = cut(members.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_LIMIT).select("gram", F.ceil(F.col("n") / SHARD_LIMIT).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    sized = members.join(F.broadcast(large), "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    cells = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["gram", "part_a", "part_b"]
    cells = cells.select("gram", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "id", "size", *fingerprint)
    return shard_links(cells.repartition(shuffle_width(prints.sparkSession), *keys).sortWithinPartitions(*keys, "id"), radius(similarity), similarity)


def verified(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``texts`` (id, hi, lo, z) -> links (a, b) that span the groups of similar sets."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, shingle))

    def prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        frequent = shared.value
        by_gram = np.argsort(frequent)
        grams = frequent[by_gram]
        rows, out = [], []
        for row, s in sets_of(batch, shingle):
            rank = np.zeros(len(s), np.int64)
            if len(grams):
                at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                rank = np.where(grams[at] == s, by_gram[at] + 1, 0)
            rows.append((*row, len(s), *simhash(s).tolist()))
            out.append(s[np.argsort(rank, kind="stable")[: prefix_length(len(s), similarity)]])
        columns = [pa.array(c.copy()) for c in np.array(rows, np.int64).reshape(-1, 4 + WORDS).T]
        offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
        first = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64)))
        return pa.RecordBatch.from_arrays([*columns, first], names=["id", "hi", "lo", "size", *(f"f{i}" for i in range(WORDS)), "prefix"])

    words = ", ".join(f"f{i} long" for i in range(WORDS))
    prints = cut(map_batches(texts, prefixes, f"id long, hi long, lo long, size long, {words}, prefix array<long>"))
    candidates = components(candidate_links(prints, similarity))

    members = cut(prints.select("id", "hi", "lo", "size").distinct().join(candidates.select(F.col("node").alias("id"), F.col("component").alias("cell")), "id"))
    large = members.groupBy("cell").agg(F.sum("size").alias("total")).where(F.col("total") > CELL_SHINGLES)
    # sets that are similar enough have sizes of one class or of two neighbours: band i holds the classes i - 1 and i
    size_class = F.floor(F.log(F.col("size").cast("double")) / (-math.log(similarity) * (1 + 1e-6))).cast("int")
    bands = F.explode(F.when(F.col("total").isNull(), F.array(F.lit(-1))).otherwise(F.array(size_class, size_class + 1)))
    banded = cut(members.join(large, "cell", "left").withColumn("band", bands).drop("total"))
    full = banded.groupBy("cell", "band").agg(F.ceil(F.sum("size") / CELL_SHINGLES).cast("int").alias("parts")).where("parts > 1")
    parts = banded.join(full, ["cell", "band"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("hi", "lo"), F.col("parts")).cast("int")
    parts = parts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    places = cut(parts.select("id", "hi", "lo", "cell", "band", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b")))
    cells = texts.join(places, ["id", "hi", "lo"])

    def verify(cell: pa.Table) -> pa.Table:
        sets = dict(sets_of(cell, shingle))
        ids = [key[0] for key in sets]
        ends = np.array([(ids[i], ids[j]) for i, j in verified_links(list(sets.values()), similarity)], np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ends[:, 0].copy()), "b": pa.array(ends[:, 1].copy())})

    return cells.groupBy("cell", "band", "part_a", "part_b").applyInArrow(verify, "a long, b long")
