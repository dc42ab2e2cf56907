"""Repeated passages by relative Lempel-Ziv parsing against an index of reference blocks.

Every document is reference text for all documents with a larger doc_id. Its words are hashed; each window of
``WINDOW`` words is assigned to the smallest ``GRAM``-word hash in it (its anchor), so equal windows have equal
anchors wherever they stand. The windows of one anchor form a reference block: the words from the first window's
start to the last one's end. The index maps a block - its anchor's hash and its own, 128 bits - to the first place that has it: the
smallest doc_id and the first word there.

A document is then factored greedily from its start: a factor begins at the next block that the index knows from a
smaller document and goes on as long as the following block stands in the same reference document at the place where
the reference text goes on. So each factor is (start, length, reference document, reference start), as long as that
reference allows, and all its words are a duplicate span (a block has a window's length at least). At factor
boundaries, where documents share an anchor but not the block around it, the windows of the block are looked up one by
one in an index of single windows, so that spans are exact to the word. Blocks whose anchor only one document has need
neither index.

Nothing is compared pairwise: both indexes are minimum aggregates (combined before the shuffle), and the joins back have
plain exchanges on both sides, so adaptive execution can split a hot passage. What is gathered per document is 16 bytes
a block or window that repeats, less than the text that it stands for.

Null text has no words; null doc_ids are neither reference nor deduplicated; rows that share a doc_id count as one
document for the order but are returned each; texts under a window's length are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.common import bound_batches, cut, map_batches, spread, tidy

WINDOW, GRAM = 50, 12
REMEMBERED = 200_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
LOW = np.uint64(0xFFFFFFFF)


class WordHashes(dict):
    """128-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_128_digest(word)
        return value


class Powers:
    """Powers of the hash bases and of their inverses, as far as the longest text needs."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.down = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def reach(self, n: int) -> None:
        if len(self.up[0]) >= n:
            return
        n = 1 << n.bit_length()
        for i, base in enumerate(BASES):
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            for held, factor in ((self.up, base), (self.down, inverse)):
                held[i] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, factor, np.uint64)]))


HASHES, POWERS = WordHashes(), Powers()


class Parsed:
    """One text's words, anchors and blocks."""

    def __init__(self, words: list[bytes]):
        self.words = words
        n = len(words)
        if n < WINDOW:
            self.anchors = np.zeros(0, np.int64)
            self.first = self.last = self.gram = self.block = np.zeros(0, np.int64)
            return
        POWERS.reach(n + 1)
        h = np.frombuffer(b"".join(map(HASHES.__getitem__, words)), "<u8").reshape(n, 2)
        self.sums = []
        for i in range(2):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(h[:, i] * POWERS.up[i][:n], out=total[1:])
            self.sums.append(total)
        grams = self.span(0, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
        grams ^= grams >> np.uint64(29)
        grams *= BASES[1]
        rank = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
        width, reached = WINDOW - GRAM + 1, 1
        while reached < width:  # sliding minimum by doubling
            step = min(reached, width - reached)
            rank = np.minimum(rank[:-step], rank[step:])
            reached += step
        place = (rank & LOW).astype(np.int64)  # anchor of the window that starts at each word
        self.first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        self.last = np.r_[self.first[1:], len(place)] - 1
        self.gram = grams[place[self.first]].view(np.int64)
        self.block = self.span(0, self.first, self.last + WINDOW).view(np.int64)

    def span(self, i: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words start..end-1; the length takes part."""
        s = self.sums[i]
        return (s[end] - s[start]) * POWERS.down[i][start] + (end - start).astype(np.uint64) * BASES[1 - i]

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self.span(i, starts, starts + WINDOW).view(np.int64) for i in range(2))  # type: ignore[return-value]

    def starts_of(self, blocks: np.ndarray) -> np.ndarray:
        """Window starts of the chosen blocks."""
        n = self.last[blocks] - self.first[blocks] + 1
        return np.repeat(self.first[blocks], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def known(a1: np.ndarray, a2: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which (a1, a2) are among ``pairs`` (k x 2)."""
    if not len(pairs) or not len(a1):
        return np.zeros(len(a1), bool)
    kind = [("a", np.int64), ("b", np.int64)]
    mine = np.empty(len(a1), kind)
    mine["a"], mine["b"] = a1, a2
    theirs = np.ascontiguousarray(pairs).view(kind).ravel()
    return np.isin(mine, theirs)


def packed_pairs(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value or b"", ">i8").astype(np.int64).reshape(-1, 2)


def gather(condition: Column, *values: Column) -> Column:
    """The numbers of the rows that meet the condition, 16 bytes each, as one big-endian byte string."""
    row = F.concat(*(F.lpad(F.hex(v), 16, "0") for v in values))
    return F.array_join(F.collect_set(F.when(condition, row)), "")


#: One block's factor: its number in the document, the reference's first word there, the reference document.
FACTOR = np.dtype([("block", ">i4"), ("at", ">i4"), ("doc", ">i8")])


def row_key(docs: DataFrame) -> Column:
    """Tells texts of one doc_id apart where doc_ids repeat; else it is 0, which takes no room in a shuffle."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text")


def parse_blocks(docs: DataFrame, row: Column) -> DataFrame:
    """(_id, _row, _gram, _block, _at: arrays) of the documents that take part."""
    bound_batches(docs.sparkSession)
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("_id"), row.alias("_row"), F.col("text").cast("string").alias("_text"))
    names = ["_id", "_row", "_gram", "_block", "_at"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Parsed(text.encode("utf-8", "surrogatepass").split()) for text in batch.column("_text").to_pylist()]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p.first) for p in found])]), pa.int32())
        kinds = (("gram", np.int64), ("block", np.int64), ("first", np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([getattr(p, k) for p in found] or [np.zeros(0, t)]).astype(t))) for k, t in kinds]
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_row"), *lists], names=names)

    return map_batches(spread(source), one, "_id long, _row long, _gram array<long>, _block array<long>, _at array<int>")


def compressed(docs: DataFrame, row: Column) -> DataFrame:
    """(_id, _row, _rest, _z): the texts as they are shuffled."""
    rest = [c for c in docs.columns if c != "text"]
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), row.alias("_row"), F.struct(*rest).alias("_rest"), F.col("text").cast("string").alias("_text"))
    schema = T.StructType([source.schema["_id"], source.schema["_row"], source.schema["_rest"], T.StructField("_z", T.BinaryType())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        z = [None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("_text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_row"), batch.column("_rest"), pa.array(z, pa.binary())], names=schema.names)

    return map_batches(source, one, schema)


def duplicate_index(parsed: DataFrame) -> DataFrame:
    """Per document: ``_dups`` the blocks known from smaller documents with their first place, ``_open`` the anchors at factor boundaries."""
    zipped = F.posexplode(F.arrays_zip("_gram", "_block", "_at")).alias("no", "b")
    place = F.shiftleft(F.col("no").cast("long"), 32).bitwiseOR(F.col("b._at").cast("long"))  # the block's number and its first word
    blocks = parsed.select("_id", "_row", zipped).select("_id", "_row", place.alias("place"), F.col("b._gram").alias("gram"), F.col("b._block").alias("block"))
    grams = blocks.groupBy("gram").agg(F.min("_id").alias("low"), F.max("_id").alias("high"))
    shared = cut(grams.where("low < high").select("gram"))
    mine = cut(blocks.join(shared, "gram").select("_id", "_row", "place", "gram", "block"))
    at = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    first = mine.groupBy("gram", "block").agg(F.min(F.struct("_id", at.alias("at"))).alias("first"))
    first = cut(first.withColumn("mixed", F.count("*").over(Window.partitionBy("gram")) > 1))
    placed = mine.join(first, ["gram", "block"]).withColumn("dup", F.col("_id") > F.col("first._id")).where("dup or mixed")
    source = F.col("place").bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.col("first.at"))
    return cut(
        placed.groupBy("_id", "_row").agg(
            gather(F.col("dup"), source, F.col("first._id")).alias("_dups"),
            gather(~F.col("dup"), F.col("gram")).alias("_open"),
        )
    )


def boundary_windows(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Per document: ``_wins``, the single windows at factor boundaries that smaller documents have."""
    todo = texts.select("_id", "_row", "_z").join(index.where("_open <> ''"), ["_id", "_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, keys, w1, w2 = [], [], [], []
            for doc, key, z, dups, grams in zip(*(batch.column(c).to_pylist() for c in ("_id", "_row", "_z", "_dups", "_open"))):
                p = Parsed(unpress.decompress(z).split())
                opened = np.isin(p.gram, np.frombuffer(bytes.fromhex(grams), ">i8").astype(np.int64))
                opened[known_blocks(dups)["block"]] = False
                a, b = p.windows(p.starts_of(np.flatnonzero(opened)))
                ids.append(np.full(len(a), doc, np.int64))
                keys.append(np.full(len(a), key, np.int64))
                w1.append(a)
                w2.append(b)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys, w1, w2)], names=["_id", "_row", "w1", "w2"])

    windows = cut(todo.mapInArrow(run, "_id long, _row long, w1 long, w2 long"))
    first = windows.groupBy("w1", "w2").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
    first = cut(first.where("first < last").select("w1", "w2", "first"))
    late = windows.join(first, ["w1", "w2"]).where("_id > first")
    return cut(late.groupBy("_id", "_row").agg(gather(F.lit(True), F.col("w1"), F.col("w2")).alias("_wins")))


def known_blocks(dups: str | None) -> np.ndarray:
    """The blocks that the index knows, in the document's order."""
    found = np.frombuffer(bytes.fromhex(dups or ""), FACTOR)
    return found[np.argsort(found["block"], kind="stable")]


def factors_of(p: Parsed, dups: str | None) -> np.ndarray:
    """The document's factors as rows (start, length, reference document, reference start)."""
    found = known_blocks(dups)
    if not len(found):
        return np.zeros((0, 4), np.int64)
    block, at, doc = (found[k].astype(np.int64) for k in ("block", "at", "doc"))
    start, end = p.first[block], p.last[block] + WINDOW
    goes_on = (block[1:] == block[:-1] + 1) & (doc[1:] == doc[:-1]) & (at[1:] - at[:-1] == start[1:] - start[:-1])
    heads = np.flatnonzero(np.r_[True, ~goes_on])
    tails = np.r_[heads[1:], len(block)] - 1
    return np.stack([start[heads], end[tails] - start[heads], doc[heads], at[heads]], axis=1)


def removal_mask(p: Parsed, factors: np.ndarray, wins: np.ndarray) -> np.ndarray:
    """The words that factors or boundary windows cover."""
    n = len(p.words)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, factors[:, 0], 1)
    np.add.at(edge, factors[:, 0] + factors[:, 1], -1)
    if len(wins) and n >= WINDOW:
        starts = np.arange(n - WINDOW + 1)
        hit = np.flatnonzero(known(*p.windows(starts), wins))
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def factor_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, ref_doc, ref_start): the factors of every row with a doc_id, counted in words."""
    row = row_key(docs)
    texts = compressed(docs.select("doc_id", "text"), row)
    joined = texts.join(duplicate_index(cut(parse_blocks(docs, row))).where("_dups <> ''").select("_id", "_row", "_dups"), ["_id", "_row"])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpress = zstandard.ZstdDecompressor()
        rows = [np.zeros((0, 5), np.int64)]
        for doc, z, dups in zip(*(batch.column(c).to_pylist() for c in ("_id", "_z", "_dups"))):
            found = factors_of(Parsed(unpress.decompress(z).split()), dups)
            rows.append(np.concatenate([np.full((len(found), 1), doc), found], axis=1))
        table = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array(table[:, i].copy()) for i in range(5)], names=["doc_id", "start", "length", "ref_doc", "ref_start"])

    return map_batches(joined, one, "doc_id long, start long, length long, ref_doc long, ref_start long")


def parse_documents(docs: DataFrame, keep_rest: bool, digest: bool) -> DataFrame:
    """Every row with its word counts and the text without duplicate spans (or that text's SHA-256)."""
    spark = docs.sparkSession
    row = row_key(docs)
    texts = compressed(docs if keep_rest else docs.select("doc_id", "text"), row)
    index = duplicate_index(cut(parse_blocks(docs, row)))
    wins = boundary_windows(texts, index)
    # one partitioning for both joins: the texts are shuffled once
    joined = texts.join(index.select("_id", "_row", "_dups"), ["_id", "_row"], "left").join(wins, ["_id", "_row"], "left")
    schema = T.StructType([joined.schema["_rest"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            words_n, gone_n, kept = [], [], []
            for z, dups, late in zip(*(batch.column(c).to_pylist() for c in ("_z", "_dups", "_wins"))):
                data = b"" if z is None else unpress.decompress(z)
                words = data.split()
                gone = 0
                if dups or late:
                    p = Parsed(words)
                    mask = removal_mask(p, factors_of(p, dups), packed_pairs(bytes.fromhex(late or "")))
                    gone = int(mask.sum())
                total = len(words)
                if gone:
                    words = [w for w, m in zip(words, mask.tolist()) if not m]
                if digest:
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                elif z is None:
                    kept.append(None)
                else:
                    kept.append((b" ".join(words) if gone else data).decode("utf-8", "surrogatepass"))
                words_n.append(total)
                gone_n.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(kept, pa.string())], names=schema.names)
        HASHES.clear()
        tidy()

    return joined.mapInArrow(run, schema)


def dedup_query(docs: DataFrame) -> DataFrame:
    out = parse_documents(docs, keep_rest=False, digest=True)
    return out.select(F.col("_rest.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages: kept words joined by blanks (texts without repeats stay as they are)."""
    out = parse_documents(docs, keep_rest=True, digest=False)
    values = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*(values[c].alias(c) if c in values else F.col("_rest").getField(c).alias(c) for c in docs.columns))
