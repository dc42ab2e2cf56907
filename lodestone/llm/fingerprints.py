"""SimHash document fingerprints and permuted block tables, with DataFrame functions only.

A term is a pair of neighbouring words (lower-cased; a single word stands alone). Its weight is its length in bytes,
``WEIGHT_CAP`` at most - longer terms say more, but one run of junk must not outvote a sentence - and each occurrence
counts. Two 64-bit hashes of the term vote on 128 signed bits: a bit is set where the weight of terms that have it is
over half of all weight. Votes are counted two to a 64-bit lane, so a text may weigh up to 2**31.

``near_pairs`` finds all fingerprints within a Hamming radius r of each other through permuted block tables: the 128
bits are cut into r+m blocks, each choice of m blocks is the key of one table, and any two fingerprints within the
radius agree on m blocks at least, so they share a row of one table. m grows with the number of fingerprints, so that a
key is shared by few that are not near; every m is exact. The contract's query compares given pairs of texts and does
not need the tables.

Documents are put in order in buckets of neighbouring doc_ids, as many as the texts need (``BUCKET_BYTES``); a doc_id
that many rows share (or lack) is parted further by a hash of the text. Null text counts as empty (fingerprint zero);
null doc_ids come first; rows that share a doc_id follow each other in the order of that hash, then of the text; a
single row is its own next document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import cut, shuffle_width

WEIGHT_CAP = 16
BITS = 128
#: Bytes of text that a bucket is to hold about, and the share of a bucket that makes a doc_id a frequent one.
BUCKET_BYTES = 4 << 20
LANES = (1 << 32) + 1
#: Stands for a missing doc_id in the order of documents.
FIRST = -(1 << 63)


def term_pairs(text: Column) -> Column:
    """Array of (word, following word or empty)."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    alone = F.array(F.struct(F.element_at(words, 1).alias("a"), F.lit("").alias("b")))
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))).alias("b"))
    pairs = F.when(F.size(words) > 1, pairs.cast("array<struct<a:string,b:string>>"))
    return pairs.when(F.size(words) == 1, alone)


def fingerprint_texts(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per distinct ``keys`` of ``rows`` with ``fp_hi`` and ``fp_lo``; ``rows`` should be partitioned by some of the keys."""
    terms = rows.select(*keys, F.explode_outer(term_pairs(F.col(text))).alias("term"))
    a, b = F.col("term.a"), F.coalesce(F.col("term.b"), F.lit(""))
    weight = F.least(F.octet_length(a) + F.octet_length(b), F.lit(WEIGHT_CAP)).cast("long")
    hashed = terms.select(
        *keys,
        F.when(a.isNotNull(), weight).otherwise(F.lit(0).cast("long")).alias("w"),
        F.xxhash64(a, b).alias("h0"),
        F.xxhash64(b, F.lit("second"), a).alias("h1"),
    )
    sums = [F.sum("w").alias("weight")]
    for word in ("h0", "h1"):
        sums += [F.sum(F.shiftrightunsigned(word, i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{word}_{i}") for i in range(32)]
    votes = hashed.groupBy(*keys).agg(*sums)

    def bits(word: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            lane = F.col(f"{word}_{i}")
            low, high = lane.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(lane, 32)
            out = out.bitwiseOR(F.when(low * 2 > F.col("weight"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
            upper = (1 << (32 + i)) - (1 << 64) if i == 31 else 1 << (32 + i)
            out = out.bitwiseOR(F.when(high * 2 > F.col("weight"), F.lit(upper)).otherwise(F.lit(0)).cast("long"))
        return out

    return votes.select(*keys, bits("h0").alias("fp_hi"), bits("h1").alias("fp_lo"))


def hexed(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    """Share of equal bits."""
    differ = F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))
    return F.lit(1.0) - differ / F.lit(float(BITS))


def constant(values: list[int]) -> Column:
    """An array of numbers as one literal, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket_of(key: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of the last bound at or below (key, tie), by binary search; the first bound is below all."""
    keys, ties = constant([k for k, _ in bounds]), constant([t for _, t in bounds])
    steps = max(1, len(bounds).bit_length())

    def step(at: Column, stride: Column) -> Column:
        probe = at + stride
        k, t = F.get(keys, probe), F.get(ties, probe)
        return F.when((k < key) | ((k == key) & (t <= tie)), probe).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(steps)))), F.lit(0), step)


def bounds_of(keys: DataFrame, width: int) -> tuple[list[tuple[int, int]], bool]:
    """Lower bounds of the buckets of ``keys`` (key, size), and whether some parts a key."""
    total = keys.agg(F.sum("size").alias("bytes"), F.min("key").alias("low")).first()
    if total["low"] is None:
        return [], False
    n = max(width, total["bytes"] // BUCKET_BYTES)
    cuts = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    bounds = [(FIRST, FIRST)]
    for key in sorted({total["low"], *cuts}):
        parts = cuts.count(key)  # a frequent key takes so many buckets, each a range of the hash
        bounds += [(key, FIRST + (i << 64) // max(parts, 1)) for i in range(max(parts, 1))]
    return bounds, any(cuts.count(k) > 1 for k in set(cuts))


def with_next_text(docs: DataFrame) -> DataFrame:
    """Rows (bucket, row, key, ghost, doc_id, text, next_text) in buckets of neighbouring doc_ids; one shuffle of the texts.

    A bucket's last row needs the first of the next bucket: that document is also dealt to the bucket before, as
    a ghost row behind all others. Only bucket borders reach the driver, one for ``BUCKET_BYTES`` of text.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST).cast("long"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bounds, parted = bounds_of(docs.select(key.alias("key"), F.octet_length(text).cast("long").alias("size")), shuffle_width(spark))
    tie = F.xxhash64("text") if parted else F.lit(FIRST).cast("long")
    source = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", tie)
    own = bucket_of(F.col("key"), F.col("tie"), bounds)
    firsts = sorted((r["bucket"], r["first"]["key"], r["first"]["tie"]) for r in source.groupBy(own.alias("bucket")).agg(F.min(F.struct("key", "tie")).alias("first")).collect()) if bounds else []
    copies = F.array(F.struct(own.alias("bucket"), F.lit(0).alias("ghost")))
    if firsts:
        # by bucket: its first row, and the bucket before it that holds rows (the last one for the first)
        first = {b: (k, t, firsts[i - 1][0]) for i, (b, k, t) in enumerate(firsts)}
        low, low_tie, before = (constant([first.get(b, (FIRST, FIRST, 0))[j] for b in range(len(bounds))]) for j in range(3))
        ghost = F.array(F.struct(F.get(before, own).cast("int").alias("bucket"), F.lit(1).alias("ghost")))
        copies = F.when((F.get(low, own) == F.col("key")) & (F.get(low_tie, own) == F.col("tie")), F.concat(copies, ghost)).otherwise(copies)
    rows = source.withColumn("to", F.explode(copies)).select("to.bucket", "to.ghost", "key", "tie", "doc_id", "text")
    # as many partitions as buckets, so that a task's share does not grow with the table
    rows = rows.repartition(max(shuffle_width(spark), len(bounds)), "bucket")
    line = Window.partitionBy("bucket").orderBy("ghost", "key", "tie", "text")
    return rows.withColumn("row", F.row_number().over(line)).withColumn("next_text", F.lead("text").over(line))


def fingerprint_query(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses."""
    rows = with_next_text(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "row", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("edited", F.when(F.col("ghost") == 0, F.col("edited")))
    both = rows.select("bucket", "row", "ghost", "doc_id", "n_chars", "edited_sha256", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("v"))
    keys = ["bucket", "row", "ghost", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprint_texts(both.select(*keys, "v.kind", "v.t"), [*keys, "kind"], "t")
    own = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    paired = prints.groupBy(*keys).agg(own(0, "fp_hi").alias("hi"), own(0, "fp_lo").alias("lo"), own(1, "fp_hi").alias("edited_hi"), own(1, "fp_lo").alias("edited_lo"))
    line = Window.partitionBy("bucket").orderBy("row")
    paired = paired.withColumn("next_hi", F.lead("hi").over(line)).withColumn("next_lo", F.lead("lo").over(line))
    hi, lo = F.col("hi"), F.col("lo")
    return paired.where("ghost = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed(hi, lo).alias("fingerprint"),
        hexed(F.col("edited_hi"), F.col("edited_lo")).alias("edited_fingerprint"),
        likeness(hi, lo, F.col("edited_hi"), F.col("edited_lo")).alias("near_edited"),
        likeness(hi, lo, F.col("next_hi"), F.col("next_lo")).alias("near_next"),
    )


def block_choices(radius: int, count: int) -> list[int]:
    """Masks of the tables' keys: any two fingerprints within the radius agree on one of them."""
    m = 1
    while m < 4 and BITS * m // (radius + m) < count.bit_length() + 4:
        m += 1
    edges = [BITS * i // (radius + m) for i in range(radius + m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, m)]


def near_pairs(prints: DataFrame, radius: int, choices: int | None = None) -> DataFrame:
    """``prints`` (node, fp_hi, fp_lo) -> (a, b, distance) for classes of equal fingerprints within ``radius`` bits; a < b.

    Equal fingerprints are one class, named by its smallest node, so copies are never paired. A pair that meets in
    several tables is reported by the first of them only.
    """
    if not 0 <= radius < 16:
        raise ValueError("radius must be from 0 to 15")
    classes = cut(prints.groupBy("fp_hi", "fp_lo").agg(F.min("node").alias("node")))
    masks = block_choices(radius, choices or classes.count())

    def halves(m: int) -> tuple[Column, Column]:
        return tuple(F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in (m >> 64, m & ((1 << 64) - 1)))  # type: ignore[return-value]

    tables = [F.struct(F.lit(i).alias("t"), F.col("fp_hi").bitwiseAND(hi).alias("k_hi"), F.col("fp_lo").bitwiseAND(lo).alias("k_lo")) for i, (hi, lo) in enumerate(map(halves, masks))]
    rows = classes.select("node", "fp_hi", "fp_lo", F.explode(F.array(*tables)).alias("s")).select("node", "fp_hi", "fp_lo", "s.*")
    left = rows.select(F.col("node").alias("a"), F.col("fp_hi").alias("a_hi"), F.col("fp_lo").alias("a_lo"), "t", "k_hi", "k_lo")
    right = rows.select(F.col("node").alias("b"), F.col("fp_hi").alias("b_hi"), F.col("fp_lo").alias("b_lo"), "t", "k_hi", "k_lo")
    met = left.join(right, ["t", "k_hi", "k_lo"]).where("a < b")
    x_hi, x_lo = F.col("a_hi").bitwiseXOR(F.col("b_hi")), F.col("a_lo").bitwiseXOR(F.col("b_lo"))
    met = met.withColumn("distance", F.bit_count(x_hi) + F.bit_count(x_lo)).where(F.col("distance") <= radius)
    agree = F.array(*((x_hi.bitwiseAND(hi) == 0) & (x_lo.bitwiseAND(lo) == 0) for hi, lo in map(halves, masks)))
    return met.where(F.col("t") == F.array_position(agree, True) - 1).select("a", "b", "distance")
