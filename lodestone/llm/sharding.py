"""Reproducible shuffled sharding by a Feistel permutation with cycle walking, DataFrame functions only.

Rows get global numbers 0..N-1 in the order of doc_id (ties by text checksum, then size). A Feistel network over
the smallest square a*a >= N permutes the square; values of N or more are walked along their cycle until they
fall below N, which makes it a permutation of 0..N-1. Shard and slot are remainder and quotient of the permuted
number, so shard sizes differ by one row at most (law ``rows``) and any worker can compute where a row goes.

Null text counts as empty, null doc_id sorts first, repeated rows get numbers of their own, an empty table
gives no rows, other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import number_rows

ROUNDS, SEED = 4, 20240
#: Odd multiplier and modulus of the round function; products stay below 2**63.
MULTIPLIER, MODULUS = 1_103_515_245, 2_147_483_647


def round_value(half: Column, k: Column, seed: int) -> Column:
    """A number that depends on the half, the round and the seed; every product stays below 2**63."""
    x = (half + (k + 1) * F.lit(104_729 + seed % 99_991)) % F.lit(MODULUS)
    x = (x * F.lit(MULTIPLIER) + F.lit(12_345)) % F.lit(MODULUS)
    return (x.bitwiseXOR(F.shiftright(x, 13)) * F.lit(48_271)) % F.lit(MODULUS)


def quotient(x: Column, remainder: Column, by: int) -> Column:
    """Whole-number division without floating point."""
    return F.call_function("div", x - remainder, F.lit(by).cast("long"))


def network(x: Column, side: int, seed: int = SEED) -> Column:
    """One pass of the Feistel network over 0..side*side-1."""
    right = x % F.lit(side).cast("long")
    halves = F.struct(quotient(x, right, side).alias("left"), right.alias("right"))
    done = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")),
        halves,
        lambda h, k: F.struct(h["right"].alias("left"), ((h["left"] + round_value(h["right"], k, seed)) % F.lit(side).cast("long")).alias("right")),
        lambda h: h["left"] * F.lit(side) + h["right"],
    )
    return done


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """Position of row number ``x`` in the shuffled order of ``n`` rows.

    A cycle leaves 0..n-1 for side*side-n steps at most, which bounds the walk exactly for small n; beyond 64
    steps (chance below 1e-90 for a large n) the row raises an error instead of taking a wrong place.
    """
    side = max(1, math.isqrt(max(n - 1, 0)) + 1)
    steps = min(side * side - n, 64)
    start = -x - F.lit(1)  # negative: not permuted yet

    def step(acc: Column, _: Column) -> Column:
        return F.when((acc >= 0) & (acc < n), acc).otherwise(network(F.when(acc < 0, -acc - 1).otherwise(acc), side, seed))

    value = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), start, step)
    return F.when(value < n, value).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """Every row's size, checksum, shard and slot; only those few bytes per row are shuffled, never the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(8)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    placed = numbered.withColumn("position", permute(F.col("row_no"), n, seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("position") % F.lit(shards)).cast("int").alias("shard"),
        quotient(F.col("position"), F.col("position") % F.lit(shards), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
