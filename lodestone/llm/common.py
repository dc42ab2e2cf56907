"""Helpers shared by the corpus operators: table access, Arrow mapping, lineage cuts, row numbering."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; keeps a Python worker's working set small whatever the text lengths are.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str | None], characters: int = 4 << 20) -> Iterator[slice]:
    """Runs of texts that together hold about so many characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= characters:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches so that very long texts do not pile up in a Python worker.

    Spark reads these two settings when a query is planned, which is after the operator has returned its frame, so they
    stay set for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a plain scan has fewer partitions than there are cores (a table of few row groups)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    scan = "AdaptiveSparkPlan" not in df._jdf.queryExecution().executedPlan().toString()
    return df.repartition(cores) if scan and df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


LIBC = ctypes.CDLL(None)


def tidy() -> None:
    """Give memory that a task no longer uses back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``; ``fn`` sees one batch at a time."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out
        tidy()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """Give every row its global 0-based position in ``order``; also return the row count.

    Range partitions are sorted locally; only one count per partition reaches the driver, and the table of
    partition offsets that is broadcast has one row per partition.
    """
    spark = df.sparkSession
    local = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    local = cut(local.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    counts = sorted((r["part"], r["n"]) for r in local.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    rows, total = [], 0
    for p, n in counts:
        rows.append((p, total))
        total += n
    offsets = spark.createDataFrame(rows, "_part long, _offset long")
    out = local.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col("_offset") + in_part).drop("_mid", "_part", "_offset"), total
