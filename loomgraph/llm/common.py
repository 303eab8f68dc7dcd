"""Shared pieces of the training-data operators: tables, the shared folder, words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is stored: its shuffle files go when it is written, and tasks get few whole texts in one Arrow batch.
WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one in local mode alone, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}"


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What stored() writes inside, but for what it is told to keep, is removed at the end."""
    held, path = getattr(_scratch, "path", None), f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.path = path
    try:
        yield
    finally:
        _scratch.path = held
        remove(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, lost executors cost nothing.

    The folder belongs to the application; release() removes all of it, scratch() what need not outlive it.
    """
    spark = df.sparkSession
    top = getattr(_scratch, "path", None)
    path = f"{top if top and not keep else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = {k: spark.conf.get(k) for k in WHILE_STORED}
    try:
        for k, v in WHILE_STORED.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove every table that stored() wrote in this application; call it once its results are written."""
    remove(spark, shared_dir(spark))


#: Bits of the bitmap that tells rows which are surely not concerned from those that may be, and bits of one piece of it.
BITS, PIECE = 1 << 24, 1 << 15


def split_by(docs: DataFrame, keys: list[Column], named: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(others, maybe): the rows of docs whose keys are surely not among named's columns `names`, and all the rest.

    A bitmap of BITS hash bits of the named keys (2 MiB at most, whatever the input) is broadcast, so others pass
    without moving. The more is named, the more of docs is in maybe; no row is in both or in neither. Keys are
    compared with nulls equal. docs is read twice and should be a stored table.
    """
    bit = lambda cols: F.shiftrightunsigned(F.xxhash64(*cols), 64 - BITS.bit_length() + 1)
    bits = named.select(bit([F.col(n) for n in names]).alias("bit")).groupBy(F.expr(f"bit div {PIECE}").alias("__piece"))
    bits = bits.agg(F.bitmap_construct_agg(F.expr(f"bit % {PIECE}")).alias("__map"))
    at = F.col("__bit") % PIECE
    byte = F.ascii(F.decode(F.substring("__map", (at / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    tagged = docs.withColumn("__bit", bit(keys)).withColumn("__piece", F.expr(f"__bit div {PIECE}")).join(F.broadcast(bits), "__piece", "left")
    maybe = tagged.withColumn("__maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    return tuple(maybe.filter(F.col("__maybe") == said).select(*docs.columns) for said in (False, True))


def without(docs: DataFrame, keys: list[Column], gone: DataFrame, names: list[str]) -> DataFrame:
    """The rows of docs whose keys are not among gone's columns `names` (nulls equal); only rows that may be are moved."""
    others, maybe = split_by(docs, keys, gone, names)
    said = gone.select(*[F.col(n).alias(f"__gone{i}") for i, n in enumerate(names)]).hint("merge")
    same = [k.eqNullSafe(F.col(f"__gone{i}")) for i, k in enumerate(keys)]
    return others.unionByName(maybe.join(said, reduce(Column.__and__, same), "left_anti"))


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, after the last of which a worker gives what it has freed back to the machine, as it may idle for long."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def size_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df; exact file sizes for what stored() returned."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
