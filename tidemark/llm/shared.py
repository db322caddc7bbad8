"""Folders and session settings of jobs that must outlive a lost executor."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

PIECES = 16


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local folder if the whole session runs on one machine, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _until_exit(spark, given)
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def _until_exit(spark: SparkSession, at: str) -> None:
    """What a lazy result still reads can't go before it: the driver's file system removes it when the session ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def path(spark: SparkSession, name: str) -> str:
    at = f"{folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    _until_exit(spark, at)
    return at


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, reread: its lineage ends there. Remove it as soon as nothing reads it; else it goes with the session."""
    spark = df.sparkSession
    at = path(spark, name)
    df.write.mode("append").option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def remove(spark: SparkSession, *folders: str) -> None:
    for at in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    at = path(spark, name)
    try:
        yield at
    finally:
        remove(spark, at)


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def summed(made: DataFrame, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Tables of a fixed size that tasks made, as (piece, cells) rows, folded into one: ``PIECES`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(c.as_buffer(), kind)
                got[i] = fold(got[i], v) if i in got else v
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([v.tobytes() for v in got.values()], pa.binary())], ["piece", "cells"])

    rows = made.repartition(PIECES, "piece").mapInArrow(run, "piece int, cells binary").collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        v = np.frombuffer(r["cells"], kind)
        out[r["piece"]] = fold(out[r["piece"]], v) if r["piece"] in out else v
    return np.concatenate([out[i] for i in range(PIECES)]) if out else np.zeros(0, kind)


def bit_table(rows: DataFrame, key: Column, bits: int) -> np.ndarray:
    """2**bits flags, packed: which leading bits the longs ``key`` have. A test by it passes all keys of ``rows`` and, while these are few against its size, few others; who joins afterwards doesn't depend on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, bool)
        for b in batches:
            flags[(np.asarray(b.column(0)).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        if flags.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in np.split(np.packbits(flags), PIECES)], pa.binary())], ["piece", "cells"])

    got = summed(rows.select(key.alias("key")).where("key is not null").mapInArrow(run, "piece int, cells binary"), np.bitwise_or, "u1")
    return got if len(got) else np.zeros((1 << bits) // 8, np.uint8)
