"""Versioned Parquet collections: upsert, delete, count, clear, and the keyed embedding cache.

A write makes a new version folder and then, by one rename to a name that isn't there yet, the file
``CURRENT.<n>`` that says that it is whole. Readers take the highest of these, so a write that stops
anywhere leaves the old version as it is, and no folder is written twice. ``seq`` keeps the place of a
row's first insertion. What depends on a collection's content, as caches do, is registered with ``on_write``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import common, dense


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", seq: str = "seq", version: str = "version") -> DataFrame:
    """Last write wins by key; a row that is replaced keeps its place, others follow in their order. Both have ``version``; ``seq`` in ``old``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, seq, version, "__new")]
    got = both.groupBy(key).agg(common.last(rest, ["__new", version], both).alias("x"), F.min(seq).alias(seq))
    return got.select(key, F.col(f"x.{version}").alias(version), *(F.col(f"x.{c}").alias(c) for c in rest), seq)


def delete(rows: DataFrame, ids: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, int]:
    """What stays, and how many of the ids were there."""
    k = ids.select(key).distinct()
    return rows.join(k, key, "left_anti"), rows.join(k, key, "left_semi").count()


class Collection:
    """A named collection in a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._after: list[Callable[[], None]] = []

    def file(self, name: str, whole: bool = False):
        p = self._hadoop.Path(name if whole else f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def on_write(self, then: Callable[[], None]) -> None:
        """``then`` runs after each write that changed something."""
        self._after.append(then)

    def _numbers(self, begin: str) -> list[int]:
        fs, p = self.file("")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n[len(begin) :]) for n in names if n.startswith(begin) and n[len(begin) :].isdigit()]

    @property
    def version(self) -> int:
        return max(self._numbers("CURRENT."), default=0)

    def read(self) -> DataFrame:
        v = self.version
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> int:
        v = max([self.version, *self._numbers("v")]) + 1  # a folder that a stopped write left isn't used again
        rows.write.mode("errorifexists").parquet(f"{self.path}/v{v}")
        fs, tmp = self.file(f"_making.{v}.{uuid.uuid4().hex}")
        fs.create(tmp, True).close()
        _, at = self.file(f"CURRENT.{v}")
        if not fs.rename(tmp, at):
            raise OSError(f"version {v} of {self.path} was written by someone else")
        for then in self._after:
            then()
        return v

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last ``keep`` versions, and folders that stopped writes left before them."""
        fs, _ = self.file("")
        old = sorted(self._numbers("CURRENT."))[:-keep]
        for v in [n for n in self._numbers("v") if old and n <= old[-1]]:
            for name in (f"CURRENT.{v}", f"v{v}"):
                fs.delete(self.file(name)[1], True)

    def upsert(self, rows: DataFrame, key: str = "chunk_id") -> int:
        v = self.version
        high = (self.read().agg(F.max("seq")).first()[0] or 0) if v else 0
        new = rows.withColumn("version", F.lit(v + 1).cast("long"))
        if "seq" not in rows.columns:
            new = new.withColumn("seq", F.lit(high).cast("long") + 1 + F.monotonically_increasing_id())
        return self.write(upsert(self.read(), new, key).select(*self.read().columns))

    def delete(self, ids: DataFrame, key: str = "chunk_id") -> int:
        left, n = delete(self.read(), ids, key)
        if n:
            self.write(left)
        return n

    def get(self, one: object, key: str = "chunk_id") -> Row | None:
        """The row of a key, or None; the filter reaches the Parquet scan."""
        return self.read().where(F.col(key) == F.lit(one)).first()

    def count(self) -> int:
        return self.read().count()

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], self.schema))


def cache_key(text, provider: str, model: str, query: bool = False):
    return F.concat(F.lit(f"{provider}:{model}:{'query' if query else 'doc'}:"), F.sha2(T.text_or_empty(text).cast("binary"), 256))


def missing(texts: DataFrame, cache: DataFrame, provider: str = "blake", model: str = "hash-256", text_col: str = "text") -> DataFrame:
    """Distinct (key, text) that the cache lacks."""
    keyed = texts.select(cache_key(F.col(text_col), provider, model).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def embedded(texts: DataFrame, cache: DataFrame, embedder: dense.Embedder) -> tuple[DataFrame, DataFrame]:
    """(texts with vectors, the cache with the new ones): only what is missing is embedded."""
    new = missing(texts, cache, embedder.name, embedder.model).withColumn("vector", embedder.column(F.col("text"))).select("key", "vector")
    full = cache.select("key", "vector").unionByName(new)
    return texts.withColumn("key", cache_key(F.col("text"), embedder.name, embedder.model)).join(full, "key", "left").drop("key"), full
