"""Exact dense search and embedders.

The query side is cut into blocks of bounded size; each block is broadcast, every partition of
vectors multiplies its Arrow batch with it in numpy and keeps the k best of each query, and a
window takes the k best of those. So rows leave a partition as k for each query and not one
for each pair, and the vectors are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import text as T
from . import common

QUERY_BLOCK = 2048
DIM = 256
Vectors = list[list[float]]


def normalized(v: Column) -> Column:
    """L2-normalised array; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def clamp(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a vector, unit vectors as doubles)."""
    ok = np.flatnonzero(~np.asarray(column.is_null()))
    column = column.drop_null()
    flat = kernels.unpacked(column, "f4")[0] if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.flatten()
    m = np.asarray(flat, np.float64).reshape(len(ok), -1) if len(ok) else np.zeros((0, 0))
    norm = np.sqrt((m * m).sum(1, keepdims=True)) if len(ok) else m
    return ok, m / np.where(norm > 0, norm, 1)


def search(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", filters: dict | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Cosine top-k without a threshold: query_id, chunk_id, score (6 places), rank, origin. ``queries`` has query_id (long) and vector; a null vector takes no part."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    kept = vectors.where(common.matches(filters)) if filters else vectors
    rows = kept.select(F.col(id_col).cast("long").alias("chunk_id"), F.col(vector_col).alias("v"))
    asked = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    head = asked.limit(block + 1).toPandas()
    parts = 1 if len(head) <= block else -(-asked.count() // block)
    out = None
    for i in range(parts):
        q = head if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toPandas()
        if not len(q):
            continue
        ids = q["query_id"].to_numpy(np.int64)
        m = np.stack(q["vector"].map(lambda v: np.asarray(np.frombuffer(v, "f4") if isinstance(v, (bytes, bytearray)) else v, np.float64)).to_list())
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        held = spark.sparkContext.broadcast((ids, m / np.where(norm > 0, norm, 1)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, m = held.value
            best = kernels.TopK(len(ids), k)
            step = max(1, min(4000, 4_000_000 // len(ids)))
            for whole in batches:
                for lo in range(0, whole.num_rows, step):
                    b = whole.slice(lo, step)
                    ok, v = _matrix(b.column(1))
                    if len(ok):
                        best.add(np.round(m @ v.T, 6) + 0.0, np.asarray(b.column(0))[ok])
            q, c, s = best.result()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(c, pa.int64()), pa.array(s)], ["query_id", "chunk_id", "score"])

        got = rows.mapInArrow(run, "query_id long, chunk_id long, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    return common.top_k(out, k).withColumn("origin", F.lit("dense"))


def _sparse(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dim, val <> 0) of each row by itself, in one Arrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = kernels.Signs()
        for b in batches:
            for lo, hi, buf, offs in kernels.slices(b.column(1)):
                h, s, e, d = kernels.tokens(buf, offs)
                dim, sign = signs(h, h, buf, s, e)
                v = np.bincount(d * DIM + dim, sign, minlength=(hi - lo) * DIM)
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi].take(pa.array(at // DIM)), pa.array(at % DIM, pa.int32()), pa.array(v[at])], ["id", "dim", "val"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.lower(T.text_or_empty(F.col(text_col))).alias("low")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, dim int, val double")


def hashed_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sparse hashed vectors (id, dim, val): a token adds +1 or -1 to one of 256 dimensions, by its md5; not normalised. Rows of one id are summed: ids are counted first, and only rows whose id occurs again are shuffled."""
    again = docs.groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id").persist()
    if again.isEmpty():
        again.unpersist()
        return _sparse(docs, id_col, text_col)
    again, same = common.small(again), F.col(id_col).eqNullSafe(F.col("__id"))
    once = _sparse(docs.join(again, same, "left_anti"), id_col, text_col)
    summed = _sparse(docs.join(again, same, "left_semi"), id_col, text_col).groupBy("id", "dim").agg(F.sum("val").alias("val")).where("val <> 0")
    return once.unionByName(summed)


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, vector): the hashed vectors as packed floats, built from each row by itself, without a shuffle; a text without tokens points along dimension 0."""

    from . import lexical

    return lexical.forward(docs, id_col, text_col, vectors=True).select(F.col("chunk_id").alias("id"), "vector")


def blake_embedding(text: str, dim: int = DIM) -> list[float]:
    """The hashing embedder: eight blake2b bytes of each token give a dimension and a sign."""
    import re
    import unicodedata

    v = np.zeros(dim, np.float64)
    for t in re.findall(T.TOKEN, unicodedata.normalize("NFKC", text or "").lower()):
        d = hashlib.blake2b(t.encode(), digest_size=8).digest()
        v[int.from_bytes(d[:4], "little") % dim] += 1.0 if d[4] % 2 == 0 else -1.0
    norm = np.sqrt((v * v).sum())
    if norm == 0:
        v[0] = norm = 1.0
    return (v / norm).tolist()


class Embedder:
    """A pluggable embedder: ``embed`` maps a list of texts to vectors; queries may go another way."""

    name, model = "blake", "hash-256"

    def embed(self, some: list[str]) -> Vectors:
        return [blake_embedding(t) for t in some]

    def embed_query(self, some: list[str]) -> Vectors:
        return self.embed(some)

    def column(self, c: Column, query: bool = False, batch: int = 128) -> Column:
        fn: Callable = self.embed_query if query else self.embed

        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            out: list = []
            for i in range(0, len(s), batch):
                out += fn([x or "" for x in s[i : i + batch]])
            return pd.Series(out)

        return run(c)
