"""Rank fusion and the hybrid retriever."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from . import common


def rrf(lists: Sequence[DataFrame], k: int = 60, weights: Sequence[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rank from 1) lists: the sum of weight / (k + rank); first list first on ties is given by ``first``."""
    weights = list(weights) if weights is not None else [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError(f"{len(weights)} weights for {len(lists)} lists")
    parts = [x.select("query_id", "chunk_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part"), (F.lit(i * 1_000_000) + F.col("rank")).alias("at")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.min("at").alias("first"))


def fused(lists: Sequence[DataFrame], top: int, k: int = 60, weights: Sequence[float] | None = None) -> DataFrame:
    """The ``top`` of the fusion, ranked by score and then first appearance."""
    from pyspark.sql import Window

    got = rrf(lists, k, weights).withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first", "chunk_id")
    return got.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select("query_id", "chunk_id", "score", "rank", F.lit("hybrid").alias("origin"))


def retrieve(dense: DataFrame | None, lexical: DataFrame | None, cfg: config.RetrievalConfig = config.RetrievalConfig(), top_k: int | None = None) -> DataFrame:
    """Hybrid results for each query; a query with one non-empty list keeps that list's scores and origin."""
    top = top_k or cfg.top_k
    some = [(x, w) for x, w in ((dense, cfg.w_dense), (lexical, cfg.w_bm25)) if x is not None]
    cols = ["query_id", "chunk_id", "score", "rank", "origin"]
    if len(some) == 1:
        return some[0][0].where(F.col("rank") <= top).select(*cols)
    dense, lexical = dense.persist(), lexical.persist()  # a few rows for each query, read three times
    some = [(dense, cfg.w_dense), (lexical, cfg.w_bm25)]
    kinds = dense.select("query_id").distinct().withColumn("d", F.lit(1)).join(lexical.select("query_id").distinct().withColumn("b", F.lit(1)), "query_id", "full_outer")
    both = kinds.where("d = 1 and b = 1").select("query_id")
    one = kinds.where("d is null or b is null").select("query_id")
    hybrid = fused([x for x, _ in some], top, cfg.rrf_k, [w for _, w in some]).join(both, "query_id", "left_semi")
    single = dense.select(*cols).unionByName(lexical.select(*cols)).join(one, "query_id", "left_semi").where(F.col("rank") <= top)
    return hybrid.unionByName(single)


def vector_memory(dense: DataFrame, lexical: DataFrame, k: int = 5) -> DataFrame:
    """Facts recalled by fusing lists of 4k each."""
    return fused([dense.where(F.col("rank") <= 4 * k), lexical.where(F.col("rank") <= 4 * k)], k)


def evidence(dense: DataFrame, lexical: DataFrame, k: int = 12) -> DataFrame:
    """Memory merge: similarity is the larger of the clamped cosine and the squashed BM25 score; rank from 0."""
    from ..functions import text as T
    from .dense import clamp

    d = dense.select("query_id", F.col("chunk_id").alias("record_id"), clamp(F.col("score")).alias("ds"), F.lit(True).alias("in_dense"))
    b = lexical.select("query_id", F.col("chunk_id").alias("record_id"), T.squash(F.col("score"), config.SQUASH).alias("bs"), F.lit(True).alias("in_bm25"))
    both = d.join(b, ["query_id", "record_id"], "full_outer")
    sim = F.greatest(F.coalesce("ds", F.lit(0.0)), F.coalesce("bs", F.lit(0.0)))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("in_dense", "in_bm25")]
    got = common.top_k(both.select("query_id", "record_id", sim.alias("similarity"), *flags), k, item="record_id", score="similarity")
    return got.withColumn("rank", F.col("rank") - 1).select("query_id", "record_id", "similarity", "rank", "in_dense", "in_bm25")
