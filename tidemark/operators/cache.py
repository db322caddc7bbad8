"""Query-keyed caches of verdicts and answers.

Probes are batched. TTL and scope (what else the answer depends on: kinds, budget, top_k,
filters) are applied before the best entry is chosen, so a stale entry never hides a fresh one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from . import dense


def fresh(created: Column, now: str, ttl_days: int) -> Column:
    return F.lit(now).cast("timestamp").cast("double") - created.cast("timestamp").cast("double") <= ttl_days * 86400


def probe_exact(queries: DataFrame, cache: DataFrame, now: str = config.NOW, policy: config.CachePolicy = config.VERDICTS) -> DataFrame:
    """Per query with a fresh entry of the same normalised text (and scope): entry_id and payload of the earliest entry. An equi-join; entries are reduced to one for each key first."""
    use = cache.where(fresh(F.col("created_at"), now, policy.ttl_days)).groupBy("query_norm", "scope").agg(F.min(F.struct("entry_id", "payload")).alias("x"))
    asked = queries.select("query_id", T.query_norm(F.col("query")).alias("query_norm"), "scope")
    return asked.join(use, ["query_norm", "scope"]).select("query_id", F.col("x.entry_id").alias("entry_id"), F.col("x.payload").alias("payload"))


def probe_semantic(queries: DataFrame, cache: DataFrame, now: str = config.NOW, policy: config.CachePolicy = config.VERDICTS) -> DataFrame:
    """Per query whose best fresh entry reaches the threshold: entry_id and similarity. ``queries`` has vector; ``cache`` has entry_id and embedding."""
    use = cache.where(fresh(F.col("created_at"), now, policy.ttl_days))
    best = dense.search(queries, use, 1, "entry_id", "embedding")
    return best.where(F.col("score") >= policy.threshold).select("query_id", F.col("chunk_id").alias("entry_id"), F.col("score").alias("similarity"))


def writable(verdicts: DataFrame) -> DataFrame:
    """Only direct and cautious verdicts are cached; their evidence isn't."""
    drop = [c for c in ("evidence",) if c in verdicts.columns]
    return verdicts.where(F.col("mode").isin("direct", "cautious")).drop(*drop)


def payload(verdicts: DataFrame) -> Column:
    return F.to_json(F.struct(*[c for c in verdicts.columns if c != "query_id"]))


def hits(probed: DataFrame, schema: str) -> DataFrame:
    """Payloads back as columns, marked as cached."""
    return probed.select("query_id", F.from_json("payload", schema).alias("x")).select("query_id", "x.*", F.lit(True).alias("cached"))


def latest(entries: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_norm", "scope").orderBy(F.col("created_at").desc(), F.col("entry_id").desc())
    return entries.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
