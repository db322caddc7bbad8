"""Confidence of recalled evidence and the answer mode, one aggregate for all queries."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T

SIX = ("top_similarity", "mean_similarity", "source_count", "agreement", "recency", "authority")


def recency(kind: Column, days: Column, policy: config.ConfidencePolicy) -> Column:
    lives = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in policy.half_life.items()))
    life = F.greatest(F.coalesce(F.element_at(lives, kind), F.lit(config.UNKNOWN_HALF_LIFE)), F.lit(1.0))
    return F.pow(F.lit(0.5), days / life)


def conflicts(evidence: DataFrame, first: int = 6) -> DataFrame:
    """(query_id, subject) of unlinked facts or decisions that share a subject with the first one seen, among the ``first`` ranks. ``evidence`` has record columns joined."""
    use = evidence.where((F.col("rank") < first) & F.col("kind").isin("fact", "decision") & (T.text_or_empty(F.col("subject")) != "")).withColumn("subject", F.lower("subject"))
    w = Window.partitionBy("query_id", "subject").orderBy("rank")
    seen = use.withColumn("fid", F.first("record_id").over(w)).withColumn("fsup", F.first("supersedes").over(w))
    linked = F.col("supersedes").eqNullSafe(F.col("fid")) | F.col("fsup").eqNullSafe(F.col("record_id"))
    return seen.where((F.col("record_id") != F.col("fid")) & ~linked).select("query_id", "subject").distinct()


def signals(queries: DataFrame, evidence: DataFrame, now: str = config.NOW, policy: config.ConfidencePolicy = config.ConfidencePolicy()) -> DataFrame:
    """A row for every query, evidence or not: six signals, conflict, score and mode."""
    rows = evidence.withColumn("recent", recency(F.col("kind"), T.age_days(F.col("updated_at"), now), policy))
    top, head = F.col("rank") < policy.max_sources, F.col("rank") < 4
    got = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 0, F.col("similarity"))).alias("top"),
        F.avg(F.when(top, F.col("similarity"))).alias("mean"),
        F.least(F.lit(1.0), F.sum((F.col("similarity") >= policy.strong).cast("double")) / policy.max_sources).alias("sources"),
        F.when(F.max("in_dense") & F.max("in_bm25"), F.sum(F.when(head, (F.col("in_dense") & F.col("in_bm25")).cast("double"))) / F.sum(head.cast("double"))).otherwise(0.5).alias("agree"),
        F.avg(F.when(top, F.col("recent"))).alias("recent"),
        F.avg(F.when(top, F.col("authority"))).alias("auth"),
        F.count("*").alias("n_evidence"),
    )
    clash = conflicts(evidence).groupBy("query_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    all_ = queries.select("query_id").distinct().join(got, "query_id", "left").join(clash, "query_id", "left")
    bad = F.col("subjects").isNotNull()
    p = policy
    *five, peace = p.weights
    parts = [F.least(F.lit(1.0), F.col("top")), *map(F.col, ("sources", "agree", "recent", "auth"))]
    raw = sum((w * c for w, c in zip(five[1:], parts[1:], strict=True)), five[0] * parts[0])
    score = F.coalesce(F.round((raw + peace * F.when(bad, 0.0).otherwise(1.0)) * F.least(F.lit(1.0), F.col("top") / p.strong), 4), F.lit(0.0))
    out = all_.withColumn("conflict", bad).withColumn("score", score)
    for name, c in (("top_similarity", "top"), ("mean_similarity", "mean"), ("source_count", "sources"), ("agreement", "agree"), ("recency", "recent"), ("authority", "auth")):
        out = out.withColumn(name, F.coalesce(F.round(c, 4), F.lit(0.0)))
    out = out.withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)).cast("long"))
    return out.withColumn("mode", mode(F.col("score"), F.col("conflict"), policy)).select("query_id", "score", "mode", "conflict", "top_similarity", "mean_similarity", "source_count", "agreement", "recency", "authority", "n_evidence", "subjects")


def mode(score: Column, conflict: Column, policy: config.ConfidencePolicy = config.ConfidencePolicy()) -> Column:
    return F.when(conflict, "ask_clarification").when(score >= policy.direct, "direct").when(score >= policy.cautious, "cautious").when(score >= policy.search, "search_more").otherwise("refuse_guess")


def suggestion(mode_: Column) -> Column:
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in config.SUGGESTIONS.items())), mode_)


def rationale(r: DataFrame) -> Column:
    """Lines that say what the score is made of, for a row of ``signals``."""
    two = T.two_places
    lines = [
        F.when(F.col("n_evidence") == 0, F.lit("no evidence in memory")).otherwise(F.concat(F.lit("best similarity "), two(F.col("top_similarity")), F.lit(" among "), F.col("n_evidence").cast("string"), F.lit(" entries"))),
        F.when(F.col("n_evidence") > 0, F.concat(F.lit("source signal "), two(F.col("source_count")), F.lit(", retrievers agree "), two(F.col("agreement")))),
        F.when(F.col("n_evidence") > 0, F.concat(F.lit("recency "), two(F.col("recency")), F.lit(", authority "), two(F.col("authority")))),
        F.when(F.col("conflict"), F.concat(F.lit("contradicting entries about "), F.array_join("subjects", ", "))),
    ]
    return F.array_compact(F.array(*lines))
