"""Retrieval metrics over ranked results, one aggregate for all cases."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_case(cases: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, mrr, ndcg) of every case with a relevant id. ``ranked``: query_id, chunk_id, rank from 1, doc_id?; ``relevant``: query_id, relevant_id, matched against either id."""
    rel = relevant.select("query_id", "relevant_id").distinct()
    size = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    use = ranked.where(F.col("rank") <= k)
    doc = F.col("doc_id") if "doc_id" in ranked.columns else F.col("chunk_id")
    ids = use.select("query_id", "rank", F.explode(F.array_distinct(F.array(F.col("chunk_id").cast("string"), doc.cast("string")))).alias("rid"))
    hits = ids.join(rel.select("query_id", F.col("relevant_id").cast("string").alias("rid")), ["query_id", "rid"]).select("query_id", "rank").distinct()
    got = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = cases.select("query_id").join(size, "query_id").join(got, "query_id", "left")
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return out.select("query_id", F.col("first").isNotNull().cast("double").alias("hit"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def report(cases: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: cases (all of them), k, and the means over cases with relevant ids. No case at all is an error."""
    n = cases.count()
    if not n:
        raise ValueError("the evaluation set is empty")
    got = per_case(cases, ranked, relevant, k)
    return got.agg(F.lit(n).cast("long").alias("cases"), F.lit(k).cast("long").alias("k"), *(F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(to) for c, to in (("hit", "hit_rate"), ("mrr", "mrr"), ("ndcg", "ndcg"))))


def judged(first: Column, second: Column, judge: Callable[[str, str], float]) -> Column:
    """A pluggable judge's score of two texts (context and answer, or question and answer), held within 0 and 1; a judge that fails, or says no number, gives 0."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> float:
            try:
                got = float(judge(x or "", y or ""))
            except Exception:
                return 0.0
            return min(1.0, max(0.0, got)) if got == got else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(first, second)
