"""Greedy context packing: a fold over each query's ranked evidence, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T

_STATE = "struct<spent:long,used:long,cut:boolean,lines:array<string>,sets:array<array<string>>,done:boolean>"


def _alike(a: Column, b: Column) -> Column:
    """The overlap of two arrays without repeats, as ``T.jaccard`` has it."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _fold(items: Column, budget: int, policy: config.PackPolicy) -> Column:
    limit = max(80, budget * 4 - 16)
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("cut"), F.array().cast("array<string>").alias("lines"), F.array().cast("array<array<string>>").alias("sets"), F.lit(False).alias("done")).cast(_STATE)
    top = F.get(items, F.lit(0))["similarity"]

    def step(s: Column, x: Column) -> Column:
        over = (x["similarity"] < top * policy.floor) & (s["used"] > 0)
        done = s["done"] | over
        again = F.exists(s["sets"], lambda o: _alike(x["toks"], o) >= policy.same)
        cost = T.token_estimate(x["line"])
        full = s["spent"] + cost > budget
        line = F.when(full, F.substring(x["line"], 1, limit)).otherwise(x["line"])
        skip = done | again | (full & (s["used"] > 0))
        cut = s["cut"] | (~done & ~again & full)
        return F.struct(
            F.when(skip, s["spent"]).otherwise(s["spent"] + T.token_estimate(line)).alias("spent"),
            F.when(skip, s["used"]).otherwise(s["used"] + 1).alias("used"),
            cut.alias("cut"),
            F.when(skip, s["lines"]).otherwise(F.concat(s["lines"], F.array(line))).alias("lines"),
            F.when(skip, s["sets"]).otherwise(F.concat(s["sets"], F.array(x["toks"]))).alias("sets"),
            done.alias("done"),
        ).cast(_STATE)

    return F.aggregate(items, start, step)


def pack(evidence: DataFrame, budget: int | None = None, now: str = config.NOW, policy: config.PackPolicy = config.PackPolicy()) -> DataFrame:
    """Per query: context, used, tokens, truncated. ``evidence`` has the records' columns; a query's evidence is a short list, so it is folded as one array."""
    line = T.evidence_line(F.col("kind"), F.col("similarity"), T.age_days(F.col("updated_at"), now), T.text_or_empty(F.col("source")), F.col("subject"), F.col("text"))
    items = F.array_sort(F.collect_list(F.struct("rank", "similarity", line.alias("line"), F.array_distinct(T.tokens(F.col("text"))).alias("toks"))))
    # few bytes and much work: spread over all partitions, which adaptive execution would merge
    parts = int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = evidence.repartition(parts, "query_id").groupBy("query_id").agg(items.alias("items")).withColumn("p", _fold(F.col("items"), budget or policy.budget, policy))
    return got.select("query_id", F.array_join("p.lines", "\n").alias("context"), F.col("p.used").alias("used"), F.col("p.spent").alias("tokens"), F.col("p.cut").alias("truncated"))
