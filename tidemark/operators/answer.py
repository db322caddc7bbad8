"""Cited answers: sources prompt, citations, and injectable generation and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING = "Nothing indexed answers this question."


def sources(ranked: DataFrame, chars: int = 2000) -> DataFrame:
    """(query_id, n_sources, sources): numbered texts of ranked chunks (rank, source, text), in one short array for each query."""
    one = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"), F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" — "), F.col("source"))).otherwise(""), F.lit("\n"), F.substring("text", 1, chars))
    rows = F.array_sort(F.collect_list(F.struct("rank", one.alias("s"))))
    return ranked.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.size("r").cast("long").alias("n_sources"), F.array_join(F.transform("r", lambda x: x["s"]), "\n\n").alias("sources"))


def markers(answer: Column) -> Column:
    """Distinct [n] markers in the order of their first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("long")))


def citations(answers: DataFrame, ranked: DataFrame, chars: int = 200) -> DataFrame:
    """(query_id, position, marker, chunk_id, snippet): markers outside the results are dropped."""
    asked = answers.select("query_id", F.posexplode(markers(F.col("answer"))).alias("position", "marker"))
    hit = asked.join(ranked.select("query_id", F.col("rank").alias("marker"), "chunk_id", F.substring("text", 1, chars).alias("snippet")), ["query_id", "marker"])
    w = Window.partitionBy("query_id").orderBy("position")
    return hit.withColumn("position", F.row_number().over(w).cast("long")).select("query_id", "position", "marker", "chunk_id", "snippet")


def rerank(ranked: DataFrame, order: Callable[[str, list[str]], list[int]], first: int = 24, top: int = 6, chars: int = 600) -> DataFrame:
    """Listwise reranking of the ``first`` rows of each query (query, text, rank): ``order`` gives row numbers; repeats and numbers out of range are dropped, and failure keeps the order. Scores are 1 / rank."""
    shape = "query_id long, chunk_id long, score double, rank long, origin string"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        try:
            want = [i for i in dict.fromkeys(order(g["query"].iloc[0], [t[:chars] for t in g["text"]])) if 0 <= i < len(g)]
        except Exception:
            want = []
        want = (want or list(range(len(g))))[:top]
        ids = g["chunk_id"].to_numpy()
        return pd.DataFrame({"query_id": g["query_id"].iloc[0], "chunk_id": ids[want], "score": [1 / (i + 1) for i in range(len(want))], "rank": range(1, len(want) + 1), "origin": "rerank"})

    return ranked.where(F.col("rank") <= first).select("query_id", "query", "chunk_id", "text", "rank").groupBy("query_id").applyInPandas(run, shape)


def rerank_scored(ranked: DataFrame, score: Callable[[str, list[str]], list[tuple[int, float]]], first: int = 24, top: int = 6) -> DataFrame:
    """Reranking by a scoring service: ``score`` gives (row number, score) pairs in any order; numbers out of range and repeats are dropped, and failure keeps the order."""
    shape = "query_id long, chunk_id long, score double, rank long, origin string"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        try:
            said = {i: float(s) for i, s in reversed(list(score(g["query"].iloc[0], g["text"].tolist()))) if 0 <= i < len(g)}
            want = sorted(said.items(), key=lambda x: (-x[1], x[0]))[:top]
        except Exception:
            want = [(i, 1 / (i + 1)) for i in range(min(top, len(g)))]
        ids = g["chunk_id"].to_numpy()
        return pd.DataFrame({"query_id": g["query_id"].iloc[0], "chunk_id": [ids[i] for i, _ in want], "score": [s for _, s in want], "rank": range(1, len(want) + 1), "origin": "rerank"})

    return ranked.where(F.col("rank") <= first).select("query_id", "query", "chunk_id", "text", "rank").groupBy("query_id").applyInPandas(run, shape)


def generate(prompts: DataFrame, llm: Callable[[str], str] | None) -> DataFrame:
    """Adds answer: the generator's, or the fixed text without sources. No generator is an error."""
    if llm is None:
        raise ValueError("no generator is configured")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(answer=[llm(s) if s else NOTHING for s in b["sources"]])

    return prompts.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", answer string")
