"""The flagship plan: many queries recalled from memory in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import common, confidence, dense, fusion, lexical, packing


def memory_index(records: DataFrame) -> DataFrame:
    """Records with the text that is indexed: the subject takes part."""
    return records.withColumn("indexed", T.index_text(F.col("subject"), F.col("text")))


def indexed(records: DataFrame) -> lexical.Index:
    """One pass over the records: terms for BM25 and hashed vectors."""
    return lexical.index(memory_index(records), "record_id", "indexed", ("status", "kind"), vectors=True)


def evidence(queries: DataFrame, records: DataFrame, k: int = 12, kinds: tuple[str, ...] | None = None, cfg: config.RetrievalConfig = config.RetrievalConfig(), index: lexical.Index | None = None) -> DataFrame:
    """Ranked evidence with its records' columns. ``queries``: query_id, query. Statistics cover all records; only active ones are recalled. ``index``: of the records, where one is kept."""
    want: dict = {"status": "active"} | ({"kind": list(kinds)} if kinds else {})
    index = index or indexed(records)
    lex = lexical.search(queries, index, cfg.k_bm25, filters=want)
    asked = dense.hashed_vectors(queries, "query_id", "query").select(F.col("id").alias("query_id"), "vector")
    den = dense.search(asked, index.rows, cfg.k_dense, "chunk_id", "vector", want)
    found = fusion.evidence(den, lex, k).persist()  # k rows for each query; counted, then joined
    return records.join(common.small(found), "record_id")


@dataclass(frozen=True)
class Options:
    k: int = 12
    budget: int = 2000
    kinds: tuple[str, ...] | None = None
    now: str = config.NOW

    @property
    def scope(self) -> str:
        """What an answer depends on besides the query: part of the cache key."""
        return f"{self.k}/{self.budget}/{','.join(self.kinds or ())}"


def answer(queries: DataFrame, records: DataFrame, options: Options = Options(), index: lexical.Index | None = None) -> DataFrame:
    """A row for every query: score, mode, suggestion, conflict, the six signals, context, tokens, used, truncated."""
    found = evidence(queries, records, options.k, options.kinds, index=index).persist()  # k rows for each query, read three times
    signals = confidence.signals(queries, found, options.now)
    packed = packing.pack(found, options.budget, options.now)
    out = signals.join(packed, "query_id", "left")
    return out.select(
        "query_id", "score", "mode", confidence.suggestion(F.col("mode")).alias("suggestion"), "conflict", *confidence.SIX, "n_evidence",
        F.coalesce("context", F.lit("")).alias("context"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("used", F.lit(0)).cast("long").alias("used"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


def payload(answers: DataFrame) -> DataFrame:
    """(query_id, payload): what a recall tool returns, as a struct of seven keys."""
    cached = F.col("cached") if "cached" in answers.columns else F.lit(False)
    keys = [F.col("mode"), F.col("score").alias("confidence"), F.col("suggestion"), F.col("context"), F.col("tokens"), cached.alias("cached"), F.struct(*confidence.SIX, "conflict").alias("signals")]
    return answers.select("query_id", F.struct(*keys).alias("payload"))
