"""Which texts contain which patterns: one pass of a multi-pattern automaton over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 50_000


def containing(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern_id: str = "item_id", pattern: str = "text", block: int = BLOCK) -> DataFrame:
    """(query_id, relevant_id) of every text that contains a pattern. Patterns go out in blocks of bounded size, one pass over the texts for each; empty ones match nothing."""
    spark = docs.sparkSession
    common.small_batches(spark)
    asked = patterns.select(F.col(pattern_id).cast("long").alias("q"), F.col(pattern).alias("p")).where("p is not null and p <> ''")
    parts, out = max(1, -(-asked.count() // block)), None
    for i in range(parts):
        rows = (asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == i) if parts > 1 else asked).collect()
        by: dict[str, list[int]] = {}
        for r in rows:
            by.setdefault(r["p"], []).append(r["q"])
        held = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            a = ahocorasick.Automaton()
            for k, p in enumerate(held.value):
                a.add_word(p, k)
            ids = list(held.value.values())
            if ids:
                a.make_automaton()
            for b in batches:
                q, d = [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for k in {k for _, k in a.iter(text or "")} if ids else ():
                        q += ids[k]
                        d += [doc] * len(ids[k])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64())], ["query_id", "relevant_id"])

        got = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "query_id long, relevant_id long")
        out = got if out is None else out.unionByName(got)
    return out
