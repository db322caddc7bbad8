"""The corpus pipeline: five stages from ``documents`` to sampled SentencePiece ids.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and its
result is written as Parquet and reread before the next one. All but the last return the
columns of ``documents``. Rows with null or letterless text go in the first stage. Copies that
line dedup leaves no line go there; of lines in ten documents the first by id, place and hash of the text stays. Repeated
rows of one id and text count as one document in
the near-duplicate stage and stay or go together. Null ids, languages and sources pass through. An empty table stays empty through
all stages. Columns besides those of ``documents`` are dropped by the first stage. Memory for long texts is that of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, line_dedup, near_dedup, piece_sampling, registry, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected when no language explains this share of its words.
MIN_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language can't be told: ``und``, or a score under ``MIN_SCORE``."""
    model = language_id.fit(docs, where=~language_id.held_out())
    got = language_id.predict(docs, model, extra=COLUMNS[1:])
    return got.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line that stands in ten documents or more, the first stays; a document that loses all its words goes."""
    got = line_dedup.dedup(docs, policy="after_first", extra=("lang", "source"))
    left = (F.col("n_dropped") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    return got.where(left).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group."""
    gone = near_dedup.groups(docs).where(~F.col("kept")).select("row", "row2").distinct()
    known = docs.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("row2", F.hash("doc_id", "text"))
    return known.join(gone.hint("shuffle_hash"), ["row", "row2"], "left_anti").select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, in its words or re-parameterised."""
    known = docs.withColumn("row", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.hash("doc_id", "text").alias("b")))
    leaks = decontaminate.matches(known, registry.table(spark, sf_dir, "benchmark"), id_col="row").select("row").distinct()
    return known.join(leaks, "row", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each text, with the first one's ids."""
    return piece_sampling.segment(docs, registry.tokenizer_file("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", decontaminate_benchmark),
    ("sentencepiece", encode),
]
#: Language models and sampled segmentations can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
