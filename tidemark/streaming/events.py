"""Event streams: gate, recall in micro-batches, keep-latest state, windows and TTL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config, schema
from ..functions import text as T
from ..operators import cache, memory

MIN_CHARS, MIN_CONFIDENCE = 12, 0.25


def events(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A stream of event files in a folder."""
    return spark.readStream.schema(schema.EVENT).option("maxFilesPerTrigger", per_batch).parquet(path)


def gate(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Prompts worth a recall: long enough and no command; redacted."""
    p = T.strip(T.text_or_empty(F.col(prompt)))
    return prompts.where((F.length(p) >= MIN_CHARS) & ~p.startswith("/")).withColumn(prompt, T.redact(p))


def injectable(answers: DataFrame) -> DataFrame:
    return answers.where((F.col("mode") != "refuse_guess") & (T.text_or_empty(F.col("context")) != "") & (F.col("score") >= MIN_CONFIDENCE))


SEARCH_TOOLS = ("Grep", "Glob")


def redirected(calls: DataFrame, recall: Callable[[DataFrame], DataFrame], strict: bool = True, chars: int = 1500) -> DataFrame:
    """(query_id, decision, reason) of search-tool calls (query_id, tool, pattern) that memory answers directly; none unless ``strict``."""
    asked = calls.where(F.lit(strict) & F.col("tool").isin(*SEARCH_TOOLS)).select("query_id", T.search_query(F.col("pattern")).alias("query")).where("query is not null")
    direct = recall(asked).where("mode = 'direct'")
    return direct.select("query_id", F.lit("deny").alias("decision"), F.concat(F.lit("Memory holds this already:\n"), F.substring("context", 1, chars)).alias("reason"))


def learned(calls: DataFrame) -> DataFrame:
    """Episodes (text, kind, subject, tags) that shell calls (command, response) teach, redacted; one for each subject, the last by ``event_id``."""
    got = calls.select("event_id", T.bash_subject(F.col("command")).alias("subject"), T.redact(T.learned_from_bash(F.col("command"), T.response_text(F.col("response")))).alias("text"))
    last = memory.keep_latest(got.where("text is not null"), "subject", ["event_id"])
    return last.select("text", F.lit("episode").alias("kind"), "subject", F.array(*map(F.lit, ("auto", "candidate", "bash"))).alias("tags"))


def learning(stream: DataFrame, remember: Callable[[DataFrame], object], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of shell calls is learned from; ``remember`` (an engine's ``remember_latest``) keeps one active episode of a subject."""

    def run(batch: DataFrame, n: int) -> None:
        rows = learned(batch).persist()
        if not rows.isEmpty():
            remember(rows)
        rows.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Counts and sums of each type and window; late rows within the watermark count."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def unexpired(rows: DataFrame, now: str = config.NOW, ttl_days: int = 7) -> DataFrame:
    return rows.where(cache.fresh(F.col("ts"), now, ttl_days))


def keep_latest(stream: DataFrame, target: str, checkpoint: str, subject: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), buckets: int = 16) -> StreamingQuery:
    """Each micro-batch is merged into the latest row of each subject. State is in hash buckets of subjects; a batch rewrites those that it touches, under its own number, so one that runs again gives the same, and removes what nobody can read any more. ``latest`` reads it."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = memory.keep_latest(batch, subject, list(order)).select(*batch.columns, F.pmod(F.xxhash64(subject), F.lit(buckets)).cast("int").alias("bucket")).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
        fs, at, have = _buckets(spark, target)
        before = [f"{target}/bucket={b}/batch={max(v)}" for b in touched if (v := [x for x in have.get(b, ()) if x < n])]
        rows = new.drop("bucket")
        if before:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*before))
        merged = memory.keep_latest(rows, subject, list(order)).select(*batch.columns, F.pmod(F.xxhash64(subject), F.lit(buckets)).cast("int").alias("bucket"), F.lit(n).cast("long").alias("batch"))
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target))
        for b in touched:
            for old in sorted(x for x in have.get(b, ()) if x < n)[:-1]:
                fs.delete(at(f"{target}/bucket={b}/batch={old}"), True)
        new.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _buckets(spark: SparkSession, target: str):
    """(file system, path maker, batches of each bucket)"""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(target).getFileSystem(spark._jsc.hadoopConfiguration())
    have: dict[int, list[int]] = {}
    for s in fs.globStatus(at(f"{target}/bucket=*/batch=*")) or []:
        p = s.getPath()
        have.setdefault(int(p.getParent().getName()[7:]), []).append(int(p.getName()[6:]))
    return fs, at, have


def latest(spark: SparkSession, target: str, schema_: str) -> DataFrame:
    """The rows that ``keep_latest`` keeps."""
    _, _, have = _buckets(spark, target)
    paths = [f"{target}/bucket={b}/batch={max(v)}" for b, v in have.items()]
    return spark.read.schema(schema_).parquet(*paths) if paths else spark.createDataFrame([], schema_)


def recalled(stream: DataFrame, recall: Callable[[DataFrame], DataFrame], target: str, errors: str, checkpoint: str) -> StreamingQuery:
    """Recalls each micro-batch of (query_id, query) against static memory; a batch that fails goes to the error folder and doesn't stop the stream."""

    def run(batch: DataFrame, n: int) -> None:
        try:
            recall(batch).write.mode("overwrite").parquet(f"{target}/batch={n}")
        except Exception as e:
            batch.withColumn("error", F.lit(str(e)[:500])).write.mode("overwrite").parquet(f"{errors}/batch={n}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reindexed(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Edited files (file, text) to code records, a folder for each micro-batch."""
    from ..operators import code_index

    def run(batch: DataFrame, n: int) -> None:
        code_index.records(code_index.files(batch.dropDuplicates(["file"]))).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
