"""Memory and retrieval as collections in a folder: the write paths with what they invalidate, and the whole flows of recall and ask, for batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import config, schema, session
from .functions import text as T
from .operators import answer, cache, chunking, code_index, common, dense, fusion, lexical, memory, store
from .plans import recall
from .sources import files


class QueryCache:
    """Answers by query: exact text first, then the nearest vector; what is older than the policy's TTL, or of another scope, isn't there."""

    def __init__(self, spark: SparkSession, path: str, policy: config.CachePolicy) -> None:
        self.table, self.policy = store.Collection(spark, path, schema.CACHE), policy

    def clear(self) -> None:
        if self.table.version and not self.table.read().isEmpty():
            self.table.clear()

    def hits(self, queries: DataFrame, scope: str, now: str) -> DataFrame:
        """(query_id, payload) of the queries that have an entry."""
        entries = self.table.read().where(F.col("scope") == scope)
        asked = queries.select("query_id", "query", F.lit(scope).alias("scope"))
        exact = cache.probe_exact(asked, entries, now, self.policy).select("query_id", "payload")
        rest = asked.join(exact, "query_id", "left_anti")
        vectors = dense.hashed_vectors(rest, "query_id", "query").select(F.col("id").alias("query_id"), "vector")
        near = cache.probe_semantic(vectors, entries, now, self.policy)
        return exact.unionByName(near.join(entries.select("entry_id", "payload"), "entry_id").select("query_id", "payload"))

    def put(self, queries: DataFrame, answers: DataFrame, scope: str, now: str) -> None:
        """Keeps ``answers`` (query_id and payload) under their queries."""
        norm = T.query_norm(F.col("query"))
        rows = answers.join(queries.select("query_id", "query"), "query_id")
        vectors = dense.hashed_vectors(rows, "query_id", "query").select(F.col("id").alias("query_id"), F.col("vector").alias("embedding"))
        made = rows.join(vectors, "query_id").select(F.xxhash64(norm, F.lit(scope)).alias("entry_id"), norm.alias("query_norm"), F.lit(scope).alias("scope"), "embedding", F.lit(now).cast("timestamp").alias("created_at"), "payload")
        made = made.persist()
        if not made.isEmpty():
            self.table.upsert(made.dropDuplicates(["entry_id"]), "entry_id")
        made.unpersist()


class MemoryEngine:
    """Records, their index and the cache of verdicts. A write that changes something empties the cache and makes the next recall build the index anew."""

    VERDICT = "score double, mode string, suggestion string, conflict boolean, top_similarity double, mean_similarity double, source_count double, agreement double, recency double, authority double, n_evidence long, context string, tokens long, used long, truncated boolean"

    def __init__(self, spark: SparkSession, path: str, now: str = config.NOW) -> None:
        self.spark, self.now = spark, now
        self.records = store.Collection(spark, f"{path}/records", schema.MEMORY + ", indexed string, version long, seq long")
        self.verdicts = QueryCache(spark, f"{path}/verdicts", config.VERDICTS)
        self.records.on_write(self.verdicts.clear)

    def _add(self, made: DataFrame) -> None:
        made = made.withColumn("indexed", T.index_text(F.col("subject"), F.col("text"))).withColumn("metadata", F.lit(None).cast("map<string,string>"))
        # what is said again in the same words stays active
        old = made.where("supersedes is not null").select(F.col("supersedes").alias("record_id")).distinct().join(made.select("record_id"), "record_id", "left_anti")
        gone = self.records.read().join(old, "record_id", "left_semi").withColumn("status", F.lit("superseded")).drop("version", "seq")
        self.records.upsert(gone.unionByName(made), "record_id")

    def remember(self, rows: DataFrame) -> DataFrame:
        """Adds (text, kind, subject?, tags?, source?, authority?, supersedes?); gives the records. What they supersede stays, with that status."""
        made = memory.remember(rows, self.now).persist()
        if not made.isEmpty():
            self._add(made)
        return made

    def remember_latest(self, rows: DataFrame) -> DataFrame:
        """As ``remember``, superseding the active episode of the same subject that was learned before."""
        auto = (F.col("status") == "active") & (F.col("kind") == "episode") & F.array_contains("tags", "auto")
        before = memory.keep_latest(self.records.read().where(auto).select("subject", "seq", "record_id"), "subject", ["seq"]).select("subject", F.col("record_id").alias("supersedes"))
        return self.remember(rows.join(before, "subject", "left"))

    def forget(self, ids: DataFrame) -> int:
        return self.records.delete(ids, "record_id")

    def get(self, record_id: int) -> Row | None:
        return self.records.get(record_id, "record_id")

    def stats(self) -> DataFrame:
        return memory.stats(self.records.read())

    def index(self) -> lexical.Index:
        return lexical.kept(self.records, "record_id", "indexed", ("status", "kind"), vectors=True)

    def recall(self, queries: DataFrame, options: recall.Options | None = None, use_cache: bool = True) -> DataFrame:
        """A verdict for every query (query_id, query), ``cached`` or new; new direct and cautious ones are kept."""
        options = options or recall.Options(now=self.now)
        cols = ["query_id", *(c.split()[0] for c in self.VERDICT.split(", ")), "cached"]
        had = None
        asked = queries.select("query_id", "query")
        if use_cache and self.verdicts.table.version:
            had = cache.hits(self.verdicts.hits(asked, options.scope, self.now), self.VERDICT).persist()
            asked = asked.join(had, "query_id", "left_anti")
        got = recall.answer(asked, self.records.read(), options, self.index()).withColumn("cached", F.lit(False)).persist()
        if use_cache:
            keep = cache.writable(got.drop("cached"))
            self.verdicts.put(asked, keep.select("query_id", cache.payload(keep).alias("payload")), options.scope, self.now)
        return got.select(*cols) if had is None else got.select(*cols).unionByName(had.select(*cols))

    def session_start(self, summary: str | None = None) -> str:
        """A session's briefing; a compaction's summary is kept as a candidate episode first."""
        if summary:
            row = [("Summary of a compacted session, to be confirmed: " + summary[:4000], "episode", "compact-summary", ["compact", "candidate", "auto"])]
            rows = self.spark.createDataFrame(row, "text string, kind string, subject string, tags array<string>")
            self.remember_latest(rows.withColumn("text", F.substring(T.redact(F.col("text")), 1, 2000)))
        return memory.briefing(self.records.read())


class RagEngine:
    """Chunked documents, their index and the cache of answers."""

    ANSWER = "answer string, citations array<struct<position:long,marker:long,chunk_id:long,snippet:string>>"

    def __init__(self, spark: SparkSession, path: str, llm: Callable[[str], str] | None = None, cfg: config.RetrievalConfig = config.RetrievalConfig(), now: str = config.NOW) -> None:
        self.spark, self.llm, self.cfg, self.now = spark, llm, cfg, now
        self.chunks = store.Collection(spark, f"{path}/chunks", schema.PASSAGE)
        self.answers = QueryCache(spark, f"{path}/answers", config.ANSWERS)
        self.chunks.on_write(self.answers.clear)

    def ingest(self, docs: DataFrame, how: str = "recursive") -> dict[str, int]:
        """Chunks and adds (doc_id, text, source); a document that is there already is replaced chunk by chunk."""
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
        made = chunking.chunk(docs, how).withColumnRenamed("seq", "pos").join(docs.select("doc_id", "source"), "doc_id")
        made = made.select(F.xxhash64("doc_id", "pos").alias("chunk_id"), "doc_id", "pos", "text", "heading", "source").persist()
        n = made.count()
        if n:
            self.chunks.upsert(made)
        made.unpersist()
        return {"documents": docs.count(), "chunks": n}

    def clear(self) -> None:
        self.chunks.clear()

    def stats(self) -> dict[str, object]:
        """The number of chunks, and what retrieval is set to."""
        return {"chunks": self.chunks.count(), "generator": self.llm is not None} | self.cfg.__dict__

    def search(self, queries: DataFrame, top_k: int | None = None, filters: dict | None = None) -> DataFrame:
        """Ranked chunks of each query, with doc_id, source and text."""
        index = lexical.kept(self.chunks, carry=("doc_id", "source"), vectors=True)
        asked = dense.hashed_vectors(queries, "query_id", "query").select(F.col("id").alias("query_id"), "vector")
        found = fusion.retrieve(dense.search(asked, index.rows, self.cfg.k_dense, "chunk_id", "vector", filters), lexical.search(queries, index, self.cfg.k_bm25, filters=filters), self.cfg, top_k)
        return self.chunks.read().select("chunk_id", "doc_id", "source", "text").join(common.small(found.persist()), "chunk_id")

    def ask(self, queries: DataFrame, top_k: int | None = None, filters: dict | None = None, use_cache: bool = True) -> DataFrame:
        """(query_id, answer, citations, cached) for (query_id, query, history?). A query with a history is neither looked up nor kept; without sources the answer is fixed and isn't kept. Without a generator, what the cache lacks is an error."""
        told = F.col("history").isNotNull() & (F.col("history") != "") if "history" in queries.columns else F.lit(False)
        asked = queries.select("query_id", "query", (F.col("history") if "history" in queries.columns else F.lit(None).cast("string")).alias("history"), told.alias("told"))
        scope = f"{top_k or self.cfg.top_k}/{sorted((filters or {}).items())}"
        had, cols = None, ["query_id", "answer", "citations", "cached"]
        if use_cache and self.answers.table.version:
            had = cache.hits(self.answers.hits(asked.where("not told"), scope, self.now), self.ANSWER).persist()
            asked = asked.join(had, "query_id", "left_anti")
            if self.llm is None and asked.isEmpty():
                return had.select(*cols)
        if self.llm is None:
            raise ValueError("no generator is configured")
        ranked = self.search(asked, top_k, filters).persist()
        prompts = asked.join(answer.sources(ranked), "query_id", "left").select("query_id", "query", "told", F.coalesce(F.concat(F.coalesce(F.concat("history", F.lit("\n\n")), F.lit("")), "sources", F.lit("\n\nQuestion: "), "query"), F.lit("")).alias("sources"))
        said = answer.generate(prompts, self.llm).persist()
        cites = answer.citations(said, ranked).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "marker", "chunk_id", "snippet"))).alias("citations"))
        none = F.array().cast("array<struct<position:long,marker:long,chunk_id:long,snippet:string>>")
        out = said.join(cites, "query_id", "left").withColumn("citations", F.coalesce("citations", none)).withColumn("cached", F.lit(False)).persist()
        if use_cache:
            keep = out.where((F.col("sources") != "") & ~F.col("told")).select("query_id", "answer", "citations")
            self.answers.put(asked, keep.select("query_id", cache.payload(keep).alias("payload")), scope, self.now)
        return out.select(*cols) if had is None else out.select(*cols).unionByName(had.select(*cols))


def bootstrap(mem: MemoryEngine, rag: RagEngine, root: str) -> dict[str, object]:
    """A project taken in: its code as records, its documents redacted and chunked, inferred facts in place of older ones, an episode, and two recalls to see that it works."""
    spark, at = mem.spark, f"file://{Path(root).resolve()}"
    code = code_index.records(code_index.files(files.code_files(spark, at))).select("text", "kind", "subject", "tags", "source", "authority").persist()
    old = mem.records.read().where((F.col("kind") == "code") | F.array_contains("tags", "inferred")).select("record_id")
    mem.forget(old)
    mem.remember(code)
    found = session.facts(spark, root)
    if found:
        mem.remember(session.fact_rows(spark, found).withColumn("authority", F.lit(0.5)).withColumn("tags", F.array(F.lit("inferred"))))
    mem.remember(session.episode(spark, found))
    names = files.doc_files(spark.createDataFrame([(str(p.relative_to(Path(root).resolve())),) for p in Path(root).resolve().rglob("*") if p.is_file()] or [("",)], "file string")).where(~T.sensitive_path(F.col("file")))
    docs = [(r["file"], (Path(root) / r["file"]).read_text("utf-8-sig", errors="replace")) for r in names.collect()]
    took = rag.ingest(spark.createDataFrame(docs, "doc_id string, text string").select("doc_id", T.redact(F.col("text")).alias("text"), F.col("doc_id").alias("source"))) if docs else {"documents": 0, "chunks": 0}
    asked = spark.createDataFrame([(0, "what is this project"), (1, "which languages and entry points does it have")], "query_id long, query string")
    smoke = {r["query_id"]: r["mode"] for r in mem.recall(asked, use_cache=False).select("query_id", "mode").collect()}
    return {"code_records": code.count(), "facts": len(found), "smoke": smoke} | took


def events(answers: DataFrame) -> DataFrame:
    """(query_id, n, type, text): the stream of a finished answer, one delta with all of its text, then the answer itself."""
    one = lambda n, kind: F.struct(F.lit(n).cast("long").alias("n"), F.lit(kind).alias("type"), F.col("answer").alias("text"))
    return answers.select("query_id", F.explode(F.array(one(0, "delta"), one(1, "answer"))).alias("e")).select("query_id", "e.*")


def usage(rows: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Rows and estimated tokens by a column, with the share of all tokens."""
    got = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(T.token_estimate(T.text_or_empty(F.col(text)))).alias("tokens"))
    return got.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))
