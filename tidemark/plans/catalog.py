"""The catalogue: every query runs over its whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import answer, cache, chunking, code_index, common, confidence, dense, evaluation, fusion, lexical, memory, packing, scan, store
from ..sources import files
from ..streaming import events
from .. import engine
from . import recall, samples
from . import sql as S

#: Files below this size have too few row groups for the cores that read them.
SPREAD_BYTES = 64 << 20
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (table reader) under its name, with its SQL."""

    def add(fn: Callable) -> Callable:
        _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        """A table; a text table too small to fill the cores with its row groups is spread over them."""
        at = f"{self.dir}/{name}.parquet"
        df = self.spark.read.parquet(at)
        if name in ("documents", "pages"):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            size = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
            cores = self.spark.sparkContext.defaultParallelism
            if 1 << 19 < size < SPREAD_BYTES:
                df = df.repartition(cores)
        return df

    def asked(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    def memory(self) -> DataFrame:
        return memory.from_documents(self.documents, self.labels)

    def chunks(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source", "n_chars")

    @functools.cached_property
    def index(self) -> lexical.Index:
        """Terms and hashed vectors of the documents: their texts are tokenised once for a query."""
        return lexical.index(self.chunks(), carry=("lang", "source"), vectors=True)

    def lexical(self, k: int = 24, filters: dict | None = None) -> DataFrame:
        return lexical.search(self.asked(), self.index, k, filters=filters)

    def hashed(self, k: int = 24) -> DataFrame:
        q = dense.hashed_vectors(self.asked(), "query_id", "query").select(F.col("id").alias("query_id"), "vector")
        return dense.search(q, self.index.rows, k, "chunk_id", "vector")

    def vector_queries(self) -> DataFrame:
        return self.embeddings.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))

    def evidence(self) -> DataFrame:
        return recall.evidence(self.asked(), self.memory())

    def signals(self) -> DataFrame:
        return confidence.signals(self.asked(), self.evidence())

    def relevant(self) -> DataFrame:
        return scan.containing(self.documents, self.benchmark)

    def code(self) -> DataFrame:
        return samples.code(self.documents)


# Text functions


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({S.tok('text')}) AS token FROM documents) GROUP BY token")
def tokenize_terms(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT doc_id, greatest(1, (length(text) + 3) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"WITH {S.MEM} SELECT record_id, CASE WHEN age < 1 THEN 'today' WHEN age < 60 THEN age::BIGINT || 'd' ELSE (age::BIGINT // 30) || 'mo' END AS label FROM mem")
def age_label(t: Tables) -> DataFrame:
    return t.memory().select("record_id", T.age_label(T.age_days(F.col("updated_at"), config.NOW)).alias("label"))


@query(r"SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS query_norm FROM benchmark")
def query_norm(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", T.query_norm(F.col("text")).alias("query_norm"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def text_hash16(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.hash16(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, md5({S.redacted('text')}) AS digest, {S.redacted('text')} <> text AS altered FROM documents")
def redact_secrets(t: Tables) -> DataFrame:
    r = t.documents.select("doc_id", "text", T.redact(F.col("text")).alias("r"))
    return r.select("doc_id", F.md5(F.col("r").cast("binary")).alias("digest"), (F.col("r") != F.col("text")).alias("altered"))


@query(f"SELECT doc_id, ({S.SECRET}) AS secret FROM documents")
def secret_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.contains_secret(F.col("text")).alias("secret"))


@query(
    f"WITH t AS (SELECT doc_id, list_distinct({S.tok('text')}) AS t FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END, 6) AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1"
)
def jaccard_pairs(t: Tables) -> DataFrame:
    a = t.documents.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


# Lexical and dense search


@query(f"WITH t AS (SELECT doc_id, {S.tok('text')} AS t FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM t) SELECT token, df, round(ln(1.0::DOUBLE + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM t) GROUP BY token), n")
def bm25_term_stats(t: Tables) -> DataFrame:
    return lexical.term_stats(t.documents, "doc_id")


@query(f"SELECT doc_id AS chunk_id, len({S.tok('text')})::BIGINT AS dl, len(list_distinct({S.tok('text')}))::BIGINT AS n_terms FROM documents")
def bm25_doc_stats(t: Tables) -> DataFrame:
    return lexical.doc_stats(t.documents, "doc_id")


@query(f"WITH {S.bm25('documents', 'doc_id', 'text', k=10)} SELECT query_id, chunk_id, score, rank, 'bm25' AS origin FROM lex")
def bm25_topk(t: Tables) -> DataFrame:
    return t.lexical(10)


_FILTER = {"lang": "en", "source": ["src0", "src1", "src2", "src3", None]}


@query(f"""WITH {S.bm25('documents', 'doc_id', 'text', "lang IS NOT DISTINCT FROM 'en' AND (coalesce(source IN ('src0', 'src1', 'src2', 'src3'), false) OR source IS NULL)", 10)} SELECT query_id, chunk_id, score, rank, 'bm25' AS origin FROM lex""")
def bm25_topk_filtered(t: Tables) -> DataFrame:
    return t.lexical(10, _FILTER)


def _dense_sql(keep: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {keep}),
s AS (SELECT query_id, chunk_id, round(list_cosine_similarity(q.v, d.v), 6) + 0.0 AS score FROM q, d), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, score, rank, 'dense' AS origin FROM r WHERE rank <= 24"""


@query(_dense_sql("true"))
def dense_topk(t: Tables) -> DataFrame:
    return dense.search(t.vector_queries(), t.embeddings, 24)


@query(_dense_sql("label IN (1, 3)"))
def dense_topk_filtered(t: Tables) -> DataFrame:
    return dense.search(t.vector_queries(), t.embeddings, 24, filters={"label": [1, 3]})


@query("SELECT vec_id, i - 1 AS pos, round(v[i] / n, 6) + 0.0 AS x FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))")
def l2_normalize(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode(dense.normalized(F.col("embedding"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@query(f"WITH {S.hashed('h', 'documents', 'doc_id', 'text')} SELECT id, dim::BIGINT AS dim, val FROM h")
def hashed_embedding(t: Tables) -> DataFrame:
    return dense.hashed_terms(t.documents, "doc_id", "text").select("id", F.col("dim").cast("long").alias("dim"), "val")


@query(f"WITH {S.hashed_top('documents', 'doc_id', 'text')} SELECT query_id, chunk_id, score, rank, 'dense' AS origin FROM den")
def hashed_dense_topk(t: Tables) -> DataFrame:
    return t.hashed()


_BOTH = f"{S.bm25('documents', 'doc_id', 'text')}, {S.hashed_top('documents', 'doc_id', 'text')}"


@query(f"WITH {_BOTH}, {S.rrf(24)}")
def rrf_fuse(t: Tables) -> DataFrame:
    return fusion.fused([t.hashed(), t.lexical()], 24)


@query(f"WITH {_BOTH}, {S.rrf(24, 0.3, 1.7)}")
def rrf_weighted(t: Tables) -> DataFrame:
    return fusion.fused([t.hashed(), t.lexical()], 24, weights=[0.3, 1.7])


@query(f"WITH {_BOTH}, {S.rrf(6)}")
def retrieve_hybrid(t: Tables) -> DataFrame:
    return fusion.retrieve(t.hashed(), t.lexical())


@query(f"WITH {_BOTH}, {S.rrf(5, cut=20)}")
def vector_memory_recall(t: Tables) -> DataFrame:
    return fusion.vector_memory(t.hashed(), t.lexical())


# Memory


@query(f"WITH {S.MEM} SELECT record_id, kind, subject, source, authority, status, age FROM mem")
def memory_records(t: Tables) -> DataFrame:
    return t.memory().select("record_id", "kind", "subject", "source", "authority", "status", T.age_days(F.col("updated_at"), config.NOW).alias("age"))


@query(f"WITH {S.MEM} SELECT record_id, subject FROM mem WHERE kind = 'decision' AND status = 'active'")
def memory_list_active(t: Tables) -> DataFrame:
    return memory.listed(t.memory(), "decision").select("record_id", "subject")


@query(f"WITH {S.MEM} SELECT k.kind, count(*) FILTER (WHERE status = 'active') AS n_active, count(mem.kind) AS n_total FROM (VALUES ('fact'), ('decision'), ('episode'), ('code')) k(kind) LEFT JOIN mem ON mem.kind = k.kind GROUP BY k.kind")
def memory_stats(t: Tables) -> DataFrame:
    return memory.stats(t.memory())


@query(f"WITH {S.MEM}, l AS (SELECT subject, max(record_id) AS last FROM mem WHERE status = 'active' GROUP BY subject) SELECT record_id, mem.subject, CASE WHEN status = 'active' AND record_id <> last THEN 'superseded' ELSE status END AS status FROM mem LEFT JOIN l ON l.subject = mem.subject")
def supersede_latest(t: Tables) -> DataFrame:
    m = t.memory().select("record_id", "subject", "status", "kind")
    last = memory.keep_latest(memory.listed(m), "subject", ["record_id"]).select("subject", F.col("record_id").alias("last"))
    old = (F.col("status") == "active") & (F.col("record_id") != F.col("last"))
    return m.join(last, "subject", "left").select("record_id", "subject", F.when(old, "superseded").otherwise(F.col("status")).alias("status"))


@query(f"WITH {S.EVIDENCE} SELECT query_id, record_id, similarity, rank, in_dense, in_bm25 FROM ev")
def memory_recall(t: Tables) -> DataFrame:
    return t.evidence().select("query_id", "record_id", "similarity", "rank", "in_dense", "in_bm25")


_SIX = ("top_similarity", "top"), ("mean_similarity", "mean"), ("source_count", "sources"), ("agreement", "agree"), ("recency", "recent"), ("authority", "auth")


@query(f"WITH {S.SIGNALS} SELECT query_id, score, conflict, coalesce(n_evidence, 0) AS n_evidence, " + ", ".join(f"coalesce(round({c}, 4), 0) AS {n}" for n, c in _SIX) + " FROM s1")
def confidence_signals(t: Tables) -> DataFrame:
    return t.signals().select("query_id", "score", "conflict", "n_evidence", *(n for n, _ in _SIX))


@query(f"WITH {S.EVIDENCE}, {S.CLASH} SELECT query_id, subject FROM clash")
def conflict_subjects(t: Tables) -> DataFrame:
    return confidence.conflicts(t.evidence())


@query(f"WITH {S.SIGNALS} SELECT query_id, score, {S.MODE} AS mode FROM s1")
def answer_mode(t: Tables) -> DataFrame:
    return t.signals().select("query_id", "score", "mode")


_SAID = """unnest(list_filter([CASE WHEN coalesce(n_evidence, 0) = 0 THEN 'no evidence in memory' ELSE 'best similarity ' || printf('%.2f', coalesce(round(top, 4), 0)) || ' among ' || n_evidence || ' entries' END,
  CASE WHEN n_evidence > 0 THEN 'source signal ' || printf('%.2f', coalesce(round(sources, 4), 0)) || ', retrievers agree ' || printf('%.2f', coalesce(round(agree, 4), 0)) END,
  CASE WHEN n_evidence > 0 THEN 'recency ' || printf('%.2f', coalesce(round(recent, 4), 0)) || ', authority ' || printf('%.2f', coalesce(round(auth, 4), 0)) END,
  CASE WHEN conflict THEN 'contradicting entries about ' || subjects END], lambda x: x IS NOT NULL)) AS said"""


@query(f"WITH {S.SIGNALS}, l AS (SELECT query_id, {_SAID} FROM s1 LEFT JOIN (SELECT query_id, string_agg(subject, ', ' ORDER BY subject) AS subjects FROM clash GROUP BY query_id) USING (query_id)) SELECT query_id, said FROM l")
def confidence_rationale(t: Tables) -> DataFrame:
    s = t.signals()
    return s.select("query_id", F.explode(confidence.rationale(s)).alias("said"))


@query(f"WITH RECURSIVE {S.EVIDENCE}, {S.PACKED} SELECT * FROM packed")
def packed_context(t: Tables) -> DataFrame:
    return packing.pack(t.evidence())


_VERDICT = f"""WITH RECURSIVE {S.SIGNALS}, {S.PACKED}, verdict AS (SELECT query_id, score, {S.MODE} AS mode, conflict, coalesce(n_evidence, 0) AS n_evidence, {", ".join(f"coalesce(round({c}, 4), 0) AS {n}" for n, c in _SIX)},
  coalesce(context, '') AS context, coalesce(tokens, 0) AS tokens, coalesce(used, 0) AS used, coalesce(truncated, false) AS truncated FROM s1 LEFT JOIN packed USING (query_id))"""


@query(f"{_VERDICT} SELECT *, {S.SUGGESTION} AS suggestion FROM verdict")
def recall_answer(t: Tables) -> DataFrame:
    return recall.answer(t.asked(), t.memory())


@query(f"{_VERDICT} SELECT query_id, mode, score AS confidence, {S.SUGGESTION} AS suggestion, context, tokens, false AS cached, top_similarity, mean_similarity, source_count, agreement, recency, authority, conflict FROM verdict")
def recall_payload(t: Tables) -> DataFrame:
    return recall.payload(recall.answer(t.asked(), t.memory())).select("query_id", "payload.*").select("*", "signals.*").drop("signals")


@query(f"WITH RECURSIVE benchmark AS (SELECT item_id, {S.SEARCH_WORDS} AS text FROM main.benchmark), {_VERDICT[len('WITH RECURSIVE '):]} SELECT query_id, 'deny' AS decision, 'Memory holds this already:' || chr(10) || substr(context, 1, 1500) AS reason FROM verdict WHERE mode = 'direct'")
def search_redirects(t: Tables) -> DataFrame:
    tools = t.spark.createDataFrame([("Grep",), ("Read",)], "tool string")
    calls = t.benchmark.crossJoin(F.broadcast(tools)).select(F.col("item_id").alias("query_id"), "tool", F.col("text").alias("pattern"))  # two rows
    return events.redirected(calls, lambda asked: recall.answer(asked, t.memory()))


@query(f"WITH {S.MEM} SELECT record_id, kind, subject, status FROM mem WHERE record_id = 17")
def record_lookup(t: Tables) -> DataFrame:
    return memory.get(t.memory(), 17).select("record_id", "kind", "subject", "status")


@query(f"""WITH {S.MEM}, d AS (SELECT subject, max(record_id) AS last FROM mem WHERE kind = 'decision' AND status = 'active' GROUP BY subject)
SELECT record_id, subject, CASE WHEN last IS NOT NULL THEN 'superseded' ELSE status END AS status, NULL::BIGINT AS supersedes FROM mem LEFT JOIN (SELECT last FROM d) ON last = record_id UNION ALL SELECT -last, subject, 'active', last FROM d""")
def supersede_links(t: Tables) -> DataFrame:
    """Each subject's last decision is superseded by a new one."""
    m = t.memory().select("record_id", "subject", "kind", "status", "supersedes")
    last = memory.keep_latest(memory.listed(m, "decision").select("subject", "record_id"), "subject", ["record_id"])
    new = last.select((-F.col("record_id")).alias("record_id"), "subject", F.lit("decision").alias("kind"), F.lit("active").alias("status"), F.col("record_id").alias("supersedes"))
    return memory.supersede(m, new).select("record_id", "subject", "status", "supersedes")


@query("SELECT role, count(*) AS n, sum(greatest(1, (length(text) + 3) // 4))::BIGINT AS tokens, round(sum(greatest(1, (length(text) + 3) // 4))::DOUBLE / sum(sum(greatest(1, (length(text) + 3) // 4))) OVER (), 6) AS share FROM conversations GROUP BY role")
def usage_totals(t: Tables) -> DataFrame:
    return engine.usage(t.conversations, "role")


@query(f"WITH {S.MEM} SELECT record_id, subject, substr(text, 1, 220) AS text FROM mem WHERE kind = 'decision' AND status = 'active' ORDER BY age, record_id LIMIT 8")
def recent_decisions(t: Tables) -> DataFrame:
    return memory.recent_decisions(t.memory()).select("record_id", "subject", "text")


# Store and caches


@query("SELECT doc_id AS chunk_id, CASE WHEN lang = 'en' THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN lang = 'en' THEN upper(source) ELSE source END AS source, doc_id AS seq FROM documents")
def upsert_latest(t: Tables) -> DataFrame:
    old = t.chunks().select("chunk_id", F.lit(1).cast("long").alias("version"), "source", F.col("chunk_id").alias("seq"))
    new = t.chunks().where("lang = 'en'").select("chunk_id", F.lit(2).cast("long").alias("version"), F.upper("source").alias("source"))
    return store.upsert(old, new)


@query("SELECT doc_id AS chunk_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_ids(t: Tables) -> DataFrame:
    return store.delete(t.chunks().select("chunk_id", "source"), t.labels.where("toxic = 1").select(F.col("doc_id").alias("chunk_id")))[0]


@query("SELECT DISTINCT 'blake:hash-256:doc:' || sha256(text) AS key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
def embedding_cache_missing(t: Tables) -> DataFrame:
    have = t.documents.where("lang = 'en'").select(store.cache_key(F.col("text"), "blake", "hash-256").alias("key"))
    return store.missing(t.documents, have).select("key")


@query(rf"""WITH e AS (SELECT item_id AS entry_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k, item_id % 12 <= 7 AS fresh FROM benchmark)
SELECT b.item_id AS query_id, min(e.entry_id) AS entry_id FROM benchmark b JOIN e ON e.fresh AND e.k = trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')) GROUP BY b.item_id""")
def verdict_cache_exact(t: Tables) -> DataFrame:
    at = F.lit(config.NOW).cast("timestamp") - F.make_dt_interval((F.col("item_id") % 12).cast("int"))
    entries = t.benchmark.select(F.col("item_id").alias("entry_id"), T.query_norm(F.col("text")).alias("query_norm"), F.lit("").alias("scope"), at.alias("created_at"), F.lit("{}").alias("payload"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.lit("  "), F.regexp_replace("text", " ", "  ")).alias("query"), F.lit("").alias("scope"))
    return cache.probe_exact(asked, entries).select("query_id", "entry_id")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT vec_id AS entry_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label < 5),
s AS (SELECT query_id, entry_id, round(list_cosine_similarity(q.v, d.v), 6) + 0.0 AS similarity FROM q, d), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS n FROM s)
SELECT query_id, entry_id, similarity FROM r WHERE n = 1 AND similarity >= 0.9""")
def verdict_cache_semantic(t: Tables) -> DataFrame:
    entries = t.embeddings.where("label < 5").select(F.col("vec_id").alias("entry_id"), "embedding", F.lit(config.NOW).cast("timestamp").alias("created_at"))
    return cache.probe_semantic(t.vector_queries(), entries)


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts >= {S.NOW_TS} - INTERVAL 3 DAY GROUP BY event_type")
def answer_cache_ttl(t: Tables) -> DataFrame:
    return events.counters(events.unexpired(t.events, ttl_days=config.ANSWERS.ttl_days))


@query(f"WITH {S.SIGNALS}, m AS (SELECT query_id, {S.MODE} AS mode FROM s1) SELECT query_id, mode FROM m WHERE mode IN ('direct', 'cautious')")
def cache_writes(t: Tables) -> DataFrame:
    return cache.writable(t.signals()).select("query_id", "mode")


# Chunking, sources, answers


@query()
def chunk_recursive(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents, "recursive")


@query()
def chunk_markdown(t: Tables) -> DataFrame:
    heading = t.documents.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), F.lit("## "), "lang", F.lit("\n"), "text").alias("text"))
    return chunking.chunk(heading, "markdown")


@query(f"""WITH {S.CODE}, c AS (SELECT file, unnest(CASE lang WHEN 'en' THEN ['import ' || source || repeat(chr(10), 3) || '@app.get("/doc/' || doc_id || '")', 'def read_' || doc_id || '():' || chr(10) || '    return ' || n_chars, 'class Doc' || doc_id || substr(text, strpos(text, 'class Doc') + 9 + length(doc_id::VARCHAR))]
  WHEN 'de' THEN [split_part(text, chr(10), 1) || chr(10) || split_part(text, chr(10), 2), substr(text, strpos(text, 'function '))] WHEN 'fr' THEN [split_part(text, chr(10), 1), split_part(text, chr(10), 2)] ELSE [split_part(text, chr(10), 1), substr(text, strpos(text, 'func '))] END) AS text, unnest(range(3)) AS seq FROM code)
SELECT file AS doc_id, seq, regexp_replace(text, '\\s+$', '') AS text, NULL::VARCHAR AS heading FROM c WHERE text IS NOT NULL""")
def chunk_code(t: Tables) -> DataFrame:
    return chunking.chunk(t.code().select(F.col("file").alias("doc_id"), "text"), "code", 600, 20)


@query()
def chunk_dispatch(t: Tables) -> DataFrame:
    how = chunking.kind_of(F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".py").otherwise(".txt"))
    return chunking.chunk(t.documents, how)


_PLAIN = "p"
for _name, _is in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_is}')"


_HIDDEN = r"(?s)<!--.*?-->|<(head|script|style|noscript)\b[^>]*>.*?</(head|script|style|noscript)>"
_TRIMMED = r"^\s+|\s+$"


@query(
    f"""WITH t AS (SELECT page_id, regexp_split_to_array(regexp_replace(coalesce(html, ''), '{_HIDDEN}', '<x>', 'g'), '<[^>]*>') AS parts FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(parts, lambda p: regexp_replace(regexp_replace({_PLAIN}, '&amp;?', '&', 'g'), '{_TRIMMED}', '', 'g')), lambda p: p <> ''), chr(10)) AS text FROM t"""
)
def html_text(t: Tables) -> DataFrame:
    common.small_batches(t.spark)
    return t.pages.select("page_id", files.html_text(F.col("html")).alias("text"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def conversation_window(t: Tables) -> DataFrame:
    return memory.window(t.conversations).select("conv_id", "turn", "role", "text")


def _ranked_text(t: Tables) -> DataFrame:
    return common.small(t.lexical(6)).join(t.chunks(), "chunk_id")


_RANKED = f"WITH {S.bm25('documents', 'doc_id', 'text', k=6)}, r AS (SELECT query_id, chunk_id, rank, text, source FROM lex JOIN documents ON doc_id = chunk_id)"


@query(f"{_RANKED} SELECT query_id, count(*) AS n_sources, string_agg('[' || rank || ']' || CASE WHEN coalesce(source, '') <> '' THEN ' — ' || source ELSE '' END || chr(10) || substr(text, 1, 2000), chr(10) || chr(10) ORDER BY rank) AS sources FROM r GROUP BY query_id")
def format_sources(t: Tables) -> DataFrame:
    return answer.sources(_ranked_text(t))


@query(f"{_RANKED} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS position, rank AS marker, chunk_id, substr(text, 1, 200) AS snippet FROM r JOIN (VALUES (1, 2), (2, 1), (3, 5)) v(p, m) ON rank = m")
def parse_citations(t: Tables) -> DataFrame:
    said = t.asked().select("query_id", F.lit("As [2] says, and [1], but not [9]; see [2] again and [5].").alias("answer"))
    return answer.citations(said, _ranked_text(t))


# Code


@query(f"WITH {S.CODE} SELECT file, CASE lang WHEN 'en' THEN 'unchanged' WHEN 'de' THEN 'changed' ELSE 'new' END AS state FROM code UNION ALL SELECT 'gone/' || doc_id || '.go', 'removed' FROM code WHERE lang = 'es'")
def code_diff(t: Tables) -> DataFrame:
    now = t.code()
    stored = now.where("lang in ('en', 'de')").select("file", F.when(F.col("lang") == "en", T.hash16(F.col("text"))).otherwise("0" * 16).alias("file_hash"))
    gone = now.where("lang = 'es'").select(F.concat(F.lit("gone/"), "doc_id", F.lit(".go")).alias("file"), F.lit("1" * 16).alias("file_hash"))
    return code_index.diff(code_index.files(now), stored.unionByName(gone))


@query(f"WITH {S.CODE} SELECT file, CASE lang WHEN 'fr' THEN 'std::fr' ELSE source END AS imported FROM code WHERE lang IN ('en', 'de', 'fr')")
def import_graph(t: Tables) -> DataFrame:
    return code_index.graph(code_index.files(t.code()))


@query(f"WITH {S.CODE} SELECT {S.LANGUAGE} AS language, count(*) AS n_files FROM code GROUP BY lang")
def language_mix(t: Tables) -> DataFrame:
    return code_index.language_mix(code_index.files(t.code()))


@query(f"WITH {S.CODE}, {S.SYMBOLS} SELECT file, symbol, symbol_type, line, route FROM sym")
def code_symbols(t: Tables) -> DataFrame:
    return code_index.symbols(code_index.files(t.code())).drop("snippet", "language")


@query(f"""WITH {S.CODE}, {S.SYMBOLS}, f AS (SELECT *, substr(sha256(text), 1, 16) AS file_hash, {S.LANGUAGE} AS language FROM code)
SELECT file, file_hash, language, 'file' AS symbol_type, file AS subject, file AS source, 'file' AS tags, 'code' AS kind, 0.7::DOUBLE AS authority,
  'file ' || file || ' (' || language || ', ' || n || ' symbols)' || chr(10) || 'imports: ' || CASE lang WHEN 'fr' THEN 'std::fr' WHEN 'en' THEN source WHEN 'de' THEN source ELSE '(none)' END || chr(10) || 'symbols: ' || names AS text
FROM f JOIN (SELECT file, count(*) AS n, string_agg(symbol, ', ' ORDER BY place) AS names FROM sym GROUP BY file) USING (file)
UNION ALL SELECT file, file_hash, language, symbol_type, file || '::' || symbol, file || ':' || line, symbol_type || CASE WHEN route IS NOT NULL THEN ',endpoint' ELSE '' END, 'code', 0.7::DOUBLE,
  symbol_type || ' ' || symbol || CASE WHEN route IS NOT NULL THEN ' [' || route || ']' ELSE '' END || ' — ' || file || ':' || line || chr(10) || snippet FROM sym JOIN f USING (file)""")
def code_records(t: Tables) -> DataFrame:
    return code_index.records(code_index.files(t.code())).withColumn("tags", F.array_join("tags", ","))


# Evaluation

_CASES = f"""WITH {S.bm25('documents', 'doc_id', 'text', k=10)}, rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id), h AS (SELECT lex.query_id, min(rank) AS first, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM lex JOIN rel ON rel.query_id = lex.query_id AND rel.doc_id = lex.chunk_id GROUP BY lex.query_id),
c AS (SELECT n.query_id, (first IS NOT NULL)::INT::DOUBLE AS hit, coalesce(round(1.0::DOUBLE / first, 6), 0) AS mrr, coalesce(round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6), 0) AS ndcg FROM n LEFT JOIN h USING (query_id))"""


def _per_case(t: Tables) -> DataFrame:
    return evaluation.per_case(t.asked(), t.lexical(10), t.relevant(), 10)


@query(f"{_CASES} SELECT query_id, hit FROM c")
def eval_hit(t: Tables) -> DataFrame:
    return _per_case(t).select("query_id", "hit")


@query(f"{_CASES} SELECT query_id, mrr FROM c")
def eval_mrr(t: Tables) -> DataFrame:
    return _per_case(t).select("query_id", "mrr")


@query(f"{_CASES} SELECT query_id, ndcg FROM c")
def eval_ndcg(t: Tables) -> DataFrame:
    return _per_case(t).select("query_id", "ndcg")


@query(f"{_CASES} SELECT (SELECT count(*) FROM benchmark) AS cases, 10::BIGINT AS k, coalesce(round(avg(hit), 6), 0) AS hit_rate, coalesce(round(avg(mrr), 6), 0) AS mrr, coalesce(round(avg(ndcg), 6), 0) AS ndcg FROM c")
def eval_report(t: Tables) -> DataFrame:
    return evaluation.report(t.asked(), t.lexical(10), t.relevant(), 10)


# Events


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def events_keep_latest(t: Tables) -> DataFrame:
    return memory.keep_latest(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def session_counters(t: Tables) -> DataFrame:
    return events.counters(t.events)


@query(rf"SELECT conv_id, turn, md5({S.redacted('text')}) AS digest FROM conversations WHERE role = 'user' AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 12 AND NOT starts_with(regexp_replace(text, '^\s+|\s+$', '', 'g'), '/')")
def inject_gate(t: Tables) -> DataFrame:
    return events.gate(t.conversations.where("role = 'user'"), "text").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("digest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
