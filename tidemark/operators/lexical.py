"""BM25 over a forward index, for a batch of queries in one job.

``index`` tokenises every chunk once: a row of term hashes (64 bits) with their counts and the chunk's
length, beside the columns that filters read, and on request its hashed vector. ``search`` takes an index (or makes one) and
never sees a text. Up to ``QUERY_TERMS`` query terms are broadcast: one pass over the index counts their
frequencies, a second scores each partition's chunks for all queries in numpy and passes on the
k best, so no (query, chunk) pair is shuffled. Beyond that, ``scores`` does it by joins. Statistics
cover all chunks, filters apply when scoring. Repeated query tokens count repeatedly.

``kept`` holds the index of a collection as a table beside it, by the collection's version, so a write makes the
next search build it anew and none in between does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import kernels
from ..functions import text as T
from . import common, store

#: (query, term) rows that are broadcast at most; more go by joins.
QUERY_TERMS = 50_000
DIM = 256


@dataclass
class Index:
    """``rows``: chunk_id, dl, terms (64-bit hashes), tfs (32-bit counts) and vector (floats, if made) as bytes, and carried columns."""

    rows: DataFrame
    n: int
    avgdl: float


def tokenized(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return chunks.select(F.col(id_col).alias("chunk_id"), T.tokens(F.col(text_col)).alias("toks"))


def idf(df: str, n: int):
    return F.log(1.0 + (F.lit(float(n)) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def doc_stats(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    return tokenized(chunks, id_col, text_col).select("chunk_id", F.size("toks").cast("long").alias("dl"), F.size(F.array_distinct("toks")).cast("long").alias("n_terms"))


def corpus(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> tuple[int, float]:
    """(chunks, mean length): one row of a partial aggregate."""
    r = tokenized(chunks, id_col, text_col).agg(F.count("*"), F.sum(F.size("toks").cast("long"))).first()
    return r[0], (r[1] / r[0] if r[0] and r[1] else 1.0)


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    t = tokenized(chunks, id_col, text_col)
    return t.select("chunk_id", F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("token")).groupBy("token", "chunk_id", "dl").agg(F.count("*").alias("tf"))


def term_stats(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(token, df, idf) with one count for each chunk that has the token."""
    n = chunks.count()
    one = tokenized(chunks, id_col, text_col).select(F.explode(F.array_distinct("toks")).alias("token"))
    return one.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.round(idf("df", n), 6))


def forward(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", carry: Sequence[str] = (), vectors: bool = False) -> DataFrame:
    """The rows of an index: one Arrow pass over the lower-cased texts."""
    common.small_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = kernels.Signs()
        for b in batches:
            for lo, hi, buf, offs in kernels.slices(b.column(1)):
                n = hi - lo
                h, s, e, d = kernels.tokens(buf, offs)
                edges = np.searchsorted(d, np.arange(n + 1))
                hs = h.copy()
                for i in np.flatnonzero(np.diff(edges) > 1):
                    hs[edges[i] : edges[i + 1]].sort()
                new = np.ones(len(hs), bool)
                new[1:] = (hs[1:] != hs[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(hs)))
                ends = np.searchsorted(at, edges)
                cols = [b.column(0)[lo:hi], pa.array(np.bincount(d, minlength=n), pa.int64()), kernels.packed(hs[at].view(np.int64), np.diff(ends)), kernels.packed(tf.astype(np.int32), np.diff(ends))]
                if vectors:
                    dim, sign = signs(hs[at], h, buf, s, e)
                    v = np.bincount(d[at] * DIM + dim, sign * tf, minlength=n * DIM).reshape(n, DIM).astype(np.float32)
                    v[~v.any(1), 0] = 1.0
                    cols.append(kernels.packed(v.ravel(), np.full(n, DIM)))
                yield pa.RecordBatch.from_arrays([*cols, *(c[lo:hi] for c in b.columns[2:])], ["chunk_id", "dl", "terms", "tfs", *["vector"] * vectors, *(f"x{i}" for i in range(len(carry)))])

    kind = lambda c: chunks.schema[c].dataType.simpleString()
    shape = f"chunk_id {kind(id_col)}, dl long, terms binary, tfs binary" + ", vector binary" * vectors + "".join(f", x{i} {kind(c)}" for i, c in enumerate(carry))
    got = chunks.select(F.col(id_col).alias("chunk_id"), F.lower(T.text_or_empty(F.col(text_col))).alias("low"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(carry))).mapInArrow(run, shape)
    return got.select("chunk_id", "dl", "terms", "tfs", *["vector"] * vectors, *(F.col(f"x{i}").alias(c) for i, c in enumerate(carry)))


def index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", carry: Sequence[str] = (), vectors: bool = False) -> Index:
    """An index kept by the session (in memory, then on disk)."""
    return _measured(forward(chunks, id_col, text_col, carry, vectors).persist())


def _measured(rows: DataFrame) -> Index:
    n, total = rows.agg(F.count("*"), F.sum("dl")).first()
    return Index(rows, n, total / n if n and total else 1.0)


def kept(collection: store.Collection, id_col: str = "chunk_id", text_col: str = "text", carry: Sequence[str] = (), vectors: bool = False) -> Index:
    """The index of a collection's present version, from its table; built when there is none."""
    spark, version = collection.spark, collection.version
    at = f"{collection.path}/index-{id_col}-{text_col}-{int(vectors)}-{'-'.join(carry)}/v{version}"
    done, p = collection.file(f"{at}/_SUCCESS", whole=True)
    rows = forward(collection.read(), id_col, text_col, carry, vectors)
    if not done.exists(p):
        rows.write.mode("overwrite").parquet(at)
    return _measured(spark.read.schema(rows.schema).parquet(at))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def scores(queries: DataFrame, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", filters: dict | None = None) -> DataFrame:
    """(query_id, chunk_id, score > 0) by joins alone, for any number of queries; ``queries`` has query_id and query."""
    asked = _asked(queries)
    words = asked.select("token").distinct()
    n, avgdl = corpus(chunks, id_col, text_col)
    keep = common.matches(filters or {})
    all_ = chunks.select(F.col(id_col).alias("chunk_id"), T.tokens(F.col(text_col)).alias("toks"), F.coalesce(keep, F.lit(False)).alias("kept"))
    met = all_.select("chunk_id", "kept", F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("token")).join(words, "token")
    tf = met.groupBy("token", "chunk_id", "dl", "kept").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    k1, b = config.BM25_K1, config.BM25_B
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * ((1 - b) + b * F.col("dl") / F.lit(float(avgdl))))
    part = tf.where("kept").join(df, "token").withColumn("w", idf("df", n) * weight)
    return part.join(asked, "token").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * F.col("w")).alias("score")).where("score > 0")


def _postings(vocab: np.ndarray, terms: pa.Array, tfs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, place in ``vocab``, count) of the postings of query terms."""
    h, many = kernels.unpacked(terms, "i8")
    doc = np.repeat(np.arange(len(terms)), many)
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    ok = np.flatnonzero(vocab[at] == h) if len(h) else np.zeros(0, np.int64)
    return doc[ok], at[ok], kernels.unpacked(tfs, "i4")[0][ok]


def _frequencies(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held.value
        df = np.zeros(len(vocab), np.int64)
        for b in batches:
            h = kernels.unpacked(b.column(0), "i8")[0]
            at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
            df += np.bincount(at[vocab[at] == h], minlength=len(vocab))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    return run


def _score(held, k: int):
    """Scores a partition's chunks for all queries at once and keeps the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vocab, weight, first, query, qtf, avgdl = held.value
        nq = len(qids)
        best = kernels.TopK(nq, k, 5e-7)
        k1, b1 = config.BM25_K1, config.BM25_B
        step = max(1, min(2000, 4_000_000 // max(1, nq)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                ids, dl = np.asarray(b.column(0)), np.asarray(b.column(1)).astype(float)
                n = len(ids)
                d, t, tf = _postings(vocab, b.column(2), b.column(3))
                w = weight[t] * (tf * (k1 + 1) / (tf + k1 * ((1 - b1) + b1 * dl[d] / avgdl)))
                many = first[t + 1] - first[t]
                e = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[t], many)
                best.add(np.bincount(query[e] * n + np.repeat(d, many), qtf[e] * np.repeat(w, many), minlength=nq * n).reshape(nq, n).round(6), ids)
        q, c, s = best.result()
        yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(c, pa.int64()), pa.array(s)], ["query_id", "chunk_id", "score"])

    return run


def search(queries: DataFrame, chunks: DataFrame | Index, k: int = 10, id_col: str = "chunk_id", text_col: str = "text", filters: dict | None = None) -> DataFrame:
    """The k best chunks of each query: query_id, chunk_id, score (6 places), rank, origin. ``chunks``: an index that carries the filters' columns, or a table."""
    asked = _asked(queries)
    rows = asked.limit(QUERY_TERMS + 1).toPandas()
    if isinstance(chunks, DataFrame):
        if len(rows) > QUERY_TERMS or chunks.schema[id_col].dataType.simpleString() != "bigint":
            return common.top_k(scores(queries, chunks, id_col, text_col, filters), k).withColumn("origin", F.lit("bm25"))
        chunks = index(chunks, id_col, text_col, tuple(filters or ()))
    spark = queries.sparkSession
    common.small_batches(spark)
    words = {w: kernels.hash_of(w) for w in set(rows["token"])}
    vocab = np.array(sorted(set(words.values())), np.int64)
    if not len(vocab):
        return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank long, origin string")
    at = np.searchsorted(vocab, rows["token"].map(words).to_numpy(np.int64))
    order = np.argsort(at, kind="stable")
    rows, at = rows.iloc[order], at[order]
    counted = chunks.rows.select("terms").mapInArrow(_frequencies(spark.sparkContext.broadcast(vocab)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row for each query term at most
    df = np.zeros(len(vocab))
    for r in counted:
        df[r["term"]] = r["df"]
    weight = np.log(1.0 + (chunks.n - df + 0.5) / (df + 0.5))
    qids, query = np.unique(rows["query_id"].to_numpy(np.int64), return_inverse=True)
    first = np.searchsorted(at, np.arange(len(vocab) + 1))
    held = spark.sparkContext.broadcast((qids, vocab, weight, first, query, rows["qtf"].to_numpy(float), chunks.avgdl))
    use = chunks.rows.where(common.matches(filters)) if filters else chunks.rows
    found = use.select("chunk_id", "dl", "terms", "tfs").mapInArrow(_score(held, k), "query_id long, chunk_id long, score double")
    return common.top_k(found, k).withColumn("origin", F.lit("bm25"))
