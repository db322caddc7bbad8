"""URL filters: host and path rules, then a character language-model ratio.

A rule is (host, path prefix); it fits its host and all subdomains when the URL's path starts
with its path, and the longest fitting rule decides. The other URLs are judged by two smoothed
variable-order Markov models of characters, one of accepted and one of rejected URLs (those that
a rule allows or blocks): Witten-Bell interpolation of orders 0 to ``ORDER`` over exact contexts,
counts summed over the rule-judged URLs. The score is the log-likelihood difference for each
character; its threshold is the one with the least balanced error on the rule-judged URLs of a
hash fold (one in five) that the counts leave out.

The counts are a table that grows with the input: a key holds class, order, context and byte, none
folded. Up to ``MAX_CELLS`` rows it goes to the tasks whole; above that, the 5-grams of the scored
URLs are joined with it. Both give the same scores.

Up to ``INLINE_RULES`` rules are one expression; more are joined by host suffix and path prefix, with the
same results. Null URL, or no ``://``: host and path are empty and the score is 0. With no accepted or no
rejected URL to learn from, what no rule judges is allowed. Rows are judged one by one, so
repeats don't matter, and columns besides id and URL aren't read, so names may be any. Of rules that fit with equally long host and
path together, the one with the longer host counts, of equal rules the last. An empty table gives no
rows. A URL is held whole in one task, at some 200 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk

#: A context is a number of ORDER digits to the base SYMBOLS: the last byte plus 1 lowest, 0 before the beginning.
ORDER, SYMBOLS, BINS = 4, 257, 400
CONTEXT_BITS = (SYMBOLS**ORDER - 1).bit_length()
#: Rows of the count table that are sent to the tasks (16 bytes each); a larger one is joined.
MAX_CELLS = 2_000_000
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules that make one expression; more are joined.
INLINE_RULES = 200


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (host and path together, then the host), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def joined_rules(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``rows`` with ``__hit``, what ``rule_of`` gives, by equi-joins of each distinct (host, path)'s host suffixes and path prefixes of the lengths that rules have."""
    table = {(h, p): v for v, h, p in rules}  # of equal rules the last counts
    lengths: dict[str, set[int]] = {}
    for h, p in table:
        lengths.setdefault(h, set()).add(len(p))
    spark = rows.sparkSession
    hosts = spark.createDataFrame([(h, sorted(n)) for h, n in lengths.items()], "h string, lengths array<int>")
    known = spark.createDataFrame([(h, p, v) for (h, p), v in table.items()], "h string, p string, verdict string")
    labels = max(h.count(".") + 1 for h in lengths)
    parts = F.split("__host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), F.size(parts))), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    at = rows.select("__host", "__path").distinct().select("__host", "__path", F.explode(ends).alias("h")).join(hosts, "h")
    at = at.select("__host", "__path", "h", F.explode(F.filter("lengths", lambda n: n <= F.length("__path"))).alias("n"))
    at = at.select("__host", "__path", "h", F.substring("__path", F.lit(1), F.col("n")).alias("p")).join(known, ["h", "p"])
    longest = F.struct(F.length("h") + F.length("p"), F.length("h"))
    best = at.groupBy("__host", "__path").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), longest).alias("__hit"))
    return rows.join(best, ["__host", "__path"], "left")


@dataclass
class Model:
    """cells[class][order]: (indices, counts) of context * 256 + byte, or None and the table of (key, n); threshold of the score; None: allow all."""

    cells: list[list[tuple[np.ndarray, np.ndarray]]] | None
    threshold: float | None
    table: DataFrame | None = None


def _contexts(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each order, the context before each byte; a URL's beginning is padded with zeros."""
    d = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    start = offs[:-1][d]
    at = np.arange(len(buf))
    out = [np.zeros(len(buf), np.int64)]
    for k in range(1, ORDER + 1):
        prev = np.where(at - k >= start, buf[np.maximum(at - k, 0)].astype(np.int64) + 1, 0)
        out.append(out[-1] + prev * SYMBOLS ** (k - 1))
    return out


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        side = np.asarray(b.column(1))
        for lo, hi, buf, offs in tk.slices(b.column(0)):
            s = np.repeat(side[lo:hi], np.diff(offs)).astype(np.int64)
            keys = [((s * (ORDER + 1) + k) << (CONTEXT_BITS + 8)) + c * 256 + buf for k, c in enumerate(_contexts(buf, offs))]
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])


class Sparse:
    """Numbers by ascending key; 0 under any other key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(at))
        i = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[i] == at, self.values[i], 0.0)


class Scorer:
    def __init__(self, cells: list[list[tuple[np.ndarray, np.ndarray]]]) -> None:
        self.tables = []
        for side in cells:
            mine = []
            for i, n in side:
                order = np.argsort(i)
                i, n = np.asarray(i, np.int64)[order], np.asarray(n, np.float64)[order]
                c, first = np.unique(i >> 8, return_index=True)
                total = np.add.reduceat(n, first) if len(first) else n
                mine.append((Sparse(i, n), Sparse(c, total), Sparse(c, np.diff(np.append(first, len(i))).astype(np.float64))))
            self.tables.append(mine)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Accepted minus rejected log-likelihood, for each character of each URL; 0 for an empty one."""
        cell, back = np.unique(_contexts(buf, offs)[ORDER] * 256 + buf, return_inverse=True)
        byte, context = cell & 255, cell >> 8
        logs = []
        for side in self.tables:
            p = np.full(len(cell), 1 / 256)
            for k, (t, total, kinds) in enumerate(side):
                c = context % SYMBOLS**k
                seen = total[c] + kinds[c]
                p = np.where(seen > 0, (t[c * 256 + byte] + kinds[c] * p) / np.maximum(seen, 1), p)
            logs.append(np.log(p))
        diff = np.zeros(len(buf) + 1)
        np.cumsum((logs[0] - logs[1])[back], out=diff[1:])
        return (diff[offs[1:]] - diff[offs[:-1]]) / np.maximum(np.diff(offs), 1)


def _score(held, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column(0)):
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[1:]), pa.array(scorer(buf, offs), pa.float64())], [*b.schema.names[1:], name])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash of a text, 5-gram, times, bytes of the text)"""
    for b in batches:
        for lo, hi, buf, offs in tk.slices(b.column(0)):
            d = np.repeat(np.arange(hi - lo), np.diff(offs))
            cell = _contexts(buf, offs)[ORDER] * 256 + buf
            by = np.lexsort((cell, d))
            d, cell = d[by], cell[by]
            first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (cell[1:] != cell[:-1]))) if len(d) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(d)))
            d = d[first]
            yield pa.RecordBatch.from_arrays([b.column(1)[lo:hi].take(pa.array(d)), pa.array(cell[first]), pa.array(n.astype(np.int64)), pa.array(np.diff(offs)[d].astype(np.int64))], ["__text", "cell", "times", "size"])


def joined_scores(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the score of ``__seen``, by joins with the count table; what Scorer gives."""
    key = (F.xxhash64("__seen"), F.hash("__seen"))
    rows = rows.withColumn("__text", F.struct(*(k.alias(n) for k, n in zip(key, "ab", strict=True))))
    texts = rows.where(F.col("__seen") != "").groupBy("__text").agg(F.first("__seen").alias("__seen")).select("__seen", "__text")
    spread = texts.mapInArrow(_spread, "__text struct<a:long,b:int>, cell long, times long, size long")
    shift = CONTEXT_BITS + 8
    part = F.shiftright("key", shift)
    grams = table.select((part % (ORDER + 1)).alias("k"), (part >= ORDER + 1).alias("rejected"), F.col("key").bitwiseAND((1 << shift) - 1).alias("gram"), "n")
    zero = F.lit(0).cast("long")
    grams = grams.groupBy("k", "gram").agg(*(F.sum(F.when(F.col("rejected") == bool(s), F.col("n")).otherwise(zero)).alias(f"n{s}") for s in (0, 1)))
    around = grams.groupBy("k", F.shiftright("gram", 8).alias("context")).agg(*(F.sum(f"n{s}").alias(f"total{s}") for s in (0, 1)), *(F.sum((F.col(f"n{s}") > 0).cast("long")).alias(f"kinds{s}") for s in (0, 1)))
    asked = spread.select("cell").distinct()
    asked = asked.select("cell", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), (F.shiftright("cell", 8) % F.lit(SYMBOLS**k)).alias("context")) for k in range(ORDER + 1)))).alias("x"))
    asked = asked.select("cell", "x.k", "x.context", (F.col("x.context") * 256 + F.col("cell").bitwiseAND(255)).alias("gram"))
    asked = asked.join(around, ["k", "context"]).join(grams, ["k", "gram"], "left")
    values = [f"{v}{s}" for v in ("total", "kinds", "n") for s in (0, 1)]
    asked = asked.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", *(F.coalesce(F.col(v), zero).cast("double").alias(v) for v in values)))).alias("orders"))

    def likely(s: int) -> Column:
        def step(p: Column, x: Column) -> Column:
            seen = x[f"total{s}"] + x[f"kinds{s}"]
            return F.when(seen > 0, (x[f"n{s}"] + x[f"kinds{s}"] * p) / seen).otherwise(p)

        return F.log(F.aggregate("orders", F.lit(1 / 256), step))

    diff = asked.select("cell", (likely(0) - likely(1)).alias("diff"))
    score = spread.join(diff, "cell").groupBy("__text").agg((F.sum(F.col("times") * F.col("diff")) / F.first("size")).alias("score"))
    return rows.join(score, "__text", "left").drop("__text").withColumn("score", F.coalesce("score", F.lit(0.0)))


def scores(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``score`` in place of ``__seen``, by the way that the model's size asks for."""
    rest = [c for c in rows.columns if c != "__seen"]
    if model.table is not None:
        return joined_scores(rows, model.table).select(*rest, "score")
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.select("__seen", *rest).mapInArrow(_score(rows.sparkSession.sparkContext.broadcast(model.cells), "score"), f"{shape}, score double")


def parsed(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds __host, __path, __hit (rule, verdict) and __seen (what the models read) to ``pages``."""
    out = pages.withColumn("__host", host_of(url_col)).withColumn("__path", path_of(url_col))
    out = out.withColumn("__seen", F.concat("__host", "__path"))
    return joined_rules(out, rules) if len(rules) > INLINE_RULES else out.withColumn("__hit", rule_of(F.col("__host"), F.col("__path"), rules))


def fit(judged: DataFrame, url_col: str = "url", max_cells: int | None = None) -> Model:
    """A model of ``parsed`` rows: counts over all that a rule judged, but for the calibration fold."""
    known = judged.where(F.col("__hit").isNotNull()).select("__seen", (F.col("__hit.verdict") == "block").cast("int").alias("side"), (F.crc32(F.col(url_col).cast("binary")) % 5 == 0).alias("fold"))
    table, at = shared.written(known.where(~F.col("fold")).select("__seen", "side").mapInArrow(_counter, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "url-counts")
    part = F.shiftright("key", CONTEXT_BITS + 8)
    sizes = {r[0]: r[1] for r in table.groupBy((part >= ORDER + 1).cast("int")).count().collect()}
    if sum(sizes.values()) > (MAX_CELLS if max_cells is None else max_cells):
        model = Model(None, None, table)
    else:
        rows = table.toPandas()
        shared.remove(judged.sparkSession, at)
        key, n = rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        order = np.argsort(key)
        key, n = key[order], n[order]
        part, cell = key >> (CONTEXT_BITS + 8), key & ((1 << (CONTEXT_BITS + 8)) - 1)
        model = Model([[(cell[m], n[m]) for k in range(ORDER + 1) for m in [part == s * (ORDER + 1) + k]] for s in (0, 1)], None)
    if len(sizes) < 2:
        return model
    scored = scores(known.where("fold").select("__seen", "side"), model)
    bins = scored.groupBy("side", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + 4) * (BINS / 8)))).cast("int").alias("bin")).count().collect()
    got = np.zeros((2, BINS))
    for r in bins:
        got[r["side"], r["bin"]] = r["count"]
    if not got.sum(1).all():
        model.threshold = 0.0
        return model
    share = got / got.sum(1, keepdims=True)
    lost = np.concatenate([[0], np.cumsum(share[0])])  # accepted URLs under a threshold
    let = 1 - np.concatenate([[0], np.cumsum(share[1])])  # rejected ones above it
    err = lost + let
    best = np.flatnonzero(err <= err.min() + 1e-12)
    model.threshold = float(best[len(best) // 2]) * 8 / BINS - 4
    return model


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: Model | None = None) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score."""
    judged = parsed(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), "__url", rules)
    model = model or fit(judged, "__url")
    scored = scores(judged.select("__seen", "__id", F.col("__host").alias("host"), F.col("__path").alias("path"), "__hit"), model)
    own = F.lit("allow") if model.threshold is None else F.when((F.col("score") >= model.threshold) | ((F.col("host") == "") & (F.col("path") == "")), "allow").otherwise("block")
    return scored.select(F.col("__id").alias(id_col), "host", "path", F.col("__hit.rule").alias("rule"), F.coalesce(F.col("__hit.verdict"), own).alias("verdict"), "score")
