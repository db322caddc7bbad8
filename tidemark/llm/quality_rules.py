"""Quality rules: a learned decision list over text statistics, emitted as a Spark CASE WHEN.

``statistics`` counts over whole texts with numpy passes, one Arrow function and no shuffle.
``learn`` does sequential covering on a bounded sample of labelled rows: a conjunction of
thresholds is grown by FOIL gain on two thirds of the rows, pruned on the rest, kept while it
is precise on both, and its rows are taken away before the next. ``verdict`` makes the ordered
rules a nested ``when``, so scoring stays in the JVM.

Null or empty text: all statistics 0. Repeated rows and ids: each row is judged by itself. No
or only one-sided labels: an empty list, which keeps everything. Several labels of one id: the least counts. Of tests with equal
gain the first statistic in ``COUNTS`` and ``RATIOS`` wins, of rules that fit the first. An empty table gives no rows.
Columns besides the id and the text are not read, so they may have any name. A text is held whole in one
task, at some 45 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARKS = np.zeros(256, bool)
MARKS[list(b".,!?;:")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "long_share", "words_per_line", "bang_share")
#: Labelled rows that ``fit`` takes at most: those with the lowest hash of their id.
MAX_LABELLED = 6000


def _count(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    s, e, d = tk.spans(buf, offs, tk.NOT_SPACE)
    p = tk.eights(buf)
    h = tk.span_hash(p, s, e)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    word_chars = chars[e] - chars[s]
    words = np.bincount(d, minlength=n)
    g, one = tk.grams(h, d, 8)
    repeat = np.zeros(len(h) + 1, np.int64)
    if one.any():
        at = np.flatnonzero(one)
        key = g[at] + d[at].astype(np.uint64) * tk.U64(0x9E3779B97F4A7C15)
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        hit = at[order[same]]
        np.add.at(repeat, hit, 1)
        np.add.at(repeat, hit + 8, -1)
    covered = np.cumsum(repeat[:-1]) > 0
    ls, le, ld = tk.lines(buf, offs)
    w0 = np.searchsorted(s, ls)
    worded = w0 < np.searchsorted(s, le)
    lh = tk.span_hash(p, ls[worded], le[worded]) + ld[worded].astype(np.uint64) * tk.U64(0x9E3779B97F4A7C15)
    dup = np.zeros(n, np.int64)
    if len(lh):
        order = np.argsort(lh, kind="stable")
        again = lh[order][1:] == lh[order][:-1]
        dup = np.bincount(ld[worded][order[1:][again]], minlength=n)
    key = h + d.astype(np.uint64) * tk.U64(0x9E3779B97F4A7C15)
    key.sort()
    distinct = np.zeros(n, np.int64)
    if len(h):
        # sorted keys no longer tell their text, so distinct words are counted by it apart
        order = np.argsort(h + d.astype(np.uint64) * tk.U64(0x9E3779B97F4A7C15), kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        distinct = np.bincount(d[order[new]], minlength=n)
    lines = np.bincount(ld, minlength=n)
    total = np.bincount(d, word_chars, minlength=n).astype(np.int64)
    symbols = tk.sums(SYMBOLS[buf], offs)
    w, c = np.maximum(words, 1), np.maximum(total, 1)
    rep = np.bincount(d[covered], minlength=n)
    return {
        "n_words": words, "word_chars": total, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep,
        "mean_word": total / w, "symbols_per_word": symbols / w, "dup_line_share": dup / np.maximum(lines, 1), "repeat_share": rep / w,
        "upper_share": tk.sums(UPPER[buf], offs) / c, "digit_share": tk.sums(DIGIT[buf], offs) / c, "mark_share": tk.sums(MARKS[buf], offs) / w,
        "distinct_share": distinct / w, "long_share": np.bincount(d[word_chars > 12], minlength=n) / w, "words_per_line": words / np.maximum(lines, 1),
        "bang_share": tk.sums(buf == 33, offs) / w,
    }


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, five counts (long) and eleven ratios (double)."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, *COUNTS, *RATIOS]
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column(1)):
                got = _count(buf, offs)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *(pa.array(got[c], pa.int64()) for c in COUNTS), *(pa.array(got[c], pa.float64()) for c in RATIOS)], names)

    return docs.select(id_col, text_col).mapInArrow(run, out)


@dataclass(frozen=True)
class Rule:
    """``all of (column, '<=' or '>', threshold)`` rejects; precision as on the pruning rows."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int


def _holds(x: dict[str, np.ndarray], tests: tuple, n: int) -> np.ndarray:
    m = np.ones(n, bool)
    for c, op, t in tests:
        m &= x[c] <= t if op == "<=" else x[c] > t
    return m


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 0, max_rules: int = 16, max_tests: int = 4, min_precision: float = 0.9, min_cover: int = 4) -> list[Rule]:
    """The ordered rules that cover ``bad``; columns of ``x`` are statistics of the same rows."""
    n = len(bad)
    if not bad.any() or bad.all():
        return []
    part = tk.mix(np.arange(n, dtype=np.uint64) + tk.U64(seed)) % tk.U64(3) != 2
    cuts = {c: np.unique(np.quantile(v, np.linspace(0.01, 0.99, 60))) for c, v in x.items()}
    left, rules = np.ones(n, bool), []
    while len(rules) < max_rules:
        grow, prune = left & part, left & ~part
        tests: tuple = ()
        inside = grow.copy()
        while len(tests) < max_tests and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            if not p0:
                break
            base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
            for c, v in x.items():
                vb, vg = np.sort(v[inside & bad]), np.sort(v[inside & ~bad])
                pl, gl = np.searchsorted(vb, cuts[c], "right"), np.searchsorted(vg, cuts[c], "right")
                for op, ps, ns in (("<=", pl, gl), (">", p0 - pl, n0 - gl)):
                    gain = np.where(ps >= min_cover, ps * (np.log2(np.maximum(ps, 1e-9) / np.maximum(ps + ns, 1)) - base), -1)
                    if len(gain) and gain.max() > best[0] + 1e-9:
                        best = (float(gain.max()), (c, op, float(cuts[c][int(gain.argmax())])))
            if best[1] is None:
                break
            tests += (best[1],)
            inside = grow & _holds(x, tests, n)
        if not tests:
            break

        def worth(t: tuple) -> float:
            m = prune & _holds(x, t, n)
            return (float((m & bad).sum()) - float((m & ~bad).sum())) / max(int(m.sum()), 1)

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        m, q = left & _holds(x, tests, n), prune & _holds(x, tests, n)
        precise = min((m & bad).sum() / max(m.sum(), 1), (q & bad).sum() / max(q.sum(), 1) if q.any() else 1.0)
        if precise < min_precision or (m & bad).sum() < min_cover:
            break
        rules.append(Rule(tests, float(precise), int(m.sum())))
        left &= ~m
        if not (left & bad).any():
            break
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled rows (quality 0 is bad), taken by the hash of their ids from all labels."""
    lab = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(quality_col).alias("__q"))
    lab = lab.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    some = docs.select(id_col, text_col).join(F.broadcast(lab.select(id_col)), id_col, "left_semi")
    got = statistics(some, id_col, text_col).join(F.broadcast(lab), id_col).orderBy(F.xxhash64(id_col), id_col, "n_words").limit(max_labelled).toPandas()
    return learn({c: got[c].to_numpy(float) for c in (*COUNTS, *RATIOS)}, got["__q"].to_numpy() == 0)


def rejected_by(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row, else null."""
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules))):
        m = F.lit(True)
        for c, op, t in r.tests:
            m = m & (F.col(c) <= F.lit(t) if op == "<=" else F.col(c) > F.lit(t))
        out = F.when(m, F.lit(i)).otherwise(out)
    return out


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (int, null: none) and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", rejected_by(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
