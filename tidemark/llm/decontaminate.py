"""Benchmark decontamination by template canonicalisation.

Numbers, units after a number, and names (capitalised words inside a sentence) become typed
placeholders, so a re-parameterised question has the same template as the original. Windows of
``WINDOW`` canonical words with enough literal ones are hashed, and the texts' windows are
hash-joined to the benchmark's. The matches of a text and an item on one diagonal must fill
the slots consistently: one benchmark value stands for one value in the text. Windows that hold a
value that stands for several are dropped, unless all their slots are as in the item; the others
count. A text is contaminated by an item when such windows cover ``MIN_RUN`` of its words on one
diagonal, or ``MIN_COVER`` of all its words.

Beside the templates goes an exact path: windows of ``WINDOW`` case-folded words as they stand, or
the whole item where it has fewer, under the same two bounds. It finds any copy of an item, whatever
its case, length or share of typed words. An item of one word matches each text that has the word.

Before the join, a text's windows pass a bit table of the benchmark's hashes, of 16 MB
at most however large the benchmark is; false passes don't survive the join. Null, empty or wordless
texts and items match nothing. Each row's text is judged by itself (rows are told apart by 96 bits of hashes of id and text);
rows of one id that match one item give one result, the one that covers more. Repeated items all report. Columns
besides id and text aren't read, so their names may be any. Empty tables give no rows. A text is held whole in one
task, at some 60 bytes for each of its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk

WINDOW, MIN_LITERAL, MIN_RUN, MIN_COVER = 8, 5, 13, 0.6
#: Least and most bits of the bit table's size; in between, eight times the benchmark's windows.
BLOOM_BITS = 20, 27
UNITS = "km m cm mm mi mile miles kg g mg lb lbs pound pounds oz l ml liter liters litre litres hour hours h min minute minutes s sec second seconds day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur degrees celsius kmh mph kb mb gb tb".split()
NUM, UNIT, NAME = (tk.mix_int(x) for x in (11, 12, 13))
_UNITS = np.sort(np.array([int(tk.word_hashes(u, tk.LETTER_DIGIT)[0]) for u in UNITS], np.uint64))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BETWEEN = re.compile(r"[^\w\x00-\x7F]+")
_END = np.zeros(256, bool)
_END[list(b".!?:;\n\r\"'(")] = True


def canonical(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(canonical word, surface hash, typed?, text) of the words; a number with inner . or , is one word."""
    s, e, d = tk.spans(buf, offs, tk.LETTER_DIGIT)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), d
    p = tk.eights(buf, tk.LOWER)
    num = _DIGIT[buf[s]] & _DIGIT[buf[e - 1]]
    join = np.zeros(len(s), bool)
    join[1:] = num[1:] & num[:-1] & (d[1:] == d[:-1]) & (s[1:] == e[:-1] + 1)
    join[1:] &= (buf[e[:-1]] == 46) | (buf[e[:-1]] == 44)
    if join.any():
        keep = np.flatnonzero(~join)
        ends = np.concatenate([keep[1:], [len(s)]]) - 1
        s, e, d, num = s[keep], e[ends], d[keep], num[keep]
    h = tk.span_hash(p, s, e)
    unit = np.zeros(len(s), bool)
    near = np.searchsorted(_UNITS, h)
    unit[1:] = (_UNITS[np.minimum(near, len(_UNITS) - 1)] == h)[1:] & num[:-1] & (d[1:] == d[:-1])
    first = np.ones(len(s), bool)
    first[1:] = d[1:] != d[:-1]
    ended = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_END[buf], out=ended[1:])
    first[1:] |= ended[s[1:]] > ended[e[:-1]]
    b0, b1 = buf[s], buf[np.minimum(s + 1, len(buf) - 1)]
    upper = ((b0 >= 65) & (b0 <= 90)) | ((b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E))
    name = upper & ~first & ~num & ~unit
    c = np.where(num, tk.U64(NUM), np.where(unit, tk.U64(UNIT), np.where(name, tk.U64(NAME), h)))
    return c, h, num | unit | name, d


def windows(buf: np.ndarray, offs: np.ndarray, size: int = WINDOW, min_literal: int = MIN_LITERAL) -> tuple[np.ndarray, ...]:
    """(canonical hashes, usable places, surface, typed, text) of the windows."""
    c, h, typed, d = canonical(buf, offs)
    g, one = tk.grams(c, d, size)
    t = np.zeros(len(c) + 1, np.int64)
    np.cumsum(typed, out=t[1:])
    if len(g):
        one = one & (size - (t[size:] - t[:-size]) >= min_literal)
    return g, np.flatnonzero(one), h, typed, d


def folded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts case-folded, other than ASCII punctuation as spaces; ASCII texts stay, as the word hashes fold them."""
    if not len(buf) or buf.max() < 128:
        return buf, offs
    texts = [bytes(buf[lo:hi]) for lo, hi in zip(offs[:-1], offs[1:], strict=True)]
    texts = [t if t.isascii() else _BETWEEN.sub(" ", t.decode("utf-8", "replace").casefold()).encode() for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def literal(buf: np.ndarray, offs: np.ndarray, size: int = WINDOW, widths: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """(hashes, place in the text, width, text, words of each text) of literal windows of ``widths``; None: as items have them, of ``size`` or whole."""
    buf, offs = folded(buf, offs)
    s, e, d = tk.spans(buf, offs, tk.LETTER_DIGIT)
    h = tk.span_hash(tk.eights(buf, tk.LOWER), s, e)
    zero = tk.first_of(d, len(offs) - 1)
    words = np.diff(zero)
    out = []
    for w in range(1, size + 1) if widths is None else widths:
        g, one = tk.grams(h, d, w)
        at = np.flatnonzero(one)
        if widths is None and w < size:
            at = at[words[d[at]] == w]
        out.append((g[at] ^ tk.U64(tk.mix_int(100 + w)), at - zero[d[at]], np.full(len(at), w), d[at]))
    g, pos, width, doc = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return g, pos, width, doc, words


def _emit(id_name: str, held, size: int, min_literal: int, widths: list[int] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None if held is None else np.unpackbits(held.value).astype(bool)
        names = [id_name, "pos", "size", "gram", "width", "slots"]
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column(1)):
                g, at, h, typed, d = windows(buf, offs, size, min_literal)
                if flags is not None and len(at):
                    at = at[tk.in_bloom(flags, g[at])]
                if len(at):
                    zero = tk.first_of(d, hi - lo)
                    doc = d[at]
                    cells = at[:, None] + np.arange(size)
                    slots = np.where(typed[cells], h[cells], tk.U64(0)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(doc + lo)), pa.array((at - zero[doc]).astype(np.int64)), pa.array((zero[doc + 1] - zero[doc]).astype(np.int64)), pa.array(g[at].view(np.int64)), pa.array(np.zeros(len(at), np.int64)), tk.list_array(pa.array(slots.ravel()), np.full(len(at), size))],
                        names,
                    )
                g, pos, width, doc, words = literal(buf, offs, size, widths)
                if flags is not None and len(g):
                    at = np.flatnonzero(tk.in_bloom(flags, g))
                    # where a whole short item stands in a text makes no difference: once is enough
                    short = at[width[at] < size]
                    short = short[np.unique(np.stack([doc[short], g[short].view(np.int64)]), axis=1, return_index=True)[1]] if len(short) else short
                    at = np.concatenate([at[width[at] == size], short])
                    g, pos, width, doc = g[at], pos[at], width[at], doc[at]
                if len(g):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(doc + lo)), pa.array(pos.astype(np.int64)), pa.array(words[doc].astype(np.int64)), pa.array(g.view(np.int64)), pa.array(width.astype(np.int64)), tk.list_array(pa.array([], pa.int64()), np.zeros(len(g), np.int64))],
                        names,
                    )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, min_literal: int = MIN_LITERAL, min_run: int = MIN_RUN, min_cover: float = MIN_COVER) -> DataFrame:
    """A row for each contaminated (text, item): ids, n_matched (item words covered), coverage, verbatim, contaminated (true), by the path that covers more."""
    ik, dk = benchmark.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item"), item_text).where(F.col(item_text).isNotNull())
    shape = "pos long, size long, gram long, width long, slots array<long>"
    bench, _ = shared.written(items.mapInArrow(_emit("item", None, size, min_literal), f"item {ik}, {shape}").select("item", F.col("pos").alias("ipos"), F.col("size").alias("isize"), "gram", "width", F.col("slots").alias("islots")), "benchmark")
    bits = int(np.clip((8 * bench.count()).bit_length(), *BLOOM_BITS))
    flags = docs.sparkSession.sparkContext.broadcast(shared.bit_table(bench, F.col("gram"), bits))
    widths = sorted(r[0] for r in bench.select("width").where("width > 0").distinct().collect())
    text = F.struct(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.hash(id_col, text_col).alias("row2"))
    found = docs.select(text.alias("id"), text_col).mapInArrow(_emit("id", flags, size, min_literal, widths), f"id struct<id:{dk},row:long,row2:int>, {shape}").select("id", "pos", "gram", "width", "slots")
    # one item's window may stand at many places of the benchmark; equal windows of equal slots join once for each item
    hit = found.join(bench, ["gram", "width"]).withColumn("diagonal", F.col("pos") - F.col("ipos"))
    filled = F.filter(F.arrays_zip("islots", "slots"), lambda x: x["islots"] != 0)
    same = F.transform(filled, lambda x: F.struct(x["islots"].alias("was"), x["slots"].alias("now")))
    by = hit.groupBy("id", "item", "width", "diagonal", "isize").agg(F.collect_set(F.struct(F.col("ipos").alias("at"), same.alias("slots"))).alias("windows"))
    by = by.withColumn("slots", F.array_distinct(F.flatten("windows.slots"))).withColumn("was", F.array_sort("slots.was"))
    # a value of the item that stands for several values in the text
    torn = F.array_distinct(F.filter("was", lambda x, i: (i > 0) & (F.get("was", i - 1) == x)))
    by = by.withColumn("torn", torn)
    good = F.filter("windows", lambda w: F.forall(w["slots"], lambda x: x["was"] == x["now"]) | ~F.exists(w["slots"], lambda x: F.array_contains("torn", x["was"])))
    wide = F.when(F.col("width") > 0, F.col("width")).otherwise(F.lit(size))
    by = by.withColumn("windows", good).where(F.size("windows") > 0)
    by = by.withColumn("covered", F.array_distinct(F.flatten(F.transform("windows.at", lambda p: F.sequence(p, p + (wide - 1))))))
    verbatim = F.forall(F.flatten("windows.slots"), lambda x: x["was"] == x["now"])
    pair = by.groupBy("id", "item", "width", "isize").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_matched"), F.max(F.size("covered")).alias("run"), F.min(verbatim).alias("verbatim"))
    pair = pair.withColumn("coverage", F.round(F.col("n_matched") / F.col("isize"), 6)).where((F.col("run") >= min_run) | (F.col("coverage") >= min_cover))
    pair = pair.groupBy(F.col("id.id").alias("id"), "item").agg(F.max(F.struct("coverage", "n_matched", "verbatim")).alias("best"))
    return pair.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.n_matched", "best.coverage", "best.verbatim", F.lit(True).alias("contaminated"))
