"""Removal of repeated byte strings with a run-length index.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else. Every
such window has one anchor, the k-gram in it with the least hash, and equal windows have equal
anchors at equal places. So the windows of one anchor (an interval of starts, and the bytes
that they span: its snippet) need comparing with the same anchor's other snippets only:

1. ``anchors``: (fingerprint, snippet hash, row, interval) of every anchor; no text. They are
   range-partitioned by all of these, so a hot anchor is spread over partitions.
2. ``sort_out``: snippets found twice are repeated as a whole and enter the index once, as one text of
   several; an anchor with one snippet has nothing to compare. What stays is one occurrence of each snippet
   of an anchor with several.
3. Their bytes are fetched, and the snippets of whole anchors are indexed together. The index keeps the
   runs of their Burrows-Wheeler transform, and text place and LCP of both ends of each run; the suffix order
   that these come from is dropped. ``matches`` streams over the text: inside a run
   the longest match of the next place is one less, at a sample it starts anew. A window whose longest
   match elsewhere (the larger of both sides) reaches ``length`` is repeated.
4. An anchor with more than ``BLOCK`` snippets is split before: windows that hold the anchor at m or more bytes
   from their begin share the m bytes left of it, others some right of it, so each half is told apart by those
   bytes, and again while it is too big. Parts of a single place hold equal windows only, and are counted.
5. The repeated intervals of each row are joined with its bytes, and cut out.

All bytes of all rows take part; null or empty text has none. Rows that repeat entirely, with
the same id or not, count as separate places, so both lose all their windows. A row is known by
96 bits of hashes of its id and text. An empty table gives no rows. Columns besides id and text aren't read, so their
names may be any. A long text's windows are taken in parts of ``PIECE`` bytes; its bytes are held whole, at some 10 bytes for each of
its bytes where it is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk

LENGTH, GRAM, BLOCK, INDEX_BYTES, SEEN_BITS, PIECE = 200, 64, 4096, 1 << 20, 22, 8 << 20


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, fingerprint, snippet hash, first window, windows, anchor's offset) of all anchors."""
    z = np.zeros(0, np.int64)
    n, w = len(buf), length - gram + 1
    if n < length:
        return z, z.view(np.uint64), z.view(np.uint64), z, z, z
    m = n - gram + 1
    h = tk.rolling(buf, gram)
    low = h & ~tk.U64(0xFFFFFFFF) | np.arange(m, dtype=np.uint64)
    width = 1
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if w > width:
        low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
    at = (low & tk.U64(0xFFFFFFFF)).astype(np.int64)  # of each of the n - length + 1 windows
    windows = np.maximum(np.diff(offs) - length + 1, 0)
    doc = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + offs[:-1][doc]
    if not len(start):
        return z, z.view(np.uint64), z.view(np.uint64), z, z, z
    a = at[start]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(a)))
    lo, a, doc = start[first], a[first], doc[first]
    off = a - lo
    # a snippet's hash: those of the windows of a power of two that cover it
    wide = 8
    while 2 * wide <= length:
        wide *= 2
    r, size, text = tk.rolling(buf, wide), count - 1 + length, off.astype(np.uint64)
    for j in range(-(-(2 * length - gram) // wide)):
        text = (text ^ r[lo + np.minimum(j * wide, size - wide)]) * tk.U64(0x9FB21C651E98DF25)
        text ^= text >> tk.U64(31)
    return doc, h[a], tk.mix(text + size.astype(np.uint64)), lo - offs[doc], count, off


def _parts(texts: pa.Array, length: int, piece: int = PIECE) -> Iterator[tuple]:
    """(first row, and ``anchors``) of slices; the windows of a text above ``piece`` bytes are taken in parts. An anchor whose windows fall in two parts has two snippets, which have no window in common."""
    for lo, hi, buf, offs in tk.slices(texts):
        if len(buf) <= piece:
            yield lo, *anchors(buf, offs, length)
            continue
        for i in range(hi - lo):
            for at in range(int(offs[i]), int(offs[i + 1]), piece):
                part = buf[at : min(at + piece + length - 1, int(offs[i + 1]))]
                d, fp, sh, first, count, off = anchors(part, np.array([0, len(part)]), length)
                yield lo, d + i, fp, sh, first + (at - int(offs[i])), count, off


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, row2 = np.asarray(b.column(0)), np.asarray(b.column(1))
            for lo, d, fp, sh, first, count, off in _parts(b.column(2), length):
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(row[lo + d]), pa.array(row2[lo + d]), *(pa.array(x, pa.int32()) for x in (first, count, off))], ["fp", "sh", "row", "row2", "first", "count", "off"])

    return run


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: repeated as a whole; 1: to be compared; 2: only compared with. Each batch for itself: anchors at its edges count as having more snippets elsewhere."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        fp, sh = np.asarray(b.column(0)), np.asarray(b.column(1))
        gs = np.ones(n, bool)
        gs[1:] = fp[1:] != fp[:-1]
        vs = gs.copy()
        vs[1:] |= sh[1:] != sh[:-1]
        vfirst = np.flatnonzero(vs)
        vsize = np.diff(np.append(vfirst, n))
        group = np.cumsum(gs) - 1
        vgroup = group[vfirst]
        mixed = np.bincount(vgroup, minlength=group[-1] + 1) > 1
        mixed[[0, -1]] = True
        whole = np.repeat(vsize > 1, vsize)
        kind = np.full(n, -1)
        kind[whole] = 0
        kind[~whole & mixed[group]] = 1
        at = np.flatnonzero(kind >= 0)
        also = vfirst[(vsize > 1) & mixed[vgroup]]
        take = np.concatenate([at, also])
        if len(take):
            got = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([kind[at], np.full(len(also), 2)]), pa.int32()), got.column(0), *got.columns[2:]], ["kind", "fp", *b.schema.names[2:]])


def _packed(cells: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, z = None if cells is None else np.unpackbits(cells).astype(bool), zstandard.ZstdCompressor(level=3)
        for b in batches:
            if flags is not None:
                b = b.take(pa.array(np.flatnonzero(tk.in_bloom(flags, np.asarray(b.column(0)).view(np.uint64)))))
            for lo in range(0, b.num_rows, 1000):
                c = b.slice(lo, 1000)
                text = pa.array([z.compress((t or "").encode()) for t in c.column(c.num_columns - 1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*c.columns[:-1], text], [*b.schema.names[:-1], "packed"])

    return run


def _taken(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte strings that begin at ``start``."""
    o = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=o[1:])
    at = np.arange(int(o[-1])) + np.repeat(start - o[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(buf[at]))]).cast(pa.binary())


SNIPPETS = "fp long, row long, row2 int, first int, count int, off int, kind int, lo int, hi int, bytes binary"
_NAMES = [x.split()[0] for x in SNIPPETS.split(", ")]


def _fetch(length: int, gram: int):
    """The bytes of the wanted snippets of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                c = b.slice(lo, 200)
                texts = [np.frombuffer(z.decompress(p.as_buffer()), np.uint8) for p in c.column(2)]
                offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                want = c.column(3)
                w = want.flatten()
                at = np.repeat(np.arange(c.num_rows), np.asarray(want.value_lengths()))
                first, count = (np.asarray(w.field(f)).astype(np.int64) for f in ("first", "count"))
                n = len(at)
                rows = [x.take(pa.array(at)) for x in c.columns[:2]]
                edges = [pa.array(np.full(n, x), pa.int32()) for x in (0, length - gram)]
                yield pa.RecordBatch.from_arrays([w.field("fp"), *rows, *(w.field(f) for f in ("first", "count", "off", "kind")), *edges, _taken(np.concatenate(texts), offs[at] + first, count - 1 + length)], _NAMES)

    return run


def _halves(length: int, gram: int):
    """Snippets of one place range [lo, hi] of their anchor to those of its two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            first, count, off, lo, hi = (np.asarray(b.column(i)).astype(np.int64) for i in (3, 4, 5, 7, 8))
            for x, y, buf, offs in tk.slices(b.column(9)):
                w = tk.eights(buf)
                f, n, o, zero = first[x:y], count[x:y], off[x:y], offs[:-1]
                m = (lo[x:y] + hi[x:y] + 1) // 2
                for left in (True, False):
                    i = np.zeros(y - x, np.int64) if left else np.maximum(0, o - m + 1)
                    many = np.clip(o - m + 1, 0, n) if left else n - i
                    at = np.flatnonzero(many > 0)
                    g = zero[at] + o[at]
                    a, e = (g - m[at], g) if left else (g + gram, g + gram + length - gram - m[at] + 1)
                    key = tk.mix(tk.span_hash(w, a, e, 5 + left) ^ fp[x:y][at])
                    some = b.slice(x, y - x).take(pa.array(at))
                    ends = (m, hi[x:y]) if left else (lo[x:y], m - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), some.column(1), some.column(2), *(pa.array(v[at], pa.int32()) for v in (f + i, many, o - i)), some.column(6), *(pa.array(v[at], pa.int32()) for v in ends), _taken(buf, zero[at] + i[at], many[at] - 1 + length)], _NAMES
                    )

    return run


def _whole(length: int):
    """(fp, window hash, row, row2, first, kind) of snippets of a single window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, buf, offs in tk.slices(b.column(9)):
                h = tk.span_hash(tk.eights(buf), offs[:-1], offs[:-1] + length, 9)
                c = b.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(h.view(np.int64)), *(c.column(i) for i in (1, 2, 3, 6))], ["fp", "h", "row", "row2", "first", "kind"])

    return run


class RunLengthIndex:
    """The runs of the Burrows-Wheeler transform of texts end to end with different separators: symbol and length of each run, and for its two ends the text place (``first``, ``last``) and the LCP with the suffix beyond (``above``, ``below``). LCPs under ``least`` may be too low."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, least: int = 0) -> None:
        size = np.diff(offs)
        m, n = len(size), len(buf) + len(size)
        self.n, self.start = n, offs[:-1] + np.arange(m)
        sym = np.zeros(n + 8, np.uint8)
        sym[:n] = np.insert(buf, offs[1:], 0)
        number = np.repeat(np.arange(m), size + 1)
        left = (self.start + size)[number] - np.arange(n)  # symbols before the separator
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = (key << tk.U64(8)) | np.where(left > j, sym[j : j + n], 0).astype(np.uint64)
        rank = self._ranks(key, np.argsort(key))
        # bytes being equal, the suffix whose separator comes first is less; separators go by their text
        key = rank.astype(np.uint64) * tk.U64(8 * m + 1) + np.where(left < 8, left * m + number, 8 * m).astype(np.uint64)
        rank = self._ranks(key, np.argsort(key))
        # a rank is the number of lesser suffixes; only suffixes that share theirs are sorted further
        count = np.bincount(rank)
        open_ = np.flatnonzero((count > 1)[rank])
        rank = (np.cumsum(count) - count)[rank]
        levels, step = [(8, rank)], 8
        top = int(size.max(initial=1))
        while step <= top and len(open_):
            after = open_ + step
            second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[open_].astype(np.uint64) * tk.U64(n + 1) + second.astype(np.uint64)
            o = np.argsort(key)
            key, at = key[o], open_[o]
            old = rank[at]
            place = np.arange(len(at))
            new, group = np.ones(len(at), bool), np.ones(len(at), bool)
            new[1:], group[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
            run = np.maximum.accumulate(np.where(new, place, 0))
            rank = rank.copy()
            rank[at] = old + run - np.maximum.accumulate(np.where(group, place, 0))
            lone = new & np.append(new[1:], True)
            open_ = at[~lone]
            step *= 2
            levels.append((step, rank))
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        bwt = np.where(sa > 0, sym[np.maximum(sa - 1, 0)], 0).astype(np.int64)
        ends = (sa == 0) | (left[np.maximum(sa - 1, 0)] == 0)  # preceded by a separator, which equals none
        bwt[ends] = -1 - np.flatnonzero(ends)
        head, tail = np.ones(n, bool), np.ones(n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        tail[:-1] = head[1:]
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail)
        self.symbol, self.length = bwt[heads], tails - heads + 1
        self.first, self.last = sa[heads], sa[tails]
        self.above, self.below = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        self.above[1:] = self._common(levels, left, sym, self.first[1:], self.last[:-1], least)
        self.below[:-1] = self.above[1:]  # the next run's first suffix is the one beyond

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        k = key[order]
        new = np.zeros(len(k), np.int64)
        new[1:] = k[1:] != k[:-1]
        rank = np.empty(len(k), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _common(self, levels: list, left: np.ndarray, sym: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Common symbols of suffixes, up to either's separator; short of ``least`` they may be counted too low."""
        most = np.minimum(left[a], left[b])
        got = np.zeros(len(a), np.int64)
        for step, rank in reversed(levels):
            x, y = np.minimum(a + got, self.n - 1), np.minimum(b + got, self.n - 1)
            got += np.where((rank[x] == rank[y]) & (got + step <= most), step, 0)
        live = np.flatnonzero((got < most) & (got + 8 > least))
        for _ in range(8):
            live = live[sym[a[live] + got[live]] == sym[b[live] + got[live]]] if len(live) else live
            got[live] += 1
            live = live[got[live] < most[live]]
        return got

    def matches(self) -> np.ndarray:
        """For each text position, its longest match that starts at another, streamed from the samples of the run ends; values under ``least`` are lower bounds. A match one position on is shorter by one at most, so none of ``least`` follows from one below it."""
        best, at = np.zeros(self.n, np.int64), np.arange(self.n)
        for place, lcp in ((self.first, self.above), (self.last, self.below)):
            value = np.full(self.n, -1, np.int64)
            value[place] = lcp
            sampled = np.maximum.accumulate(np.where(value >= 0, at, 0))
            best = np.maximum(best, np.maximum(value[sampled] - (at - sampled), 0))
        return best

    @property
    def runs(self) -> int:
        return len(self.symbol)


def _index(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(c: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            kind, count, first = (np.asarray(c.column(i)).astype(np.int64) for i in (6, 4, 3))
            _, _, buf, offs = next(tk.slices(c.column(9), 1 << 62))
            index = RunLengthIndex(buf, offs, length)
            hit = index.matches() >= length
            mine = np.flatnonzero(kind == 1)
            n = count[mine] + 1  # a gap after each snippet's windows
            o = np.cumsum(n) - n
            f = np.zeros(int(n.sum()) + 1, np.int8)
            inner = np.arange(len(f) - 1) - np.repeat(o, n)
            ok = inner < np.repeat(count[mine], n)
            f[1:][ok] = hit[(np.repeat(index.start[mine], n) + inner)[ok]]
            d = np.diff(f)
            a, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
            if len(a):
                of = np.searchsorted(o, a, "right") - 1
                some = c.take(pa.array(mine[of]))
                shift = first[mine[of]] - o[of]
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(a + shift, pa.int32()), pa.array(e - 1 + shift + length, pa.int32())], ["row", "row2", "first", "end"])

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                held.append(b.slice(lo, 2000))
                size += held[-1].column(9).nbytes
                if size <= INDEX_BYTES:
                    continue
                c = pa.concat_batches(held)
                fp = np.asarray(c.column(0))
                cut = len(fp) - int((fp == fp[-1]).sum())  # whole anchors only
                if cut:
                    yield from flush(c.slice(0, cut))
                held = [c.slice(cut)]
                size = held[0].column(9).nbytes
        if size:
            yield from flush(pa.concat_batches(held))

    return run


def _cut(length: int, kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            n, gone, runs, digest, texts = [], [], [], [], []
            for packed, spans in zip(b.column(1), b.column(2), strict=True):
                text = z.decompress(packed.as_buffer())
                n.append(len(text))
                if not spans.is_valid:
                    gone.append(0)
                    runs.append(0)
                    left = text
                else:
                    s = spans.values
                    f = np.zeros(len(text) + 1, np.int32)
                    np.add.at(f, np.asarray(s.field("first")), 1)
                    np.add.at(f, np.asarray(s.field("end")), -1)
                    cover = np.cumsum(f, out=f)[:-1] > 0
                    gone.append(int(cover.sum()))
                    runs.append(int((np.diff(cover.astype(np.int8), prepend=0) == 1).sum()))
                    left = np.frombuffer(text, np.uint8)[~cover].tobytes()
                digest.append(hashlib.sha256(left).hexdigest())
                if kept:
                    texts.append(left)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(digest), *[pa.array(texts, pa.binary())] * kept], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept])

    return run


SPANS = "row long, row2 int, first int, end int"


def repeated(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """(row, row2, first, end) byte intervals that repeated windows cover, and the folders that they are read from; ``docs`` has row, row2 and text."""
    spark = docs.sparkSession
    found, at = shared.written(docs.select("row", "row2", "text").mapInArrow(_anchor_rows(length), "fp long, sh long, row long, row2 int, first int, count int, off int"), "anchors")
    by = ["fp", "sh", "row", "row2", "first"]
    kinds, at_kinds = shared.written(found.repartitionByRange(shared.parts(spark), *by).sortWithinPartitions(*by).mapInArrow(_sort_out, "kind int, fp long, row long, row2 int, first int, count int, off int"), "kinds")
    shared.remove(spark, at)
    out = kinds.where("kind = 0").select("row", "row2", "first", (F.col("first") + F.col("count") - 1 + length).cast("int").alias("end"))
    need = kinds.where("kind > 0")
    cells = shared.bit_table(need, F.col("row"), SEEN_BITS)
    wanted = need.groupBy("row", "row2").agg(F.collect_list(F.struct("fp", "first", "count", "off", "kind")).alias("want"))
    packed = docs.select("row", "row2", "text").mapInArrow(_packed(cells), "row long, row2 int, packed binary")
    got = packed.join(wanted.hint("shuffle_hash"), ["row", "row2"]).select("row", "row2", "packed", "want").mapInArrow(_fetch(length, GRAM), SNIPPETS)
    got, there = shared.written(got, "snippets")
    folders = [at_kinds]
    while True:
        big = got.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > block).select("fp")
        none = big.isEmpty()
        few = (got if none else got.join(big, "fp", "left_anti")).repartition(shared.parts(spark), "fp").sortWithinPartitions("fp", "row", "row2", "first")
        near, at = shared.written(few.mapInArrow(_index(length), SPANS), "near")
        out = out.unionByName(near)
        folders.append(at)
        if none:
            shared.remove(spark, there)
            return out, folders
        parts, at = shared.written(got.join(big, "fp", "left_semi").mapInArrow(_halves(length, GRAM), SNIPPETS), "snippets")
        shared.remove(spark, there)
        # parts of a single place hold the same bytes under the same hash
        single, at_single = shared.written(parts.where("lo = hi").mapInArrow(_whole(length), "fp long, h long, row long, row2 int, first int, kind int"), "single")
        often = single.groupBy("fp", "h").agg(F.count("*").alias("n")).where("n > 1").select("fp", "h")
        out = out.unionByName(single.where("kind = 1").join(often, ["fp", "h"], "left_semi").select("row", "row2", "first", (F.col("first") + length).cast("int").alias("end")))
        folders.append(at_single)
        got, there = shared.written(parts.where("lo < hi"), "snippets")
        shared.remove(spark, at)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK, kept: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes)."""
    kind = docs.schema[id_col].dataType.simpleString()
    both = (F.col(id_col), F.col(text_col))
    use = docs.select(F.col(id_col).alias("id"), F.xxhash64(*both).alias("row"), F.hash(*both).alias("row2"), F.col(text_col).alias("text"))
    found, folders = repeated(use, length, block)
    spans, _ = shared.written(found.groupBy("row", "row2").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "spans")
    shared.remove(use.sparkSession, *folders)
    packed = use.mapInArrow(_packed(None), f"id {kind}, row long, row2 int, packed binary")
    out = packed.join(spans.hint("shuffle_hash"), ["row", "row2"], "left").select("id", "packed", "spans")
    out = out.mapInArrow(_cut(length, kept), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept)
    return out.withColumnRenamed("id", id_col)
