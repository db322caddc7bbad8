"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set holds its distinct ``SHINGLE``-word shingles. Its signature has ``K``
coordinates, each the shingle that comes first in one random order. Documents are posted under
(coordinate, value) pairs of the first ``POSTED`` coordinates; two documents whose sets overlap by
``THRESHOLD`` agree in ``AGREE`` of them (short of that with a probability of 7.9e-10 at
``THRESHOLD``; binomial, 40 trials at 0.8). So each posts only the POSTED - AGREE + 1 pairs that are
rarest corpus-wide (prefix), which leaves the long lists out. What the other coordinates would
count is not merged from lists (skip): for a pair that a list gives, all K coordinates are probed on
the two signatures, of which two bits for each coordinate travel with a posting, and
``SKETCH_AGREE`` must agree (short of that with 5.2e-11; 64 trials at 0.85). Pairs with enough
collisions are confirmed on the full sets, exactly.

Rarity comes from shingle counts over all documents in a table of fixed size; an inexact count
changes the order, not the result. Documents with equal sets are one class before posting.

Postings are range-partitioned by list and class, so a long list is spread over partitions, and
streamed. The classes of a list pair up with leaders: the first class takes all that agree with it,
the first of those left takes its own, and so on, in blocks of ``BLOCK`` that share the list's
first class. Once these pairs are confirmed and joined to components, the lists in which a pair
went untested (some class was taken by a leader) and that still hold several components are gone through
again for pairs of different components: a big group of copies gives about one pair
for each copy, and yet no two components that a link joins stay apart. There a class has the parities of
its shingles in ``ODD_BITS`` buckets besides. Two sets differ in at least as many shingles as these differ in
bits, so pairs that differ in too many to overlap by the threshold are left out with certainty: members of a
big group that are alike, but not enough, meet in number as its square, and few of them reach their texts. A list of more than
``WIDE`` * ``BLOCK`` classes is first split by a second and a third shared coordinate: documents that
agree in AGREE share two of their POSTED - AGREE + 2 rarest pairs, three of the next prefix, and so on. That is done
where two classes of the list share less than one other of these pairs on average; in a list of one big group, where they share most, a
split would have each two meet again for each pair that they share. Such lists, and those of
classes that share three of their rarest pairs and are still too long, meet block by block.

Null or wordless text: the set is empty and links with nothing. Rows of one id are judged by
their texts; ``component_id`` is the least id reachable (null only where all ids are). Ties need no order:
results don't depend on it. An empty table gives no rows. Other columns aren't read, so their names may be any.
A text is held whole in one task, at some 40 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk
from .components import components

K, POSTED, AGREE, SHINGLE, THRESHOLD, BLOCK, COUNT_BITS, SEEN_BITS, ODD_BITS = 64, 40, 15, 2, 80, 2048, 18, 22, 1024
SKETCH_AGREE, DEPTH, SHORT, WIDE, SAMPLE = 33, 2, 128, 4, 512
PREFIX = POSTED - AGREE + 1
_rng = np.random.Generator(np.random.PCG64(104729))
A = _rng.integers(0, 2**63, K, dtype=np.int64).astype(np.uint64) * tk.U64(2) + tk.U64(1)
A_INVERSE = np.array([pow(int(a), -1, 1 << 64) for a in A], np.uint64)
B = _rng.integers(0, 2**63, K, dtype=np.int64).astype(np.uint64)


def sets(buf: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingles of each text end to end, their number, words of each text)."""
    n = len(offs) - 1
    s, e, d = tk.spans(buf, offs, tk.NOT_SPACE)
    h = tk.span_hash(tk.eights(buf, tk.LOWER), s, e)
    g, one = tk.grams(h, d, shingle)
    at = tk.first_of(d, n)
    words = np.diff(at)
    out, size = [], np.zeros(n, np.int64)
    for i in np.flatnonzero(words):
        w = words[i]
        x = np.unique(g[at[i] : at[i] + w - shingle + 1]) if w >= shingle else np.array([tk.gram_of([*h[at[i] : at[i] + w], 1])], np.uint64)
        out.append(x)
        size[i] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), size, words


def shingle_counts(docs: DataFrame, text_col: str, bits: int = COUNT_BITS) -> np.ndarray:
    """Documents of each bucket of shingles, over all documents; 2**bits numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            for _, _, buf, offs in tk.slices(b.column(0)):
                x, _, _ = sets(buf, offs)
                total += np.bincount((x >> tk.U64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(shared.PIECES), pa.int32()), pa.array([t.tobytes() for t in np.split(total, shared.PIECES)], pa.binary())], ["piece", "cells"])

    got = shared.summed(docs.select(text_col).mapInArrow(run, "piece int, cells binary"), np.add, "i8")
    return got if len(got) else np.zeros(1 << bits, np.int64)


def signatures(x: np.ndarray, size: np.ndarray, counts: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(posting keys, two-longs sketch) of the non-empty sets: keys of the ``keep`` rarest posted coordinates, rarest first."""
    first = np.cumsum(size) - size
    v = np.empty((len(size), K), np.uint64)
    for k in range(K):
        v[:, k] = np.minimum.reduceat(x * A[k] + B[k], first)
    was = (v - B) * A_INVERSE
    key = tk.mix(was + (np.arange(K, dtype=np.uint64) + tk.U64(1)) * tk.U64(0xC2B2AE3D27D4EB4F))
    posted = was[:, :POSTED]
    rarity = counts[(posted >> tk.U64(65 - int(len(counts)).bit_length())).astype(np.int64)]
    by = np.lexsort((key[:, :POSTED], rarity), axis=1)[:, :keep]
    two = key >> tk.U64(62)
    sketch = np.zeros((len(size), 2), np.uint64)
    for k in range(K):
        sketch[:, k // 32] |= two[:, k] << tk.U64(2 * (k % 32))
    return np.take_along_axis(key, by, 1), sketch


def parities(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each bucket that a set's mixed shingles ``x`` fall in, whether their number is odd; ``ODD_BITS`` / 8 bytes a set."""
    at, ends = (x >> tk.U64(65 - ODD_BITS.bit_length())).astype(np.int64), np.cumsum(size)
    out = np.zeros((len(size), ODD_BITS // 8), np.uint8)
    for lo in range(0, len(size), 256):
        own = size[lo : lo + 256]
        many = np.bincount(np.repeat(np.arange(len(own)) * ODD_BITS, own) + at[ends[lo] - own[0] : ends[lo + len(own) - 1]], minlength=len(own) * ODD_BITS)
        out[lo : lo + 256] = np.packbits((many & 1).astype(bool).reshape(-1, ODD_BITS), axis=1)
    return out


def _sign(counts: np.ndarray, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column(3)):
                x, size, words = sets(buf, offs)
                n = hi - lo
                h1, h2, keys, sk = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, keep), np.uint64), np.zeros((n, 2), np.uint64)
                odd = np.zeros((n, ODD_BITS // 8), np.uint8)
                some = np.flatnonzero(size)
                if len(some):
                    first = (np.cumsum(size) - size)[some]
                    mixed = tk.mix(x)
                    odd = parities(mixed, size)
                    h1[some], h2[some] = np.add.reduceat(mixed, first), np.add.reduceat(tk.mix(x ^ tk.U64(0x5DEECE66D)), first)
                    keys[some], sk[some] = signatures(x, size[some], counts, keep)
                yield pa.RecordBatch.from_arrays(
                    [*(c[lo:hi] for c in b.columns[:3]), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sk[:, 0].copy().view(np.int64)), pa.array(sk[:, 1].copy().view(np.int64)), tk.list_array(pa.array(keys.view(np.int64).ravel()), np.full(n, keep)), pa.array([o.tobytes() for o in odd], pa.binary())],
                    ["id", "row", "row2", "n", "h1", "h2", "s1", "s2", "keys", "odd"],
                )

    return run


def agreements(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """In how many coordinates the sketches of two arrays agree, row by row."""
    out = np.full(len(t), K, np.int64)
    for i in range(s.shape[1]):
        x = s[:, i] ^ t[:, i]
        out -= np.bitwise_count((x | (x >> tk.U64(1))) & tk.U64(0x5555555555555555))
    return out


def most(both: np.ndarray, threshold: int) -> np.ndarray:
    """In how many shingles two sets that overlap enough differ at most, given the sum of their sizes."""
    return both * (100 - threshold) // (100 + threshold)


class Rows:
    """Classes of lists, list by list: class number, set size, sketch and, in the second round, component and parities (a row for each long)."""

    def __init__(self, row: np.ndarray, n: np.ndarray, sketch: np.ndarray, threshold: int, odd: np.ndarray | None = None) -> None:
        self.row, self.n, self.sketch, self.threshold, self.odd = row, n, sketch, threshold, odd

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = self.n[a], self.n[b]
        ok = 100 * np.minimum(n, m) >= self.threshold * np.maximum(n, m)
        at = np.flatnonzero(ok)
        ok[at] = agreements(self.sketch[a[at]], self.sketch[b[at]]) >= SKETCH_AGREE
        if self.odd is not None:
            at = np.flatnonzero(ok)
            p, q, differ = a[at], b[at], np.zeros(len(at), np.uint16)
            for longs in self.odd:
                differ += np.bitwise_count(longs[p] ^ longs[q])
            ok[at] = differ <= most(n[at] + m[at], self.threshold)
        return ok

    def led(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leader, taken) places; ``group`` numbers the lists, ascending. All lists go through a round together: their first class takes what agrees with it."""
        left = np.arange(len(group))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(left):
            g = group[left]
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            first = np.flatnonzero(new)
            lead = np.repeat(left[first], np.diff(np.append(first, len(g))))[~new]
            left = left[~new]
            hit = self.agree(lead, left)
            out.append((lead[hit], left[hit]))
            left = left[~hit]
        return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.zeros(0, np.int64),) * 2

    def across(self, group: np.ndarray, label: np.ndarray, own: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of places in one list that differ in component, and in block where the list isn't ``within`` one, and agree."""
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        many = np.diff(np.append(first, len(group)))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        # short lists go through a step together, long ones place by place
        at = np.flatnonzero(np.repeat(many, many) <= SHORT)
        for step in range(1, SHORT):
            at = at[: np.searchsorted(at, len(group) - step)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            two = at[(label[at] != label[at + step]) & (within[at] | (own[at] != own[at + step]))]
            hit = two[self.agree(two, two + step)]
            out.append((hit, hit + step))
        for lo, hi in ((f, f + m) for f, m in zip(first, many, strict=True) if m > SHORT):
            by = lo + np.argsort(own[lo:hi], kind="stable")
            part = Rows(self.row[by], self.n[by], self.sketch[by], self.threshold, self.odd[:, by])
            label_, other, whole = label[by], int((own[by] == own[by[0]]).sum()), within[lo]
            for i in range(hi - lo - 1 if whole else other if other < hi - lo else 0):
                j = (i + 1 if whole else other) + part.agreeing(i, i + 1 if whole else other, label_)
                out.append((np.repeat(by[i], len(j)), by[j]))
        return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.zeros(0, np.int64),) * 2

    def agreeing(self, i: int, lo: int, label: np.ndarray) -> np.ndarray:
        """The places from ``lo`` on, less ``lo``, that differ from place i in component, and agree with it."""
        n, m, t = self.n[i], self.n[lo:], self.threshold
        ok = (label[lo:] != label[i]) & (100 * m >= t * n) & (t * m <= 100 * n)
        ok &= agreements(self.sketch[i : i + 1], self.sketch[lo:]) >= SKETCH_AGREE
        differ = np.bitwise_count(self.odd[:, lo:] ^ self.odd[:, i : i + 1]).sum(0, dtype=np.uint16)
        return np.flatnonzero(ok & (differ <= most(n + m, t)))


PAIR, LATER, EDGE = 0, 1, 2


def _stream(threshold: int, block: int):
    """Sorted postings (key, row, n, s1, s2) to (kind, key, a, b): pairs to confirm; classes of lists that the second round goes through; the first class of a list at a partition's edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)
        lead = None  # the first row of the list that ``held`` goes on with, where a part of it is done
        opening, first_key = True, None

        def put(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), *(pa.array(x, pa.int64()) for x in (key, a, b))], ["kind", "key", "a", "b"])

        def work(c: np.ndarray, whole: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Lists at ``c``; ``whole`` tells of each row whether all of its list is there."""
            if not len(c):
                return
            new = np.ones(len(c), bool)
            new[1:] = c[1:, 0] != c[:-1, 0]
            group = np.cumsum(new) - 1
            many = np.bincount(group)
            rows = Rows(c[:, 1], c[:, 2], np.ascontiguousarray(c[:, 3:5]).view(np.uint64), threshold)
            use = np.flatnonzero(many[group] > 1)
            a, b = Rows(rows.row[use], rows.n[use], rows.sketch[use], threshold).led(group[use])
            a, b = use[a], use[b]
            if len(a):
                pair = np.unique(np.sort(np.stack([rows.row[a], rows.row[b]]), axis=0), axis=1)
                pair = pair[:, pair[0] != pair[1]]
                yield put(PAIR, np.zeros(pair.shape[1], np.int64), pair[0], pair[1])
            # two classes in a list, or classes that no leader took, have all been compared
            met = np.zeros(len(many), bool)
            met[group[b]] = True
            later = np.flatnonzero((met[group] & (many[group] > 2)) | ~whole)
            if len(later):
                yield put(LATER, c[later, 0], c[later, 1], np.zeros(len(later), np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.concatenate([held, np.stack([np.asarray(x).astype(np.int64) for x in batch.columns], 1)])
            if first_key is None:
                first_key = c[0, 0]
                yield put(EDGE, c[:1, 0], c[:1, 1], np.zeros(1, np.int64))
            cut = len(c) - int((c[:, 0] == c[-1, 0]).sum())
            done, held = c[:cut], c[cut:]
            if len(done):
                whole = np.ones(len(done), bool)
                if opening:
                    whole[done[:, 0] == first_key] = False
                    opening = False
                if lead is not None:
                    same = done[:, 0] == lead[0]
                    whole[same] = False
                    done, whole = np.concatenate([lead[None], done]), np.append(False, whole)
                    lead = None
                yield from work(done, whole)
            while len(held) > block:
                part, held = held[:block], held[block:]
                lead = part[0] if lead is None else lead
                c = np.concatenate([lead[None], part])
                yield from work(c, np.zeros(len(c), bool))
        if len(held):
            if first_key != held[0, 0]:
                yield put(EDGE, held[:1, 0], (held[:1, 1] if lead is None else lead[1:2]), np.zeros(1, np.int64))
            if lead is not None:
                held = np.concatenate([lead[None], held])
            yield from work(held, np.zeros(len(held), bool))

    return run


def _again(threshold: int):
    """Pairs of different components in sorted lists (key, i, j, row, label, n, s1, s2, own, odd) of 2 * WIDE * BLOCK classes or so at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_odd = np.zeros((0, 9), np.int64), np.zeros((0, ODD_BITS // 64), np.uint64)

        def work(c: np.ndarray, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(c):
                return
            new = np.ones(len(c), bool)
            new[1:] = (c[1:, :3] != c[:-1, :3]).any(1)
            a, b = Rows(c[:, 3], c[:, 5], np.ascontiguousarray(c[:, 6:8]).view(np.uint64), threshold, np.ascontiguousarray(odd.T)).across(np.cumsum(new), c[:, 4], c[:, 8], c[:, 1] == c[:, 2])
            if len(a):
                pair = np.unique(np.sort(np.stack([c[a, 3], c[b, 3]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.concatenate([held, np.stack([np.asarray(x).astype(np.int64) for x in batch.columns[:9]], 1)])
            odd = np.concatenate([held_odd, np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint64).reshape(batch.num_rows, -1)])
            cut = len(c) - int((c[:, :3] == c[-1, :3]).all(1).sum())
            held, held_odd = c[cut:], odd[cut:]
            yield from work(c[:cut], odd[:cut])
        yield from work(held, held_odd)

    return run


def _texts(cells: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, z = np.unpackbits(cells).astype(bool), zstandard.ZstdCompressor(level=3)
        for b in batches:
            at = pa.array(np.flatnonzero(tk.in_bloom(flags, np.asarray(b.column(0)).view(np.uint64))))
            if len(at):
                c = b.take(at)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([z.compress((x or "").encode()) for x in c.column(2).to_pylist()], pa.binary())], ["row", "row2", "packed"])

    return run


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                c = [x[lo : lo + 512] for x in b.columns]
                a, o = np.asarray(c[0]), np.asarray(c[1])
                texts: dict[int, bytes] = {}
                for r, p in ((a, c[2]), (o, c[3])):
                    for i, x in enumerate(r.tolist()):
                        if x not in texts:
                            texts[x] = z.decompress(p[i].as_py())
                found = {}
                names = list(texts)
                for first, last, buf, offs in tk.slices(pa.array(list(texts.values()), pa.large_binary())):
                    x, size, _ = sets(buf, offs)
                    ends = np.cumsum(size)
                    for i in range(first, last):
                        found[names[i]] = x[ends[i - first] - size[i - first] : ends[i - first]]
                ok = []
                for i, j in zip(a.tolist(), o.tolist(), strict=True):
                    p, q = found[i], found[j]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(100 * both >= threshold * (len(p) + len(q) - both))
                keep = pa.array(np.flatnonzero(ok))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([c[0].take(keep), c[1].take(keep)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, str]:
    """The (a, b) of ``pairs`` of classes whose full sets overlap enough, and where they are; ``docs`` has row, row2 and text."""
    spark = pairs.sparkSession
    need = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    need, there = shared.written(classes.select("cid", "row", "row2").join(need.hint("shuffle_hash"), "cid", "left_semi"), "needed")
    flags = shared.bit_table(need, F.col("row"), SEEN_BITS)
    # a repeated row gives its text once
    texts = docs.select("row", "row2", "text").mapInArrow(_texts(flags, SEEN_BITS), "row long, row2 int, packed binary").groupBy("row", "row2").agg(F.first("packed").alias("packed"))
    texts, at = shared.written(texts.join(need, ["row", "row2"]).select("cid", "packed"), "texts")
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("packed").alias("pa")), "a").join(texts.select(F.col("cid").alias("b"), F.col("packed").alias("pb")), "b")
    out = shared.written(both.select("a", "b", "pa", "pb").mapInArrow(_confirm(threshold), "a long, b long"), "links")
    shared.remove(spark, at, there)
    return out


def _splitting(many: DataFrame, classes: DataFrame, keys: int) -> DataFrame:
    """Of the lists ``many`` the keys of those that a further coordinate makes cheaper: two classes share less than one other of ``keys`` pairs on average, by a sample of some ``SAMPLE`` classes of each list."""
    some = many.where(F.pmod(F.xxhash64("cid", F.lit(11)), F.ceil(F.col("m") / SAMPLE)) == 0)
    others = some.join(classes.select("cid", F.slice("keys", 1, keys).alias("keys")), "cid").select("key", F.explode(F.array_except("keys", "used")).alias("one"))
    met = others.groupBy("key", "one").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("met"))
    size = some.groupBy("key").agg(F.count("*").alias("s"))
    return size.join(met, "key", "left").where(F.coalesce("met", F.lit(0)) < F.col("s") * (F.col("s") - 1)).select("key")


def _second_round(rows: DataFrame, classes: DataFrame, threshold: int) -> tuple[DataFrame, list[str]]:
    """Pairs (a, b) of different components in the lists of ``rows`` (key, cid, label), and the folders that they are read from."""
    spark = rows.sparkSession
    rows = rows.withColumn("used", F.array("key"))
    found, folders = None, []
    for depth in range(DEPTH + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "m")
        mixed, at = shared.written(rows.join(sizes, "key"), "mixed")
        keys = PREFIX + 1 + depth
        split, at_split = shared.written(_splitting(mixed.where(F.col("m") > WIDE * BLOCK), classes, keys), "split") if depth < DEPTH else (None, None)
        last = split is None or split.isEmpty()
        lists = (mixed if last else mixed.join(split, "key", "left_anti")).join(classes.select("cid", "n", "s1", "s2", "odd"), "cid")
        blocks = F.ceil(F.col("m") / (WIDE * BLOCK)).cast("int")
        lists = lists.withColumn("own", F.pmod(F.xxhash64("cid", F.lit(5)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        lists = lists.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("cid").alias("row"), "label", "n", "s1", "s2", "own", "odd")
        lists = lists.repartition(shared.parts(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "row")
        pairs, there = shared.written(lists.mapInArrow(_again(threshold), "a long, b long").distinct(), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        folders.append(there)
        if last:
            shared.remove(spark, at, *([at_split] if at_split else []))
            return found.distinct(), folders
        # a class joins, in place of a list too long, the lists of that and one more of its rarest pairs
        more = mixed.join(split, "key").join(classes.select("cid", F.slice("keys", 1, keys).alias("keys")), "cid")
        more = more.select("cid", "label", "used", F.explode(F.array_except("keys", "used")).alias("one")).withColumn("used", F.array_sort(F.concat("used", F.array("one"))))
        rows, there = shared.written(more.select(F.xxhash64("used").alias("key"), "cid", "label", "used").distinct(), "refined")
        folders.append(there)
        shared.remove(spark, at, at_split)
    raise AssertionError


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept (its id is its component's least), and row, row2 (hashes of id and text)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    both = (F.col(id_col), F.col(text_col))
    use = docs.select(F.col(id_col).alias("id"), F.xxhash64(*both).alias("row"), F.hash(*both).alias("row2"), F.col(text_col).alias("text"))
    counts = shingle_counts(use, "text")
    signed, _ = shared.written(use.mapInArrow(_sign(counts, PREFIX + DEPTH), f"id {kind}, row long, row2 int, n long, h1 long, h2 long, s1 long, s2 long, keys array<long>, odd binary"), "signed")
    by = ["h1", "h2", "n"]
    one = F.min(F.struct("row", "row2", "s1", "s2", "keys", "odd"))
    made = signed.where("n > 0").groupBy(*by).agg(F.min("id").alias("id"), one.alias("x")).select(*by, "id", "x.*").withColumn("cid", F.monotonically_increasing_id())
    classes, at_classes = shared.written(made, "classes")  # numbered as written
    posted = classes.select(F.explode(F.slice("keys", 1, PREFIX)).alias("key"), F.col("cid").alias("row"), "n", "s1", "s2")
    lists = posted.repartitionByRange(shared.parts(spark), "key", "row").sortWithinPartitions("key", "row")
    found, at_found = shared.written(lists.mapInArrow(_stream(threshold, BLOCK), "kind int, key long, a long, b long"), "found")
    edge = found.where(F.col("kind") == EDGE).select("key", "a")  # two for each partition at most
    edges = edge.groupBy("key").agg(F.min("a").alias("least"), F.count("*").alias("m")).where("m > 1").join(edge, "key").where("least < a").select(F.col("least").alias("a"), F.col("a").alias("b"))
    pairs, at_pairs = shared.written(found.where(F.col("kind") == PAIR).select("a", "b").unionByName(edges).distinct(), "pairs")
    links, at_links = confirmed(pairs, classes, use, threshold)
    label = components(links)
    shared.remove(spark, at_pairs, at_links)
    later = found.where(F.col("kind") == LATER).select("key", F.col("a").alias("cid")).distinct()
    shown = later.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    more, folders = _second_round(shown, classes, threshold)
    more, at_more = shared.written(more, "pairs")
    shared.remove(spark, at_found, *folders)
    named = classes.select(*by, "id", "cid").join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    if not more.isEmpty():
        links, at_links = confirmed(more, classes, use, threshold)
        # components of the first round's components
        of = label.select("node", "label")
        for end in ("a", "b"):
            links = links.join(of.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
        wider = components(links.select("a", "b"))
        shared.remove(spark, at_links)
        named = named.join(wider.select(F.col("node").alias("label"), F.col("label").alias("wider")), "label", "left").withColumn("label", F.coalesce("wider", "label"))
    shared.remove(spark, at_more)
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of, _ = shared.written(named.join(least, "label").select(*by, "component_id"), "named")
    shared.remove(spark, at_classes)
    out = signed.select("id", "row", "row2", *by).join(of, by, "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "row", "row2")
