"""Token ids as binary files: canonical length-limited Huffman codes from global counts.

``Encoder`` turns whole texts into ids with the tokenizers library. Where the tokenizer begins anew at
white space and at borders of ASCII letters or digits with ASCII marks other than the apostrophe,
which ``Encoder`` tries out, a text is cut there; distinct pieces are encoded once and remembered, which gives
the ids of the whole text. Pieces are one if their bytes are (in a slice) or 128 bits of hashes (between
slices). Texts for any other tokenizer are encoded as they are.

Writing: ids go to a table in the shared folder, which is removed at the end; their counts (a
row for each vocabulary entry at most) reach the driver; a package-merge gives lengths of
``MAX_BITS`` at most; a second pass over the ids encodes each document to
whole bytes with a bit-offset checkpoint every ``STEP`` ids; documents are range-partitioned
by id and each partition writes one file of independent blocks of whole documents. A task
writes to a name of its own, and only files whose task succeeded are in the manifest. Reading
decodes all checkpoint intervals of a block side by side through one table.

File: b"TMHF", u32 length of the zlib-packed code lengths (a byte for each id), these, then
blocks: u32 documents, u32 checkpoints, u32 payload bytes, i64 ids, u8 id-is-set, u32 tokens of
each document, u16 bits of each interval, payload. Little-endian.

Null text: empty, so only the end id. Ids are longs (other types: TypeError); null ones come first.
Rows of one document id all stay, in the order of their texts' hashes, and are spread over as many files as they
need. An empty table gives no files and no rows. Columns besides id and text aren't read, so their names may
be any. A text is held whole in one task, at some 60 bytes for each of its bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk

MAX_BITS, STEP, BLOCK_IDS = 18, 64, 1 << 20
_KIND = np.zeros(256, np.uint8)  # 0 white space, 1 ASCII letter or digit, 2 ASCII mark, 3 apostrophe or not ASCII
_KIND[:128] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[39, *range(128, 256)]] = 3
_KIND[tk.SPACE] = 0
CACHE_UNITS = 1_000_000


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the pieces that are tokenised by themselves."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    k = _KIND[buf]
    turn = np.ones(n + 1, bool)
    turn[1:n] = (k[1:] == 0) | (k[:-1] == 0) | (k[1:] + k[:-1] == 3) & (k[1:] != 3) & (k[:-1] != 3)
    turn[offs] = True
    at = np.flatnonzero(turn)
    s, e = at[:-1], at[1:]
    ok = k[s] != 0
    s, e = s[ok], e[ok]
    return s, e, np.searchsorted(offs[1:], s, "right")


class Encoder:
    """Ids of texts, with distinct pieces remembered up to ``CACHE_UNITS``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        mark = self.tok.encode("\x01", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.fold = tk.LOWER if self._ids("Ab ZX") == self._ids("ab zx") else tk.SAME
        probes = ("ab", "Zx's", "12", "é漢", ",", "(!", "_"), ("ab", ",", "1a", "...", "é'"), ("the", "!", "of")
        self.cuts = all(self._ids(" ".join(x)) == [i for u in x for i in self._ids(u)] for x in probes)
        self.cuts &= all(self._ids("".join(x)) == [i for u in x for i in self._ids(u)] for x in probes[1:])
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place, self.check = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keeps the pieces that most slices used, a third at most."""
        least = np.partition(self.used, -len(self.used) // 3)[-len(self.used) // 3]
        keep = self.used > least
        at = np.flatnonzero(keep)
        c = self.count[at]
        o = np.cumsum(c) - c
        self.pool = self.pool[np.arange(int(c.sum())) - np.repeat(o, c) + np.repeat(self.start[at], c)]
        self.start, self.count, self.used = o, c, self.used[at] // 2
        kept = keep[self.place]
        number = np.cumsum(keep) - 1
        self.keys, self.place, self.check = self.keys[kept], number[self.place[kept]], self.check[kept]

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, their number for each)."""
        pools, counts = [], []
        for lo in range(0, len(s), 4096):
            a, size = s[lo : lo + 4096], e[lo : lo + 4096] - s[lo : lo + 4096]
            wide = size + 3
            out = np.full(int(wide.sum()), 32, np.uint8)
            begin = np.cumsum(wide) - wide
            out[begin + size + 1] = 1
            src = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(begin, size) + src] = buf[np.repeat(a, size) + src]
            got = None
            if self.mark is not None:
                ids = np.array(self._ids(out.tobytes().decode()), np.int32)
                ends = np.flatnonzero(ids == self.mark)
                if len(ends) == len(a):
                    got = np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
            if got is None:
                each = [self._ids(bytes(buf[x : x + y]).decode()) for x, y in zip(a, size, strict=True)]
                got = np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)
            pools.append(got[0])
            counts.append(got[1])
        return np.concatenate(pools), np.concatenate(counts)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number for each text)."""
        n = len(offs) - 1
        raw = buf.tobytes()

        def whole() -> tuple[np.ndarray, np.ndarray]:
            each = [self._ids(raw[a:b].decode()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)

        if not self.cuts or any(x in raw for x in self.special):
            return whole()
        s, e, d = units(buf, offs)
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        w = tk.eights(buf, self.fold)
        uniq, one, back = np.unique(tk.span_hash(w, s, e), return_index=True, return_inverse=True)
        size = e - s
        check = tk.span_hash(w, s[one], e[one], 1)
        near = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
        known = self.keys[near] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        if (size != size[one][back]).any() or not tk.same_bytes(w, s, w, s[one][back], size).all() or (known.any() and (self.check[near[known]] != check[known]).any()):
            return whole()  # two pieces of one hash
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > CACHE_UNITS and len(self.keys):
                self._forget()
                near = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
                known = self.keys[near] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
                new = np.flatnonzero(~known)
            pool, count = self._learn(buf, s[one[new]], e[one[new]])
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(count) - count])
            place = len(self.count) + np.arange(len(new))
            self.count = np.concatenate([self.count, count])
            self.pool = np.concatenate([self.pool, pool])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
            at = np.searchsorted(self.keys, uniq[new])
            self.keys, self.place, self.check = np.insert(self.keys, at, uniq[new]), np.insert(self.place, at, place), np.insert(self.check, at, check[new])
        place = self.place[np.searchsorted(self.keys, uniq)]
        self.used[place] += 1
        which = place[back]
        c = self.count[which]
        o = np.cumsum(c)
        ids = self.pool[np.arange(int(o[-1])) - np.repeat(o - c, c) + np.repeat(self.start[which], c)]
        return ids, np.bincount(d, c, minlength=n).astype(np.int64)

    def with_end(self, buf: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        ids, count = self(buf, offs)
        out = np.full(len(ids) + len(count), end, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
        return out, count + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of ``limit`` bits at most, by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    n, m = len(leaf), len(leaf)
    # marks[level]: for the items in order of weight, which are leaves
    level, weights = [], leaf
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        o = np.argsort(both, kind="stable")
        level.append(o < n)
        weights = both[o]
    take, length = 2 * (n - 1), np.zeros(m, np.int64)
    for leaves in reversed(level):
        chosen = leaves[:take]
        k = int(chosen.sum())
        length[:k] += 1
        take = 2 * (take - k)
    length[:take] += 1
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    top = int(size.max(initial=0))
    step = np.cumsum(1 << (top - size)) - (1 << (top - size)) if len(size) else size
    codes[order] = step >> (top - size)
    return codes


def pack(ids: np.ndarray, count: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bytes of each document, bits of each interval, intervals of each document)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    first = np.cumsum(count) - count
    begin = end[first] - size[first]
    bits = end[first + count - 1] - begin
    nbytes = (bits + 7) // 8
    base = (np.cumsum(nbytes) - nbytes) * 8
    pos = end - size + np.repeat(base - begin, count)
    word = pos >> 5
    value = codes[ids].astype(np.uint64) << (tk.U64(64) - size.astype(np.uint64) - (pos & 31).astype(np.uint64))
    cut = np.flatnonzero(np.diff(word, prepend=-1))
    total = np.add.reduceat(value, cut)
    w = word[cut]
    out = np.zeros(int(nbytes.sum()) // 4 + 3, np.uint32)
    out[w] |= (total >> tk.U64(32)).astype(np.uint32)
    out[w + 1] |= total.astype(np.uint32)
    parts = -(-count // STEP)
    inner = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    a = np.repeat(first, parts) + inner * STEP
    b = np.minimum(a + STEP, np.repeat(first + count, parts))
    return out.byteswap().view(np.uint8)[: int(nbytes.sum())], nbytes, (end[b - 1] - end[a] + size[a]).astype(np.uint16), parts


class Decoder:
    def __init__(self, lengths: np.ndarray) -> None:
        codes = canonical_codes(lengths)
        self.bits = max(1, int(lengths.max(initial=1)))
        self.table = np.zeros(1 << self.bits, np.int32)
        self.size = np.ones(1 << self.bits, np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = 1 << (self.bits - lengths[order].astype(np.int64))
        filled = int(span.sum())
        self.table[:filled] = np.repeat(order, span)
        self.size[:filled] = np.repeat(lengths[order].astype(np.int64), span)
        assert not len(order) or codes[order[0]] == 0

    def __call__(self, payload: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of intervals that begin at bits ``begin`` and have ``n`` ids each, end to end."""
        data = np.concatenate([payload, np.zeros(16, np.uint8)])
        wide = np.zeros(len(data) - 8, np.uint64)  # 40 bits from each byte on would do
        for j in range(5):
            wide = (wide << tk.U64(8)) | data[j : j + len(wide)]
        order = np.argsort(-n, kind="stable")
        pos, count = begin[order].copy(), n[order]
        at = (np.cumsum(n) - n)[order]
        out = np.zeros(int(n.sum()), np.int32)
        active = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1 if len(count) else 1), "right")
        for i, k in enumerate(active):
            p = pos[:k]
            x = (wide[p >> 3] >> (tk.U64(40 - self.bits) - (p & 7).astype(np.uint64))) & tk.U64((1 << self.bits) - 1)
            x = x.astype(np.int64)
            out[at[:k] + i] = self.table[x]
            pos[:k] += self.size[x]
        return out


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    o = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=o[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(values))])


def _tokens(path: str, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column(3)):
                ids, count = enc.with_end(buf, offs, end)
                ids = ids.astype(kind)
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[:3]), pa.array(count.astype(np.int32)), _binary(ids.view(np.uint8), count * ids.itemsize)], ["bucket", "id", "row", "n", "ids"])

    return run


def _flat(ids: pa.Array, kind: str) -> np.ndarray:
    o = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    return np.frombuffer(ids.buffers()[2], np.uint8)[o[0] : o[-1]].view(kind)


def _counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(_flat(b.column(0), kind), minlength=len(total)) if b.num_rows else np.zeros(len(total), np.int64)
            c[: len(total)] += total
            total = c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token", "n"])

    return run


def _encoded(kind: str, lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                c = [x[lo : lo + 1024] for x in b.columns]
                count = np.asarray(c[3]).astype(np.int64)
                data, nbytes, bits, parts = pack(_flat(c[4], kind), count, lengths, codes)
                yield pa.RecordBatch.from_arrays([*c[:4], _binary(data, nbytes), _binary(bits.view(np.uint8), parts * 2)], ["bucket", "id", "row", "n", "data", "marks"])

    return run


def _writer(uri: str, lengths: np.ndarray):
    head = zlib.compress(lengths.tobytes(), 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        at, done = None, []
        ctx = TaskContext.get()

        def block(rows: list[tuple]) -> bytes:
            ids = np.array([r[0] or 0 for r in rows], np.int64)
            return b"".join([
                struct.pack("<III", len(rows), sum(len(r[3]) // 2 for r in rows), sum(len(r[2]) for r in rows)), ids.tobytes(), np.array([r[0] is not None for r in rows], np.uint8).tobytes(),
                np.array([r[1] for r in rows], np.uint32).tobytes(), *(r[3] for r in rows), *(r[2] for r in rows),
            ])

        def finish(state: list) -> None:
            if state[3]:
                state[1].write(block(state[3]))
            state[1].close()
            done.append((state[0], state[2], state[4], state[5]))

        state = None  # bucket, stream, path, rows, documents, ids
        for b in batches:
            for bucket, i, _row, n, data, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or state[0] != bucket:
                    if state:
                        finish(state)
                    fs, root = pfs.FileSystem.from_uri(uri)
                    fs.create_dir(root, recursive=True)
                    name = f"part-{bucket:06d}-{ctx.attemptNumber()}-{uuid.uuid4().hex[:8]}.tmhf"
                    state = [bucket, fs.open_output_stream(f"{root}/{name}"), f"{uri}/{name}", [], 0, 0]
                    state[1].write(b"TMHF" + struct.pack("<I", len(head)) + head)
                    held = 0
                state[3].append((i, n, data, marks))
                state[4] += 1
                state[5] += n
                held += n
                if held >= BLOCK_IDS:
                    state[1].write(block(state[3]))
                    state[3], held = [], 0
        if state:
            finish(state)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done]), pa.array([d[2] for d in done], pa.int64()), pa.array([d[3] for d in done], pa.int64())], ["bucket", "path", "n_docs", "n_ids"])

    return run


def write(docs: DataFrame, uri: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, max_bits: int = MAX_BITS) -> DataFrame:
    """Writes the files of ``docs`` under ``uri``; gives their manifest (bucket, path, n_docs, n_ids)."""
    spark = docs.sparkSession
    n = shared.parts(spark)
    if docs.schema[id_col].dataType.simpleString() != "bigint":
        raise TypeError(f"{id_col} must be a long")
    place = F.coalesce(F.col(id_col), F.lit(-(1 << 63)).cast("long"))  # null ids come first
    cuts = docs.select(F.percentile_approx(place, [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    cuts = sorted(cuts or [])
    use = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    bucket = F.lit(0)
    if cuts:
        # an id that several cuts fall on has as many buckets more, by the hash of the text
        place = F.coalesce(F.col("id"), F.lit(-(1 << 63)).cast("long"))
        same = F.size(F.filter(F.lit(cuts), lambda c: c == place))
        bucket = F.size(F.filter(F.lit(cuts), lambda c: c < place)) + F.floor((F.col("row") / F.lit(2.0**64) + 0.5) * (same + 1))
    use = use.select(F.least(bucket, F.lit(len(cuts))).cast("int").alias("bucket"), "id", "row", "text")
    kind = "<u2" if encoder(tokenizer).tok.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
    sql = docs.schema[id_col].dataType.simpleString()
    ids, at = shared.written(use.mapInArrow(_tokens(tokenizer, end, kind), f"bucket int, id {sql}, row long, n int, ids binary"), "ids")
    rows = ids.select("ids").mapInArrow(_counts(kind), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max([r["token"] for r in rows], default=0), np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    coded = ids.mapInArrow(_encoded(kind, lengths), f"bucket int, id {sql}, row long, n int, data binary, marks binary")
    placed = coded.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "id", "row", "n")
    placed.mapInArrow(_writer(f"{uri}/files", lengths), "bucket int, path string, n_docs long, n_ids long").write.parquet(f"{uri}/manifest")
    shared.remove(spark, at)
    return spark.read.schema("bucket int, path string, n_docs long, n_ids long").parquet(f"{uri}/manifest")


def blocks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, which are set, ids of each, ids) of each block of a file."""
    from pyarrow import fs as pfs

    fs, at = pfs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, buffer_size=1 << 20) as f:
        if f.read(4) != b"TMHF":
            raise ValueError(f"{path} isn't a token file")
        decode = Decoder(np.frombuffer(zlib.decompress(f.read(struct.unpack("<I", f.read(4))[0])), np.uint8))
        while head := f.read(12):
            n, marks, size = struct.unpack("<III", head)
            ids, given, count = np.frombuffer(f.read(8 * n), np.int64), np.frombuffer(f.read(n), np.uint8), np.frombuffer(f.read(4 * n), np.uint32).astype(np.int64)
            bits = np.frombuffer(f.read(2 * marks), np.uint16).astype(np.int64)
            payload = np.frombuffer(f.read(size), np.uint8)
            parts = -(-count // STEP)
            last = np.cumsum(parts)
            of = np.add.reduceat(bits, last - parts)
            nbytes = (of + 7) // 8
            ends = np.cumsum(bits)
            begin = ends - bits + np.repeat((np.cumsum(nbytes) - nbytes) * 8 - (ends[last - 1] - of), parts)
            inner = np.full(marks, STEP, np.int64)
            inner[last - 1] = count - (parts - 1) * STEP
            yield ids, given, count, decode(payload, begin, inner)


def read(manifest: DataFrame) -> DataFrame:
    """Per document, in file order within its file: doc_id, start, n_tokens, ids_crc32; from the files alone."""
    spark = manifest.sparkSession
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for ids, given, count, tokens in blocks(path):
                    o = np.concatenate([[0], np.cumsum(count)])
                    raw = memoryview(tokens.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(o[:-1], o[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=given == 0), pa.array(base + o[:-1], pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    base += int(o[-1])

    return files.select("path", "base").repartition(shared.parts(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, **options: object) -> DataFrame:
    """Writes to the shared folder and reads back."""
    return read(write(docs, shared.path(spark, "tokens"), tokenizer, **options))
