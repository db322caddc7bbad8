"""Numpy kernels over Arrow batches: tokens of texts as numbers, and running top-k lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; what is made of them takes some 40 times as much.
SLICE = 1 << 20
U64 = np.uint64
_ASCII = np.zeros(256, bool)
_ASCII[[*range(48, 58), *range(97, 123)]] = True
#: Lead bytes whose characters all count: U+00C0-U+023F, U+0400-U+04FF, U+5000-U+9FFF.
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0xC3, 0xC9), *range(0xD0, 0xD4), *range(0xE5, 0xEA)]] = True
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a null one is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, ob, db = texts.buffers()
    offs = np.frombuffer(ob, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(db, np.uint8) if db is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def token_bytes(buf: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased UTF-8 belong to token characters."""
    m = _ASCII[buf]
    if len(buf) and buf.max() >= 128:
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        b0 = buf[lead]
        b1 = buf[np.minimum(lead + 1, len(buf) - 1)]
        ok = _ASCII[b0] | _LEAD[b0] | ((b0 == 0xC9) & (b1 <= 0x8F)) | ((b0 == 0xE4) & (b1 >= 0xB8))
        m = np.repeat(ok, np.diff(np.append(lead, len(buf))))
    return m


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end, text) of the tokens of lower-cased texts."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z
    m = token_bytes(buf)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1] | edge[1:n]
    last[:-1] &= ~m[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = buf
    w = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    size = e - s
    h = _mix(w[s] & _FIRST[np.minimum(size, 8)])
    more = np.flatnonzero(size > 8)
    k = 8
    while len(more):
        h[more] = _mix(h[more] ^ (w[s[more] + k] & _FIRST[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    return _mix(h + size.astype(np.uint64)), s, e, np.searchsorted(offs[1:], s, "right")


def hash_of(token: str) -> int:
    """The hash of one lower-cased token, as a signed number."""
    raw = np.frombuffer(token.encode(), np.uint8)
    h = tokens(raw, np.array([0, len(raw)]))[0]
    return int(h.view(np.int64)[0]) if len(h) == 1 else 0


class Signs:
    """Dimension and sign of tokens by their md5, remembered by token hash."""

    def __init__(self, most: int = 500_000) -> None:
        self.most = most
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, asked: np.ndarray, h: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the tokens with hashes ``asked``, which are among those (``h``) at [s, e)."""
        uniq, one = np.unique(h, return_index=True)
        at = np.searchsorted(self.keys, uniq)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != uniq) if len(self.keys) else np.arange(len(uniq))
        if len(new):
            if len(self.keys) > self.most:
                self.keys, self.codes, new, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.arange(len(uniq)), np.zeros(len(uniq), np.int64)
            raw = buf.tobytes()
            digests = [hashlib.md5(raw[a:b]).digest() for a, b in zip(s[one[new]].tolist(), e[one[new]].tolist(), strict=True)]
            codes = np.array([d[0] * 2 + (d[1] >> 4) % 2 for d in digests], np.int64)
            self.keys, self.codes = np.insert(self.keys, at[new], uniq[new]), np.insert(self.codes, at[new], codes)
        code = self.codes[np.searchsorted(self.keys, asked)]
        return code >> 1, 1.0 - 2.0 * (code & 1)


class TopK:
    """The k best (score, lesser id first) of each query, over blocks of scores. What is under a query's k-th so far is dropped before anything is sorted."""

    def __init__(self, n: int, k: int, least: float = -np.inf) -> None:
        self.n, self.k = n, k
        self.bound = np.full(n, least)
        self.q, self.c, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: queries x ids."""
        if scores.shape[1] > 4 * self.k and not len(self.s):  # the first block sets bounds
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            self.bound = np.maximum(self.bound, kth)
        q, c = np.nonzero(scores >= self.bound[:, None])
        self.q, self.c, self.s = np.concatenate([self.q, q]), np.concatenate([self.c, ids[c]]), np.concatenate([self.s, scores[q, c]])
        self.waiting += len(q)
        if self.waiting > 4 * self.n * self.k:
            self._cut()

    def _cut(self) -> None:
        order = np.lexsort((self.c, -self.s, self.q))
        q = self.q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        full = order[place == self.k - 1]
        self.bound[self.q[full]] = self.s[full]
        self.q, self.c, self.s = self.q[keep], self.c[keep], self.s[keep]
        self.waiting = 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score)."""
        self._cut()
        return self.q, self.c, self.s


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of runs of ``values``, ``sizes`` numbers each: it crosses between JVM and Python as bytes."""
    o = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes * values.itemsize, out=o[1:])
    big = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(values))])
    return big.cast(pa.binary())


def unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers end to end, how many in each row) of such a column without nulls."""
    wide = pa.types.is_large_binary(column.type)
    _, ob, db = column.buffers()
    o = np.frombuffer(ob, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if db is None or o[0] == o[-1]:
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    v = np.frombuffer(db, np.uint8)[o[0] : o[-1]].view(kind)
    return v, np.diff(o) // v.itemsize
