"""Vectorised byte kernels that the operators' Arrow functions share.

A slice is the UTF-8 bytes of consecutive texts put end to end (``buf``) with their
``offs`` (one more than texts). Words, grams and lines are found and hashed with numpy
passes over those bytes; no Python object is made for a word. A null text is an empty one.
A slice holds whole texts only: one text above the slice size makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 3 << 20

#: Foldings of bytes: none, and A-Z to a-z.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] = SAME[97:123]
_MASK = (1 << 64) - 1
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
LETTER_DIGIT = np.zeros(256, bool)
LETTER_DIGIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], U64))[0])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ob, db = texts.buffers()
    offs = np.frombuffer(ob, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(db, np.uint8) if db is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each text."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def eights(buf: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """The eight bytes from each place on (and from the end on) as a number, folded; zeros follow the last byte."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf if fold is SAME else fold[buf]
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hash(w: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of byte spans, from ``eights``; equal spans have equal hashes in any slice. Each block of eight bytes goes through a mix of its own, so no polynomial identity makes spans collide; different seeds give unrelated hashes."""
    size = end - start
    key = U64(mix_int(seed * 2 + 1))
    h = mix((w[start] & _FIRST_BYTES[np.minimum(size, 8)]) ^ key)
    more = np.flatnonzero(size > 8)
    if len(more):
        blocks = (size[more] - 1) // 8
        first = np.cumsum(blocks) - blocks
        which = np.repeat(more, blocks)
        at = (np.arange(len(which)) - np.repeat(first, blocks) + 1) * 8
        k = mix(at.astype(np.uint64) + key)
        x = (w[start[which] + at] & _FIRST_BYTES[np.minimum(size[which] - at, 8)]) ^ k
        h[more] += np.add.reduceat(mix(x) * (k | U64(1)), first)
    return mix(h + size.astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def same_bytes(w: np.ndarray, a: np.ndarray, v: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``a`` in ``w`` (of ``eights``) equal those from ``b`` in ``v``."""
    ok = ((w[a] ^ v[b]) & _FIRST_BYTES[np.minimum(size, 8)]) == 0
    more = np.flatnonzero(ok & (size > 8))
    if len(more):
        blocks = (size[more] - 1) // 8
        first = np.cumsum(blocks) - blocks
        which = np.repeat(more, blocks)
        at = (np.arange(len(which)) - np.repeat(first, blocks) + 1) * 8
        differ = ((w[a[which] + at] ^ v[b[which] + at]) & _FIRST_BYTES[np.minimum(size[which] - at, 8)]) != 0
        ok[more] = ~np.logical_or.reduceat(differ, first)
    return ok


def rolling(buf: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` bytes (8 times a power of two) from each place on that has as many."""
    h = np.array(eights(buf)[: max(0, len(buf) - 7)])
    h *= U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    step = 8
    while step < size:
        left, h = h[:-step], h[step:]
        h = (left ^ U64(0xC2B2AE3D27D4EB4F)) * U64(0xA24BAED4963EE407) + h
        h ^= h >> U64(32)
        h *= U64(0xD1342543DE82EF95)
        h ^= h >> U64(29)
        step *= 2
    return mix(h)


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the maximal runs of bytes that ``inside`` holds; runs end with their text."""
    m = inside[buf]
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = m.copy()
    first[1:] &= ~m[:-1] | edge[1:n]
    last = m
    last[:-1] &= ~m[1:] | edge[1:n]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(offs[1:], s, "right")


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the lines between \\n; an empty text has one empty line."""
    nl = np.flatnonzero(buf == 10)
    d = np.searchsorted(offs[1:], nl, "right")
    starts = np.concatenate([offs[:-1], nl + 1])
    ends = np.concatenate([offs[1:], nl])
    docs = np.concatenate([np.arange(len(offs) - 1), d])
    return (*_sorted_lines(starts, ends, docs),)


def _sorted_lines(starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.lexsort((starts, docs))
    b = np.lexsort((ends, docs))
    return starts[a], ends[b], docs[a]


def grams(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows and which of the len(words) - k + 1 places lie in one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    h = np.zeros(n, U64)
    for j in range(k):
        h *= U64(0xA24BAED4963EE407)
        h += words[j : j + n]
    return mix(h), doc[:n] == doc[k - 1 :]


def gram_of(hashes: list[int]) -> int:
    h = 0
    for w in hashes:
        h = (h * 0xA24BAED4963EE407 + int(w)) & _MASK
    return mix_int(h)


def word_hashes(text: str, inside: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = spans(buf, np.array([0, len(buf)]), inside)
    return span_hash(eights(buf, fold), s, e)


def first_of(docs: np.ndarray, n: int) -> np.ndarray:
    """For ascending text numbers, where each of n texts begins; n + 1 values."""
    return np.searchsorted(docs, np.arange(n + 1))


def bloom_of(hashes: np.ndarray, bits: int = 20) -> np.ndarray:
    """A table of 2**bits flags: no hash of the set is missed, and few others pass."""
    t = np.zeros(1 << bits, bool)
    t[(hashes >> U64(64 - bits)).astype(np.int64)] = True
    return t


def in_bloom(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return table[(hashes >> U64(65 - int(len(table)).bit_length())).astype(np.int64)]


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    o = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=o[1:])
    return pa.ListArray.from_arrays(pa.array(o), values)


def batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in schema], schema=schema)
