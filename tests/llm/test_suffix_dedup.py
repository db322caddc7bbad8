import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as S


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    c = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        f = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if c[t[p : p + length]] > 1:
                f[p] += 1
                f[p + length] -= 1
        cover = np.cumsum(f)[:-1] > 0
        kept = bytes(x for x, g in zip(t, cover) if not g)
        out.append((i, len(t), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [S.BLOCK, 2])
def test_removed_bytes_are_brute_force(docs, rows, block):
    got = sorted((tuple(r)[:5] for r in S.dedup(docs, block=block).collect()), key=repr)
    assert got == brute(rows, 200)


def test_small_batches(spark, rows):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted((tuple(r)[:5] for r in S.dedup(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute(rows, 200)


def test_empty_table(nothing):
    assert S.dedup(nothing).collect() == []


def test_index_finds_longest_matches():
    r = random.Random(2)
    for trial in range(40):
        base = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(3, 40))) for _ in range(3)]
        texts = [b"".join(r.choice(base) for _ in range(r.randint(1, 3))) for _ in range(r.choice([1, 2, 4]))]
        buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        index = S.RunLengthIndex(buf, offs)
        m = index.matches()
        spots = [(t, p) for t in range(len(texts)) for p in range(len(texts[t]))]
        for t, p in spots:
            best = 0
            for u, q in spots:
                if (t, p) != (u, q):
                    a, b = texts[t][p:], texts[u][q:]
                    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                    best = max(best, n)
            assert m[index.start[t] + p] == best
        assert index.runs <= index.n == index.length.sum() and index.runs == len(index.first) == len(index.below)


def test_a_hot_anchor_is_split(spark):
    """One 64-byte string inside windows that differ left and right of it, more often than a block takes."""
    r = random.Random(8)
    core = bytes(r.choice(b"abcdefgh") for _ in range(64)).decode()
    side = ["".join(r.choice("xyz") for _ in range(180)) for _ in range(8)]
    rows = [(i, r.choice(side)[r.randrange(60) :] + core + r.choice(side)[: 180 - r.randrange(60)]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:5] for r in S.dedup(df, block=3).collect()), key=repr)
    assert got == brute(rows, 200)


def test_every_window_has_one_anchor():
    r = random.Random(4)
    buf = np.frombuffer(bytes(r.choice(b"abc ") for _ in range(5000)), np.uint8)
    offs = np.array([0, 0, 100, 2000, 5000])
    d, fp, sh, first, count, off = S.anchors(buf, offs, 200, 64)
    assert Counter(np.repeat(d, count).tolist()) == {2: 1701, 3: 2801}
    assert all((off - (count - 1) >= 0) & (off <= 136))


def test_parts_of_a_long_text(spark, monkeypatch):
    """Windows taken in parts give what they give whole."""
    r = random.Random(6)
    unit = "".join(r.choice("abcdefg ") for _ in range(500))
    rows = [(1, unit + "x" * 700 + unit[100:450] + "y" + "".join(r.choice("hijk") for _ in range(900))), (2, unit[50:330]), (3, "z" * 1000), (4, None)]
    import pyarrow as pa

    texts = pa.array([t for _, t in rows])
    whole = [np.concatenate(x) for x in zip(*(p[1:] for p in S._parts(texts, 200)))]
    for piece in (64, 333):
        parts = [np.concatenate(x) for x in zip(*(p[1:] for p in S._parts(texts, 200, piece)))]
        spots = lambda x: sorted((int(d), int(f) + i, int(g)) for d, g, f, n in zip(x[0], x[1], x[3], x[4]) for i in range(n))
        assert spots(parts) == spots(whole) and len(parts[0]) > len(whole[0])
    old = S._parts
    monkeypatch.setattr(S, "PIECE", 333)
    monkeypatch.setattr(S, "_parts", lambda texts, length: old(texts, length, 333))
    got = sorted((tuple(x)[:5] for x in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows, 200)
