import zlib

import numpy as np
import pytest

from tidemark.llm import registry, token_output as T

TRICKY = ["don't we'll. a'b 's 'tis x..'s \x01 a\x01b É,é \u0301abc á,b", "ſ İ ς Σ ΑΣ,x", "1st 12.5% $%^ a_b__c", " x y\x1cz\x85q", "日本語,テスト!a", "'’s it’s", " \x00a", "<|endoftext|> x <|startoftext|>", "ABC abc Abc"]


@pytest.fixture(scope="module")
def path():
    return registry.tokenizer_file("word_bpe_49k.json")


def test_round_trip_is_the_library(spark, docs, rows, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    all_ = [(i, t) for i, t in rows] + [(500 + i, t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(all_, "doc_id long, text string").repartition(6)
    got = T.round_trip(spark, df, path).collect()
    ids = {x: [*tok.encode(x[1] or "", add_special_tokens=False).ids, 1] for x in all_}
    crc = lambda x: zlib.crc32(np.array(ids[x], "<u4").tobytes())
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted([(x[0], len(ids[x]), crc(x)) for x in all_], key=repr)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    order = [r["doc_id"] for r in ordered]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_empty_table(spark, nothing, path):
    assert T.round_trip(spark, nothing, path).collect() == []


def test_cache_forgets_without_harm(path, monkeypatch):
    monkeypatch.setattr(T, "CACHE_UNITS", 50)
    e = T.Encoder(path)
    for i in range(20):
        text = " ".join(f"word{j} the, and" for j in range(i * 7, i * 7 + 30))
        buf = np.frombuffer(text.encode(), np.uint8)
        ids, n = e(buf, np.array([0, len(buf)]))
        assert ids.tolist() == e.tok.encode(text, add_special_tokens=False).ids and n[0] == len(ids)


@pytest.mark.parametrize("limit", [4, 6, 18])
def test_code_lengths(limit):
    c = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 0, 144])
    n = T.code_lengths(c, limit)
    assert n.max() <= limit and (n[c == 0] == 0).all()
    assert np.isclose((2.0 ** -n[n > 0].astype(float)).sum(), 1)
    if limit == 18:
        import heapq

        h, cost = [int(x) for x in c if x], 0
        heapq.heapify(h)
        while len(h) > 1:
            s = heapq.heappop(h) + heapq.heappop(h)
            cost += s
            heapq.heappush(h, s)
        assert (n.astype(int) * c).sum() == cost


def test_limited_lengths_are_optimal():
    import itertools

    c = np.array([1, 1, 2, 9, 30])
    best = min(sum(a * b for a, b in zip(n, c)) for n in itertools.product([1, 2, 3], repeat=5) if sum(2.0**-x for x in n) <= 1)
    assert (T.code_lengths(c, 3).astype(int) * c).sum() == best
    with pytest.raises(ValueError):
        T.code_lengths(np.ones(9, int), 3)
    assert T.code_lengths(np.array([0, 7]), 5).tolist() == [0, 1] and T.code_lengths(np.zeros(3, int), 5).tolist() == [0, 0, 0]


def test_pack_and_decode_any_lengths():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 1000, 300) ** 2
    counts[5] = 10**9
    n = T.code_lengths(counts, 12)
    codes = T.canonical_codes(n)
    sizes = np.array([1, 63, 64, 65, 1000, 1])
    ids = rng.choice(np.flatnonzero(n), sizes.sum())
    data, nbytes, bits, parts = T.pack(ids, sizes, n, codes)
    ends = np.cumsum(bits.astype(int))
    last = np.cumsum(parts)
    of = np.add.reduceat(bits.astype(int), last - parts)
    assert (nbytes == (of + 7) // 8).all()
    begin = ends - bits + np.repeat((np.cumsum(nbytes) - nbytes) * 8 - (ends[last - 1] - of), parts)
    inner = np.full(len(bits), T.STEP)
    inner[last - 1] = sizes - (parts - 1) * T.STEP
    assert (T.Decoder(n)(data, begin, inner) == ids).all()
