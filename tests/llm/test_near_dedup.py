import random
import re
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import near_dedup as N
from tidemark.llm.components import components


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    link = list(range(len(rows)))

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
            link[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return [(i, len(s[x]), (c := least.get(root(x))) if s[x] else (c := i), i == c) for x, (i, _) in enumerate(rows)]


def got(df, **kw):
    return sorted((tuple(r)[:4] for r in N.groups(df, **kw).collect()), key=repr)


def test_groups_are_brute_force(docs, rows):
    assert got(docs) == sorted(brute(rows), key=repr)


def test_blocks_of_long_lists(docs, rows, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    assert got(docs) == sorted(brute(rows), key=repr)


def test_chains_of_links(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[4 * i :], *(f"n{i}x{j}" for j in range(4 * i))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == sorted(brute(rows), key=repr)


def test_empty_table(nothing):
    assert got(nothing) == []


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (7, 7)] + [(200, 200 + i) for i in range(1, 50)]
    df = spark.createDataFrame(pairs, "a long, b long")
    label = dict(map(tuple, components(df).collect()))
    assert {label[i] for i in range(31)} == {0} and {label[i] for i in (100, 101, 102)} == {100} and {label[200 + i] for i in range(50)} == {200}


@pytest.mark.parametrize("n", [1, 2, 30])
def test_signature_keys_agree_as_sets_do(n):
    import numpy as np

    x = np.sort(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
    counts = np.ones(1 << 8, np.int64)
    k1, s1 = N.signatures(np.concatenate([x, x]), np.array([n, n]), counts, N.POSTED)
    assert (k1[0] == k1[1]).all() and (s1[0] == s1[1]).all()
    assert N.agreements(s1[:1], s1[1:])[0] == N.K


def family(n, rate, seed=3):
    """Rows of n texts that each change some share of one text's 300 words."""
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(300)]
    return [(i, " ".join(f"x{i}y{j}" if r.random() < rate(i) else w for j, w in enumerate(base))) for i in range(n)]


def test_parities_never_leave_out_a_link():
    r = np.random.default_rng(2)
    for size in (1, 12, 400, 6000):
        a = r.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
        for changed in range(0, size // 8 + 1, size // 40 + 1):
            b = np.concatenate([a[changed:], r.integers(0, 2**63, changed, dtype=np.int64).astype(np.uint64)])
            two = N.parities(np.concatenate([a, b]), np.array([size, size]))
            assert np.bitwise_count(two[0] ^ two[1]).sum(dtype=np.int64) <= 2 * changed
            both = size - changed
            assert (2 * changed <= N.most(2 * size, 80)) == (100 * both >= 80 * (2 * size - both))


@pytest.mark.parametrize("short", [2, 128])
@pytest.mark.parametrize("within", [True, False])
def test_across_is_every_pair(short, within, monkeypatch):
    monkeypatch.setattr(N, "SHORT", short)
    r = np.random.default_rng(4)
    n = 90
    group, label, own = np.sort(r.integers(0, 6, n)), r.integers(0, 20, n), r.integers(0, 2, n)
    part = lambda k: np.where(r.random((n, k)) < 0.1, r.integers(0, 2**63, k).astype(np.uint64), np.uint64(7))
    sketch, odd, size = part(2), part(16), r.integers(300, 400, n)
    rows = N.Rows(np.arange(n), size, sketch, 80, np.ascontiguousarray(odd.T))
    want = set()
    for a, b in combinations(range(n), 2):
        if group[a] == group[b] and label[a] != label[b] and (within or own[a] != own[b]):
            near = 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b]) and N.agreements(sketch[a : a + 1], sketch[b : b + 1])[0] >= N.SKETCH_AGREE
            if near and 180 * np.bitwise_count(odd[a] ^ odd[b]).sum(dtype=np.int64) <= 20 * (size[a] + size[b]):
                want.add((a, b))
    a, b = rows.across(group, label, own, np.full(n, within))
    assert len(want) > 20 and sorted(map(tuple, np.sort(np.stack([a, b], 1)).tolist())) == sorted(want)


def test_a_group_of_unlike_copies_is_not_confirmed_pair_by_pair(spark, monkeypatch):
    rows = family(120, lambda i: 0.01 if i % 3 == 0 else 0.09)
    asked, confirmed = [], N.confirmed
    monkeypatch.setattr(N, "confirmed", lambda pairs, *a, **k: asked.append(pairs.count()) or confirmed(pairs, *a, **k))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == sorted(brute(rows), key=repr)
    assert sum(asked) < 3000  # of 7,140


def test_only_lists_of_unlike_classes_are_split(spark):
    like = [(1, i, [1, *range(10, 36)]) for i in range(30)]
    unlike = [(2, 100 + i, [2, *range(1000 * i + 2000, 1000 * i + 2026)]) for i in range(30)]
    many = spark.createDataFrame([(k, c, 30, [k]) for k, c, _ in like + unlike], "key long, cid long, m long, used array<long>")
    classes = spark.createDataFrame([(c, x) for _, c, x in like + unlike], "cid long, keys array<long>")
    assert [r["key"] for r in N._splitting(many, classes, N.PREFIX + 1).collect()] == [2]


def test_a_long_list_of_one_group_is_not_split(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rows = family(50, lambda i: 0.01 if i % 3 == 0 else 0.07)
    names, written = [], N.shared.written
    monkeypatch.setattr(N.shared, "written", lambda df, name: names.append(name) or written(df, name))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == sorted(brute(rows), key=repr)
    assert "mixed" in names and "refined" not in names
