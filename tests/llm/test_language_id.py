import itertools
import zlib

import numpy as np
import pytest

from tidemark.llm import language_id as L

EN = "the house of the king was on the hill and they have been with this for that thing".split()
ES = "la casa del rey estaba en la colina y ellos han sido con esta para que cosa".split()


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([4, 1, 3])
    emit, trans = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    start = np.array([0, 4, 5])
    post, pairs, log_z = L.forward_backward(emit, start, sizes, trans, True)
    want, wp, wz = np.zeros_like(post), np.zeros((3, 3)), 0.0
    for s, n in zip(start, sizes):
        total, p, q = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(emit[s + i, y[i]] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            for i in range(n):
                p[i, y[i]] += w
            for a, b in zip(y, y[1:]):
                q[a, b] += w
        want[s : s + n], wz = p / total, wz + np.log(total)
        wp += q / total
    assert np.allclose(post, want) and np.allclose(pairs, wp) and abs(log_z - wz) < 1e-9


def test_code_switched_words_get_their_own_labels():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(w, 30)) for _ in range(60) for w in (EN, ES)]
    m = L.train(texts, ["en", "es"] * 60)
    got = L.label_words(" ".join(EN[:6] + ES[:7] + EN[2:8]), m)
    want = ["en"] * 6 + ["es"] * 7 + ["en"] * 6
    assert sum(g == w for (_, g), w in zip(got, want)) >= 17
    assert L.label_words("", m) == [] and L.label_words(None, m) == []


def test_undetermined_and_hostile_texts(spark, docs, rows, nothing):
    m = L.train([" ".join(EN), " ".join(ES)], ["en", "es"])
    got = sorted(map(tuple, L.predict(docs, m).collect()), key=repr)
    assert len(got) == len(rows)
    lettered = {(i, any(c.isalpha() for c in t or "")) for i, t in rows}
    for i, lang, score in got:
        assert 0 <= score <= 1 and lang in ("en", "es", "und")
        assert (i, lang != "und") in lettered
    odd = spark.createDataFrame([(1, "— 12 🙂 “”"), (2, "漢"), (3, "9 x")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in L.predict(odd, m).orderBy("doc_id").collect()] == [True, False, False]
    none = L.fit(nothing)
    assert none.langs == [] and {r["lang_pred"] for r in L.predict(docs, none).collect()} == {"und"}
    assert L.predict(nothing, m).collect() == []
    assert L.fit(docs.where("text is null")).langs == []


def test_held_out_accuracy_and_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = L.fit(docs, where=~L.held_out())
    got = L.predict(docs, m, extra=("lang",)).withColumn("h", L.held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r["h"]]
    assert sum(r["lang_pred"] == r["lang"] for r in test) >= 0.98 * len(test)


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(EN), "en") for i in range(500)] + [(1000 + i, " ".join(rng.choice(w, 25)), k) for i in range(30) for w, k in ((EN, "en"), (ES, "es"))]
    seen = {}
    monkeypatch.setattr(L, "train", lambda texts, langs: seen.update(texts=texts, langs=langs))
    L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), per_lang=20)
    assert len(set(zip(seen["texts"], seen["langs"]))) == len(seen["texts"]) == 40


@pytest.mark.parametrize("size", [1, 7, 192])
def test_chains_cover_all_words_once(size):
    doc = np.array([0] * 500 + [2] * 3 + [3])
    first, n, text = L.chains(doc, 5, size)
    words = np.concatenate([np.arange(f, f + k) for f, k in zip(first, n)])
    assert words.tolist() == list(range(len(doc))) and n.max() <= size
    assert all((doc[f : f + k] == t).all() for f, k, t in zip(first, n, text))


def naive(text, m):
    """(language, score) of a text, word by word and feature by feature."""
    import re

    from tidemark.llm import textkit as tk

    k = len(m.langs)
    words = [x for x in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0

    def bucket(b, kind):
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in b)
        return int(L._bucket(tk.span_hash(tk.eights(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)])), kind)[0])

    def emission(w):
        f = [bucket(w, "lexicon")]
        for n in (1, 2, 3, 4):
            if len(w) >= n:
                f += [bucket(w[:n], "prefix"), bucket(w[-n:], "suffix")]
        for n in (1, 2, 3):
            f += [bucket(w[i : i + n], "gram") for i in range(len(w) - n + 1)]
        return m.weights[f].astype(float).sum(0)

    mean = np.zeros(k)
    for lo in range(0, len(words), L.CHAIN):
        e = np.array([emission(w) for w in words[lo : lo + L.CHAIN]])
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0]
        for i in range(1, len(e)):
            a[i] = e[i] + np.logaddexp.reduce(a[i - 1][:, None] + m.transitions, 0)
        for i in range(len(e) - 2, -1, -1):
            b[i] = np.logaddexp.reduce(m.transitions + (e[i + 1] + b[i + 1])[None], 1)
        p = a + b
        mean += np.exp(p - np.logaddexp.reduce(p, 1)[:, None]).sum(0)
    mean /= len(words)
    return m.langs[int(mean.argmax())], float(mean.max())


def test_predictions_are_the_naive_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = L.train([" ".join(rng.choice(w, 20)) for _ in range(20) for w in (EN, ES)], ["en", "es"] * 20)
    texts = [" ".join(rng.choice(EN + ES, int(n))) for n in rng.integers(1, 40, 25)] + [" ".join(rng.choice(EN, 450)), "Ünï 漢字 The LA", "", None, "12 — 3", "a", "x" * 300]
    want = [naive(t, m) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for words in (L.WORDS, 192):  # chains of a slice are worked on in blocks
        monkeypatch.setattr(L, "WORDS", words)
        got = [(r["lang_pred"], r["score"]) for r in L.predict(df, m).orderBy("doc_id").collect()]
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-6)
