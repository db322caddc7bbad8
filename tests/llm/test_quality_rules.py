import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality_rules as Q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    c = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in t), dup, len(hit)


def test_counts_are_brute_force(docs, rows):
    got = sorted((tuple(r[:6]) for r in Q.statistics(docs).collect()), key=repr)
    assert got == sorted([(i, *brute(t)) for i, t in rows], key=repr)


def test_distinct_and_ratios(spark):
    r = Q.statistics(spark.createDataFrame([(1, "a b a c!\nA9")], "doc_id long, text string")).first()
    assert r["distinct_share"] == pytest.approx(4 / 5) and r["bang_share"] == pytest.approx(1 / 5)
    assert r["words_per_line"] == pytest.approx(2.5) and r["upper_share"] == pytest.approx(1 / 7) and r["digit_share"] == pytest.approx(1 / 7)


def test_learned_list_and_expression_agree(spark):
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["b"] > 0.95)
    rules = Q.learn(x, bad)
    assert len(rules) >= 2 and all(r.precision >= 0.9 for r in rules)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= Q._holds(x, r.tests, 3000)
    assert (hit == bad).mean() > 0.97
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x["a"], x["b"])], "a double, b double")
    got = [r[0] is not None for r in df.select(Q.rejected_by(rules)).collect()]
    assert got == hit.tolist()


def test_no_or_one_sided_labels(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(docs, none) == [] and Q.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")) == []
    got = Q.judge(Q.statistics(docs), []).collect()
    assert all(r["kept"] != r["base_failed"] for r in got) and all(r["base_failed"] for r in got if r["n_words"] < 20)
    assert Q.statistics(nothing).collect() == []


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = Q.fit(docs, labels.where("doc_id % 2 = 0"))
    got = Q.judge(Q.statistics(docs), rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("n_words >= 20").select("kept", "quality").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def ratios(text):
    t = text or ""
    words, lines, raw = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n"), t.encode()
    n_words, chars, symbols, dup, rep = brute(t)
    w, c, n = max(1, n_words), max(1, chars), max(1, len(lines))
    count = lambda some: sum(raw.count(x) for x in some.encode())
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep, "mean_word": chars / w, "symbols_per_word": symbols / w, "dup_line_share": dup / n, "repeat_share": rep / w,
        "upper_share": sum(65 <= x <= 90 for x in raw) / c, "digit_share": sum(48 <= x <= 57 for x in raw) / c, "mark_share": count(".,!?;:") / w, "distinct_share": len(set(words)) / w, "long_share": sum(len(x) > 12 for x in words) / w,
        "words_per_line": n_words / n, "bang_share": raw.count(b"!") / w,
    }


def test_verdicts_are_brute_force(docs, rows):
    """Every statistic and every verdict, against the rules read one after the other."""
    rules = [Q.Rule((("mark_share", ">", 0.3), ("mean_word", "<=", 9.5)), 1.0, 1), Q.Rule((("distinct_share", "<=", 0.12),), 1.0, 1), Q.Rule((("dup_line_share", ">", 0.0), ("words_per_line", ">", 8.0)), 1.0, 1), Q.Rule((("long_share", ">", 0.5), ("upper_share", "<=", 0.5)), 1.0, 1)]
    want = []
    for i, t in rows:
        x = ratios(t)
        hit = next((k for k, r in enumerate(rules) if all(x[c] <= v if op == "<=" else x[c] > v for c, op, v in r.tests)), None)
        failed = x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"]
        want.append((i, *(round(float(x[c]), 9) for c in (*Q.COUNTS, *Q.RATIOS)), failed, hit, not failed and hit is None))
    got = [(r["doc_id"], *(round(float(r[c]), 9) for c in (*Q.COUNTS, *Q.RATIOS)), r["base_failed"], r["rule"], r["kept"]) for r in Q.judge(Q.statistics(docs), rules).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {w[-2] for w in want} >= {None, 1}
