import math
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import answer, cache, chunking, code_index, common, confidence, dense, evaluation, fusion, lexical, memory, packing, scan, store
from tidemark.plans import recall

NOW = datetime(2024, 2, 1)
TEXTS = {1: "the red planet mars has red dust", 2: "jupiter is the largest planet", 3: "python code for sorting lists", 4: ""}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, t, "space" if i < 3 else None) for i, t in TEXTS.items()], "chunk_id long, text string, topic string")


def ask(spark, *qs):
    return spark.createDataFrame(list(enumerate(qs)), "query_id long, query string")


def bm25(query, keep=lambda i: True):
    toks = {i: re.findall("[a-z0-9]+", t) for i, t in TEXTS.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, ws in toks.items():
        s = 0.0
        for q in re.findall("[a-z0-9]+", query.lower()):
            df, tf = sum(q in x for x in toks.values()), ws.count(q)
            if df:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avg))
        if s > 0 and keep(i):
            out[i] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("q", ["red planet", "red red planet", "planet", "nothing here", "SORTING the lists"])
@pytest.mark.parametrize("terms", [50_000, 0])
def test_bm25_is_the_formula(spark, chunks, q, terms, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_TERMS", terms)
    got = lexical.search(ask(spark, q), chunks, 10).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == bm25(q)


def test_bm25_filters_after_statistics(spark, chunks):
    got = lexical.search(ask(spark, "planet code"), chunks, 10, filters={"topic": None}).collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == bm25("planet code", lambda i: i > 2)
    got = lexical.search(ask(spark, "planet code"), chunks, 10, filters={"topic": ["space", "x"]}).collect()
    assert {r["chunk_id"] for r in got} == {1, 2}


def test_filters_treat_null_as_a_value(chunks):
    ids = lambda f: {r["chunk_id"] for r in chunks.where(common.matches(f)).collect()}
    assert ids({"topic": None}) == {3, 4} and ids({"topic": ["space", None]}) == {1, 2, 3, 4} and ids({"topic": "space", "chunk_id": [2, 3]}) == {2} and ids({}) == {1, 2, 3, 4}


@pytest.mark.parametrize("block", [1000, 2])
def test_dense_is_exact(spark, block):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 8)).astype(np.float32)
    v[7] = 0
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(99, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in (0, 3, 7, 9)] + [(100, None)], "query_id long, vector array<float>")
    unit = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
    for label in (None, 1):
        got = dense.search(q, df, 5, filters=None if label is None else {"label": label}, block=block).collect()
        for i in (0, 3, 7, 9):
            s = [(-(round(float(unit[i] @ unit[j]), 6) + 0.0), j) for j in range(50) if label is None or j % 3 == label]
            assert [(r["chunk_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == [(j, -x) for x, j in sorted(s)[:5]]
        assert {r["query_id"] for r in got} == {0, 3, 7, 9}


def test_embedders(spark):
    assert dense.blake_embedding("") == [1.0] + [0.0] * 255
    assert sum(x * x for x in dense.blake_embedding("red red mars")) == pytest.approx(1)
    df = spark.createDataFrame([("red mars",), (None,)], "t string").select(dense.Embedder().column(F.col("t")).alias("v")).collect()
    assert df[0]["v"] == pytest.approx(dense.blake_embedding("red mars")) and df[1]["v"][0] == 1.0
    n = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(dense.normalized(F.col("v"))).collect()
    assert n[0][0] == [0.6, 0.8] and n[1][0] == [0.0, 0.0]


def lists(spark):
    shape = "query_id long, chunk_id long, score double, rank long, origin string"
    d = spark.createDataFrame([(1, 10, 0.9, 1, "dense"), (1, 11, 0.8, 2, "dense"), (2, 12, 0.3, 1, "dense")], shape)
    b = spark.createDataFrame([(1, 11, 5.0, 1, "bm25"), (1, 13, 4.0, 2, "bm25")], shape)
    return d, b


def test_rrf(spark):
    d, b = lists(spark)
    got = {(r["query_id"], r["chunk_id"]): r for r in fusion.fused([d, b], 10).collect()}
    assert got[1, 11]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and got[1, 11]["rank"] == 1
    assert [got[1, c]["rank"] for c in (10, 13)] == [2, 3]
    heavy = {r["chunk_id"]: r["rank"] for r in fusion.fused([d, b], 10, weights=[10, 0.1]).where("query_id = 1").collect()}
    assert heavy[10] == 1 or heavy[11] == 1
    with pytest.raises(ValueError):
        fusion.rrf([d, b], weights=[1.0])


def test_one_list_stays_unfused(spark):
    d, b = lists(spark)
    got = {(r["query_id"], r["chunk_id"]): r for r in fusion.retrieve(d, b).collect()}
    assert got[2, 12]["origin"] == "dense" and got[2, 12]["score"] == 0.3 and got[1, 11]["origin"] == "hybrid"
    assert {r["origin"] for r in fusion.retrieve(None, b, top_k=1).collect()} == {"bm25"}


def test_memory_merge(spark):
    d, b = lists(spark)
    got = {(r["query_id"], r["record_id"]): r for r in fusion.evidence(d.withColumn("score", F.when(F.col("chunk_id") == 12, -0.5).otherwise(F.col("score"))), b).collect()}
    assert got[2, 12]["similarity"] == 0 and got[1, 11]["similarity"] == 0.8 and got[1, 13]["similarity"] == 0.5
    assert got[1, 11]["in_dense"] and got[1, 11]["in_bm25"] and not got[1, 10]["in_bm25"] and got[1, 10]["rank"] == 0


EV = "query_id long, record_id long, similarity double, rank int, in_dense boolean, in_bm25 boolean, kind string, subject string, supersedes long, authority double, updated_at timestamp, text string, source string"


def ev(q, i, sim, rank=0, kind="fact", subject=None, age=0.0, auth=0.8, both=(True, True), sup=None, text="some text", source=None):
    return (q, i, sim, rank, *both, kind, subject, sup, auth, NOW - timedelta(days=age), text, source)


def signals(spark, rows, n=1):
    q = spark.createDataFrame([(i,) for i in range(n)], "query_id long")
    return {r["query_id"]: r for r in confidence.signals(q, spark.createDataFrame(rows, EV)).collect()}


def test_confidence_modes(spark):
    rows = [ev(0, i, 0.9, i) for i in range(3)] + [ev(1, 1, 0.1)] + [ev(2, 1, 0.9, 0, subject="Port"), ev(2, 2, 0.8, 1, subject="port")] + [ev(3, 1, 0.9, 0, subject="p"), ev(3, 2, 0.8, 1, subject="p", sup=1)] + [ev(4, 1, 0.5, age=1000.0)]
    got = signals(spark, rows, 6)
    assert got[0]["mode"] == "direct" and got[0]["score"] == pytest.approx(round(0.3 * 0.9 + 0.15 + 0.15 + 0.1 + 0.15 * 0.8 + 0.15, 4))
    assert got[1]["mode"] in ("refuse_guess", "search_more") and got[1]["score"] < 0.3
    assert got[2]["mode"] == "ask_clarification" and got[2]["subjects"] == ["port"] and not got[3]["conflict"]
    assert got[5]["score"] == 0 and got[5]["mode"] == "refuse_guess" and got[5]["n_evidence"] == 0
    assert got[4]["recency"] == pytest.approx(round(0.5 ** (1000 / 180), 4))


def test_conflict_looks_at_the_first_of_a_subject_and_six_ranks(spark):
    rows = [ev(0, i, 0.9, i, subject="s" if i in (0, 7) else f"o{i}") for i in range(8)] + [ev(1, 1, 0.9, 0, kind="episode", subject="s"), ev(1, 2, 0.9, 1, subject="s")]
    got = signals(spark, rows, 2)
    assert not got[0]["conflict"] and not got[1]["conflict"]


def test_agreement_needs_both_flags_somewhere(spark):
    one = signals(spark, [ev(0, i, 0.9, i, both=(True, False)) for i in range(4)] + [ev(1, i, 0.9, i, both=(i == 0, True)) for i in range(4)], 2)
    assert one[0]["agreement"] == 0.5 and one[1]["agreement"] == 0.25


def pack_py(rows, budget, now=NOW):
    est = lambda s: max(1, (len(s) + 3) // 4)
    lines, sets, spent, cut = [], [], 0, False
    for r in rows:
        q, i, sim, rank, _, _, kind, subject, sup, auth, at, text, source = r
        if lines and sim < 0.3 * rows[0][2]:
            break
        toks = set(re.findall("[a-z0-9]+", text.lower()))
        if any(toks and o and len(toks & o) / len(toks | o) >= 0.85 for o in sets):
            continue
        line = f"- [{kind}|sim {sim:.2f}|today" + (f"|{source}" if source else "") + "] " + (f"{subject}: " if subject else "") + text
        if spent + est(line) > budget:
            cut = True
            if lines:
                continue
            line = line[: max(80, budget * 4 - 16)]
        lines.append(line)
        sets.append(toks)
        spent += est(line)
    return "\n".join(lines), len(lines), spent, cut


@pytest.mark.parametrize("budget", [2000, 60, 30])
def test_packing_is_the_greedy_loop(spark, budget):
    long = " ".join(f"w{i}" for i in range(80))
    cases = {
        0: [ev(0, 1, 0.9, 0, text="alpha beta gamma", source="f.md", subject="s"), ev(0, 2, 0.8, 1, text="alpha beta gamma"), ev(0, 3, 0.7, 2, text=long), ev(0, 4, 0.6, 3, text="short one"), ev(0, 5, 0.1, 4, text="noise"), ev(0, 6, 0.9, 5, text="after noise")],
        1: [ev(1, 1, 0.5, 0, text="x" * 4000), ev(1, 2, 0.5, 1, text="tiny")],
        2: [ev(2, 1, 0.0, 0, text="zero"), ev(2, 2, 0.0, 1, text="")],
    }
    got = {r["query_id"]: r for r in packing.pack(spark.createDataFrame([r for c in cases.values() for r in c], EV), budget).collect()}
    for q, rows in cases.items():
        assert (got[q]["context"], got[q]["used"], got[q]["tokens"], got[q]["truncated"]) == pack_py(rows, budget)


def test_recall_end_to_end(spark):
    new = memory.remember(spark.createDataFrame([(" deploys go through the blue pipeline on fridays ", "decision", "deploy"), ("the database listens on port 5432", "fact", "db-port"), ("  ", "fact", "blank")], "text string, kind string, subject string"))
    assert new.count() == 2 and {r["authority"] for r in new.collect()} == {0.9, 0.8}
    q = ask(spark, "which port does the database listen on", "zebra quagga")
    got = {r["query_id"]: r for r in recall.answer(q, new).collect()}
    assert "5432" in got[0]["context"] and got[0]["mode"] in ("direct", "cautious") and got[0]["suggestion"] == config.SUGGESTIONS[got[0]["mode"]]
    assert got[1]["mode"] in ("refuse_guess", "search_more")
    other = memory.remember(spark.createDataFrame([("the database now listens on port 6000", "fact", "db-port")], "text string, kind string, subject string"))
    clash = recall.answer(q, new.unionByName(other)).where("query_id = 0").first()
    assert clash["mode"] == "ask_clarification"
    old = new.where("subject = 'db-port'").first()["record_id"]
    fixed = memory.supersede(new, other.withColumn("supersedes", F.lit(old)))
    assert {r["status"] for r in fixed.where(F.col("record_id") == old).collect()} == {"superseded"}
    assert "6000" in recall.answer(q, fixed).where("query_id = 0").first()["context"]


def test_memory_operations(spark):
    r = memory.remember(spark.createDataFrame([(f"t{i}", "fact" if i < 3 else "episode", f"s{i}") for i in range(5)], "text string, kind string, subject string"))
    assert {x["kind"]: x["n_active"] for x in memory.stats(r).collect()} == {"fact": 3, "episode": 2, "decision": 0, "code": 0}
    assert memory.forget(r, r.where("subject = 's0'").select("record_id")).count() == 4
    assert memory.listed(r, "fact").count() == 3 and memory.listed(r, status=None).count() == 5
    seeded = memory.replace_inferred(r, spark.createDataFrame([("a", "fact", "x", "f")], "text string, kind string, subject string, source string"))
    again = memory.replace_inferred(seeded, spark.createDataFrame([("b", "fact", "x", "f")], "text string, kind string, subject string, source string"))
    assert [x["text"] for x in again.where("subject = 'x'").collect()] == ["b"] and again.count() == 6
    assert "3 fact" in memory.briefing(r) and memory.briefing(r).endswith("recall before answering")


def test_store(spark, tmp_path):
    c = store.Collection(spark, f"file://{tmp_path}/c", "chunk_id string, text string, version long, seq long")
    assert c.count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, text string").coalesce(1)
    c.upsert(rows(("a", "1"), ("b", "2")))
    c.upsert(rows(("a", "new"), ("c", "3")))
    assert [(r["chunk_id"], r["text"]) for r in c.read().orderBy("seq").collect()] == [("a", "new"), ("b", "2"), ("c", "3")]
    assert c.delete(spark.createDataFrame([("b",), ("zz",)], "chunk_id string")) == 1 and c.count() == 2
    c.clear()
    assert c.count() == 0


def test_embedding_cache(spark):
    t = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    empty = spark.createDataFrame([], "key string, vector array<float>")
    got, full = store.embedded(t, empty, dense.Embedder())
    assert full.count() == 2 and got.where("vector is null").count() == 0
    assert store.missing(t, full).count() == 0


def test_caches(spark):
    e = spark.createDataFrame([(1, "how is it", "s", NOW - timedelta(days=9), "{}"), (2, "how is it", "s", NOW - timedelta(days=1), '{"mode":"direct"}'), (3, "how is it", "other", NOW, "{}")], "entry_id long, query_norm string, scope string, created_at timestamp, payload string")
    q = spark.createDataFrame([(1, " How  IS it", "s"), (2, "else", "s")], "query_id long, query string, scope string")
    got = cache.probe_exact(q, e).collect()
    assert [(r["query_id"], r["entry_id"]) for r in got] == [(1, 2)]
    assert cache.hits(cache.probe_exact(q, e), "mode string").first().asDict() == {"query_id": 1, "mode": "direct", "cached": True}
    v = spark.createDataFrame([(1, [1.0, 0.0], NOW), (2, [0.9, 0.1], NOW - timedelta(days=8))], "entry_id long, embedding array<float>, created_at timestamp")
    p = spark.createDataFrame([(1, [0.99, 0.05]), (2, [0.0, 1.0])], "query_id long, vector array<float>")
    assert [(r["query_id"], r["entry_id"]) for r in cache.probe_semantic(p, v).collect()] == [(1, 1)]
    m = spark.createDataFrame([(1, "direct", 1), (2, "search_more", 1)], "query_id long, mode string, evidence int")
    assert [r.asDict() for r in cache.writable(m).collect()] == [{"query_id": 1, "mode": "direct"}]


def test_chunkers(spark):
    words = " ".join(map("word{}".format, range(400)))
    got = chunking.recursive(words, 400, 50)
    assert len(got) > 3 and all(len(c) <= 450 for c in got) and got[1].startswith(got[0][-50:])
    assert chunking.recursive("a" * 3000) == ["a" * 3000] and chunking.recursive(" \n ") == []
    with pytest.raises(ValueError):
        chunking.recursive("x", 10, 10)
    md = chunking.markdown("intro\n# Guide\nhi\n## Install\nx\n## Usage\ny\n# End\nz")
    assert [h for _, h in md] == ["", "Guide", "Guide > Install", "Guide > Usage", "End"]
    src = "import x\n" + "".join(f"def f{i}():\n" + "    y = 1\n" * 30 for i in range(2))
    assert [c.split("(")[0] for c in chunking.code(src, 600)][-2:] == ["def f0", "def f1"]
    df = spark.createDataFrame([(1, "# A\nb", ".md"), (2, "def f(): pass", ".py"), (3, "t", None), (4, None, ".md"), (5, "  ", "")], "doc_id long, text string, suffix string")
    got = {r["doc_id"]: r for r in chunking.chunk(df, chunking.kind_of(F.col("suffix"))).collect()}
    assert set(got) == {1, 2, 3} and got[1]["heading"] == "A" and got[3]["seq"] == 0
    many = chunking.chunk(spark.createDataFrame([(1, words), (2, "one")], "doc_id long, text string"), "recursive", 400, 50)
    docs = spark.createDataFrame([(1, words), (2, "one")], "doc_id long, text string")
    c = chunking.with_context(many, docs, lambda d, t: f"about {len(d)}").select("doc_id", "context").distinct().collect()
    assert {tuple(r) for r in c} == {(1, f"about {len(words)}"), (2, None)}


FILES = (
    ("app/main.py", 'import os\nfrom json import dumps\n\n\nclass Service:\n    """Serves."""\n\n    def run(self):\n        return dumps(os.environ.copy())\n\n\n@app.get("/health")\ndef health():\n    """Says that it lives."""\n    return "ok"\n'),
    ("app/broken.py", "def nothing(:\n"),
    ("tests/test_main.py", "from app.main import health\n\n\ndef test_health():\n    assert health() == 'ok'\n"),
    ("web/util.js", "import { a } from 'lib-a'\nexport const add = (x, y) => x + y\nexport async function load(url) {\n  return fetch(url)\n}\n"),
    ("core/lib.rs", "use std::fmt\npub struct Point { x: i32 }\nfn area(p: Point) -> i32 { 0 }\n"),
)


def test_code(spark):
    f = code_index.files(spark.createDataFrame(list(FILES), "file string, text string"))
    rec = code_index.records(f)
    by = {r["subject"]: r for r in rec.collect()}
    assert "endpoint" in by["app/main.py::health"]["tags"] and "GET /health" in by["app/main.py::health"]["text"] and by["tests/test_main.py"]["tags"] == ["file", "test"]
    assert by["app/broken.py"]["text"].endswith("symbols: (none)")
    src = spark.createDataFrame([("a.py", "x = 1\n"), ("b.py", "def g(): pass\n"), ("n.txt", "no")], "file string, text string")
    empty = rec.where("false")
    first, s = code_index.reindex(src, empty)
    assert s.first().asDict() == {"files_indexed": 2, "files_skipped": 0, "files_removed": 0}
    second, s = code_index.reindex(spark.createDataFrame([("a.py", "x = 1\n"), ("c.py", "password = 'supersecret1'\ndef h(): pass\n")], "file string, text string"), first)
    assert s.first().asDict() == {"files_indexed": 1, "files_skipped": 1, "files_removed": 1}
    assert {r["file"] for r in second.collect()} == {"a.py", "c.py"} and not any("supersecret1" in r["text"] for r in second.collect())


def test_answers(spark):
    ranked = spark.createDataFrame([(1, 10, 1, "first text", "a.md"), (1, 11, 2, "second", None)], "query_id long, chunk_id long, rank long, text string, source string")
    s = answer.sources(ranked).first()
    assert s["sources"] == "[1] — a.md\nfirst text\n\n[2]\nsecond" and s["n_sources"] == 2
    said = spark.createDataFrame([(1, "x [2] y [7] z [1] [2]")], "query_id long, answer string")
    assert [(r["position"], r["marker"], r["chunk_id"]) for r in answer.citations(said, ranked).orderBy("position").collect()] == [(1, 2, 11), (2, 1, 10)]
    q = ranked.withColumn("query", F.lit("q"))
    assert [r["chunk_id"] for r in answer.rerank(q, lambda q, t: [1, 1, 9, 0]).orderBy("rank").collect()] == [11, 10]
    assert [r["chunk_id"] for r in answer.rerank(q, lambda q, t: 1 / 0).orderBy("rank").collect()] == [10, 11]
    assert [(r["chunk_id"], r["score"]) for r in answer.rerank_scored(q, lambda q, t: [(1, 0.2), (0, 0.9), (7, 3.0), (1, 0.8)]).orderBy("rank").collect()] == [(10, 0.9), (11, 0.2)]
    assert [r["chunk_id"] for r in answer.rerank_scored(q, lambda q, t: 1 / 0, top=1).collect()] == [10]
    assert answer.generate(answer.sources(ranked), lambda p: "said " + p[:3]).first()["answer"] == "said [1]"
    with pytest.raises(ValueError):
        answer.generate(ranked, None)


def test_evaluation(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    ranked = spark.createDataFrame([(1, i, i, f"d{(i + 1) // 2}") for i in range(1, 5)] + [(2, 1, 1, "d9")], "query_id long, chunk_id long, rank long, doc_id string")
    rel = spark.createDataFrame([(1, "d2"), (2, "zz")], "query_id long, relevant_id string")
    got = {r["query_id"]: r for r in evaluation.per_case(cases, ranked, rel, 4).collect()}
    assert set(got) == {1, 2} and got[1]["mrr"] == pytest.approx(1 / 3, abs=1e-6) and got[2]["hit"] == 0
    assert got[1]["ndcg"] == pytest.approx(1 / math.log2(4) + 1 / math.log2(5), abs=1e-6)  # two chunks of one document
    r = evaluation.report(cases, ranked, rel, 4).first()
    assert r["cases"] == 3 and r["hit_rate"] == 0.5
    with pytest.raises(ValueError):
        evaluation.report(cases.where("false"), ranked, rel, 4)


@pytest.mark.parametrize("block", [100, 2])
def test_scan(spark, block):
    docs = spark.createDataFrame([(1, "abcabc"), (2, "xbcx"), (3, None)], "doc_id long, text string")
    pats = spark.createDataFrame([(1, "abc"), (2, "bc"), (3, "abc"), (4, ""), (5, None), (6, "zz")], "item_id long, text string")
    assert {tuple(r) for r in scan.containing(docs, pats, block=block).collect()} == {(1, 1), (2, 1), (3, 1), (2, 2)}
