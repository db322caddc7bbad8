import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm import registry

from .test_near_dedup import brute as near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    d = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{d}/documents.parquet")
    text = real.orderBy("doc_id").first()["text"]
    own = [(9000 + i, "shared top line\n" + f"own line {i} of a text that has some words of its own, number {i}", "en", "s", 0) for i in range(30)]
    own += [(9100 + i, text, "fr", "s", 0) for i in range(15)] + [(9200, None, "en", "s", 0), (9201, "", None, None, None), (9202, "123 456", "en", "s", 7)]
    real.unionByName(spark.createDataFrame(own, real.schema)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_does_its_work(spark, folder):
    docs = registry.table(spark, folder, "documents")
    bench = [r["text"] for r in registry.table(spark, folder, "benchmark").collect()]
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs, _ = P.shared.written(stage(spark, before, folder), f"test-{name}")
        a = {r["doc_id"]: r.asDict() for r in before.collect()}
        b = {r["doc_id"]: r.asDict() for r in docs.collect()}
        assert set(b) <= set(a) and len(b) == docs.count()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            assert set(a) - set(b) == {9200, 9201, 9202} and all(a[i] == b[i] for i in b)
        elif name == "line_dedup":
            top = [i for i in b if "shared top line" in b[i]["text"]]
            assert top == [9000] and all(9000 + i in b for i in range(30)) and not {9101, 9114} & set(b)
            assert all(re.search(r"\S", r["text"]) and r["n_chars"] == len(r["text"]) for r in b.values() if r["text"] != a[r["doc_id"]]["text"])
        elif name == "near_dedup":
            want = {i for i, _, _, kept in near([(i, a[i]["text"]) for i in a]) if kept}
            assert set(b) == want
        elif name == "decontaminate":
            leaked = {i for i in a if any(q in a[i]["text"] for q in bench)}
            assert not leaked & set(b) and len(set(a) - set(b) - leaked) <= 1
        else:
            assert set(b) == set(a) and all(r["decodes"] for r in b.values())


def test_run_and_entry(spark, folder):
    import __spark_entry__ as E

    got = P.run(spark, folder)
    assert got.where(~F.col("decodes")).count() == 0 and got.count() > 50
    names = E.queries()
    assert {f"op{i}_" for i in range(1, 11)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")} and "pipeline" in names
    assert "pipeline" not in E.oracle_sql() and set(E.oracle_sql()) <= set(names)


def test_leaks_go_by_row(spark, folder):
    bench = registry.table(spark, folder, "benchmark").first()["text"]
    rows = [(None, bench, "en", "s", 0), (None, "a clean text with no id", "en", "s", 0), (7, bench, "en", "s", 0), (7, "a clean text with the id of a leak", "en", "s", 0)]
    docs = spark.createDataFrame(rows, registry.table(spark, folder, "documents").schema)
    got = P.decontaminate_benchmark(spark, docs, folder).collect()
    assert sorted((r["text"] for r in got)) == ["a clean text with no id", "a clean text with the id of a leak"]


def test_empty_table_and_extra_columns(spark, folder, nothing):
    """Every stage keeps an empty table empty, with its columns; extra columns with names that operators use are dropped."""
    docs = nothing
    for name, stage in P.STAGES:
        docs, _ = P.shared.written(stage(spark, docs, folder), f"empty-{name}")
        assert docs.count() == 0 and (name == "sentencepiece" or docs.columns == list(P.COLUMNS))
    some = registry.table(spark, folder, "documents").limit(30).selectExpr("*", "doc_id as row", "text as kept", "1 as id", "2 as n", "'x' as score")
    assert P.identify_language(spark, some, folder).columns == list(P.COLUMNS)
    assert P.dedup_lines(spark, some, folder).columns == list(P.COLUMNS)
    assert P.dedup_near(spark, some, folder).columns == list(P.COLUMNS)
    assert P.decontaminate_benchmark(spark, some, folder).columns == list(P.COLUMNS)


def test_null_ids_and_repeated_rows(spark, folder, nothing):
    body = "one two three four five six seven eight nine ten eleven twelve words of a text that is english and plain number "
    rows = [(None, body + "a", "en", "s", 1), (None, body + "a", "en", "s", 1), (None, None, None, None, None), (5, body + "b and some more of it here to be told apart from all of the others", None, "s", None), (5, "la casa del rey estaba en la colina y ellos han sido con esta para que cosa", "es", None, 3)]
    docs = spark.createDataFrame(rows, nothing.schema)
    for _, stage in P.STAGES:
        docs, _ = P.shared.written(stage(spark, docs, folder), "nulls")
    assert sorted((r["doc_id"] is None, r["decodes"]) for r in docs.collect()) == [(False, True), (False, True), (True, True), (True, True)]
