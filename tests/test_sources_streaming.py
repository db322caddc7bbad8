import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark import schema
from tidemark.streaming import events


def test_folder(spark, tmp_path):
    put = lambda p, b: ((tmp_path / p).parent.mkdir(parents=True, exist_ok=True), (tmp_path / p).write_bytes(b))
    put("a.md", "﻿# hi\n\n\n\n\n\nthere".encode())
    put("sub/b.txt", b"text \xff end")
    put("c.exe", b"x")
    put("node_modules/d.md", b"no")
    put("e.html", b"<head><style>x</style></head><h1>T &amp; U</h1><p>p<script>s</script></p>")
    put("f.json", b'{"a": "\xc3\xa9"}')
    put("g.txt", b"  \n")
    got = {r["source"]: r for r in files.load_path(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a.md", "sub/b.txt", "e.html", "f.json"}
    assert got["a.md"]["text"] == "# hi\n\n\nthere" and got["e.html"]["text"] == "T & U\np" and got["f.json"]["text"] == '{\n  "a": "é"\n}' and "�" in got["sub/b.txt"]["text"]
    assert got["sub/b.txt"]["metadata"] == {"filename": "b.txt", "suffix": ".txt"}
    assert files.load_path(spark, f"file://{tmp_path}/a.md").count() == 1
    assert {r["source"] for r in files.load_path(spark, f"file://{tmp_path}", recursive=False).collect()} == {"a.md", "e.html", "f.json"}
    with pytest.raises(files.IngestionError):
        files.load_path(spark, f"file://{tmp_path}/none")


def test_other_sources(spark, tmp_path):
    got = files.inline(spark, [{"text": "a", "id": "mine"}, {"text": " "}, {"text": "b", "metadata": {"k": 1}}]).collect()
    assert got[0]["doc_id"] == "mine" and got[1]["doc_id"].startswith("doc_") and got[1]["metadata"] == {"k": "1"}
    (tmp_path / "e.jsonl").write_text('{"query":"q","relevant_ids":["a"]}\n\n{"query":"r"}\n')
    assert [r["relevant_ids"] for r in files.eval_cases(spark, str(tmp_path / "e.jsonl")).orderBy("query").collect()] == [["a"], []]
    lines = [("s", i, json.dumps({"summary": f"s{i}", "type": "summary"} if i % 100 == 5 else {"type": "x"})) for i in range(400)]
    assert files.transcript_summary(spark.createDataFrame(lines, "session_id string, line_no long, value string")).first()["summary"] == "s305"
    assert files.ignore_globs("# c\nprivate/\n\n*.x\n") == ["private", "*.x"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.py").write_text("x = 1")
    (tmp_path / "src/.env.py").write_text("x = 1")
    assert [r["file"] for r in files.code_files(spark, f"file://{tmp_path}/src").collect()] == ["m.py"]
    rows = spark.createDataFrame([("README.md",), ("docs/x.txt",), ("src/a.py",), ("pyproject.toml",), ("credentials.md",), ("id_rsa.md",)], "file string")
    assert [r["file"] for r in files.doc_files(rows).collect()] == ["README.md", "credentials.md", "docs/x.txt", "pyproject.toml"]


def test_streams(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    for i in range(3):
        ev.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    q = events.keep_latest(events.events(spark, src), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    kept = events.latest(spark, str(tmp_path / "out"), schema.EVENT)
    got = {(r["user_id"], r["event_id"]) for r in kept.collect()}
    want = {(r["user_id"], r["e"]) for r in ev.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("e")).collect()}
    assert got == want and kept.columns == ev.columns
    assert all(len(list(p.glob("batch=*"))) <= 2 for p in (tmp_path / "out").glob("bucket=*")), "older state goes"
    w = events.windowed(events.events(spark, src)).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == ev.count()


def test_recall_stream_keeps_going(spark, tmp_path):
    src = str(tmp_path / "q")
    spark.createDataFrame([(1, "hello there world")], "query_id long, query string").write.parquet(src)
    stream = lambda: spark.readStream.schema("query_id long, query string").parquet(src)
    events.recalled(stream(), lambda b: events.gate(b, "query"), str(tmp_path / "o"), str(tmp_path / "e"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o" / "batch=0")).count() == 1

    def broken(b):
        raise RuntimeError("no memory")

    events.recalled(stream(), broken, str(tmp_path / "o2"), str(tmp_path / "e2"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "e2" / "batch=0")).first()["error"] == "no memory"
    code = str(tmp_path / "code")
    spark.createDataFrame([("a.py", "def f(): pass\n")], "file string, text string").write.parquet(code)
    events.reindexed(spark.readStream.schema("file string, text string").parquet(code), str(tmp_path / "o3"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o3" / "batch=0")).count() == 2


def test_gates(spark):
    df = spark.createDataFrame([("tell me about the pipeline",), ("/clear and more text",), ("short",), (None,)], "prompt string")
    assert [r["prompt"] for r in events.gate(df).collect()] == ["tell me about the pipeline"]
    a = spark.createDataFrame([("direct", "c", 0.9), ("refuse_guess", "c", 0.9), ("direct", "", 0.9), ("direct", "c", 0.1)], "mode string, context string, score double")
    assert events.injectable(a).count() == 1
