import json

from pyspark.sql import functions as F

from tidemark import session as S
from tidemark.operators import code_index, memory


def test_root_settings_and_counters(tmp_path):
    deep = tmp_path / "a/b"
    deep.mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    assert S.project_root(deep) == tmp_path.resolve()
    (tmp_path / "a" / S.FOLDER).mkdir()
    assert S.project_root(deep) == (tmp_path / "a").resolve()
    assert S.settings(tmp_path) == S.Settings()
    (tmp_path / S.FOLDER).mkdir()
    (tmp_path / S.FOLDER / "config.toml").write_text("[recall]\nbudget_tokens = 99\nstrict = true\nother = 1\n")
    assert S.settings(tmp_path) == S.Settings(budget_tokens=99, strict=True)
    (tmp_path / S.FOLDER / "config.toml").write_text("[recall")
    assert S.settings(tmp_path) == S.Settings()
    c = S.Counters(tmp_path)
    assert c.bump("x") == 1 and c.bump("x", 4) == 5 and c.read() == {"x": 5}
    c.path.write_text("{")
    assert c.read() == {} and c.bump("y") == 1


def test_block(spark):
    a = spark.createDataFrame([(1, "direct", 0.875, "go", "- line"), (2, "refuse_guess", 0.0, "no", "")], "query_id long, mode string, score double, suggestion string, context string")
    e = spark.createDataFrame([(1, i, f"f{i % 7}.md" if i else None, "subj") for i in range(9)], "query_id long, rank int, source string, subject string")
    got = {r["query_id"]: r["block"] for r in S.context_block(a, e).collect()}
    assert got[1] == '<memory mode="direct" confidence="0.88">\ngo\n- line\nsources: subj, f1.md, f2.md, f3.md, f4.md\n</memory>'
    assert "sources" not in got[2]


def test_seed_and_index_file(spark, tmp_path):
    (tmp_path / "README.md").write_text("# Thing\nIt does things. token = abcdefgh12345\n")
    (tmp_path / "pyproject.toml").write_text('[project]\nscripts = {go = "m:main"}\n[tool.pytest]\n')
    (tmp_path / "package.json").write_text(json.dumps({"scripts": {"build": "x"}}))
    (tmp_path / "m.py").write_text("def main(): pass\n")
    none = memory.remember(spark.createDataFrame([], "text string, kind string, subject string"))
    once = S.seed(spark, str(tmp_path), none)
    got = {r["subject"]: r for r in once.collect()}
    assert set(got) == {"project-brief", "project-languages", "project-entry-points", "project-tests", "project-seed"}
    assert "abcdefgh" not in got["project-brief"]["text"] and got["project-languages"]["text"] == "Languages: python (1)" and got["project-tests"]["authority"] == 0.5
    assert S.seed(spark, str(tmp_path), once).where("status = 'active' and kind = 'fact'").count() == 4
    first, changed = S.index_file(code_index.records(code_index.files(spark.createDataFrame([("b.py", "y = 1")], "file string, text string"))), spark.createDataFrame([("a.py", "x = 1")], "file string, text string"))
    assert changed and {r["file"] for r in first.collect()} == {"a.py", "b.py"}
    _, again = S.index_file(first, spark.createDataFrame([("a.py", "x = 1")], "file string, text string"))
    assert not again and first.where(F.col("file") == "b.py").count() == 1
