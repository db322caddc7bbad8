import subprocess
import sys
import textwrap
from pathlib import Path

import pytest

import __spark_entry__ as E
from tidemark import plans

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(plans.queries()) <= set(E.queries())


def test_missing_modules_are_left_out_but_errors_are_not(monkeypatch):
    assert E._optional("corpus_pipeline_that_is_not_there") is None
    (probe := ROOT / "tests" / "_broken_probe.py").write_text("import a_library_that_is_not_there\n")
    try:
        with pytest.raises(ModuleNotFoundError):
            E._optional("tests._broken_probe")
    finally:
        probe.unlink()


def test_entry_works_without_the_corpus_half():
    """The rest imports with both folders and the pipeline hidden."""
    code = """
        import sys
        class Hide:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("tidemark.llm"):
                    raise ModuleNotFoundError("hidden", name="tidemark.llm" if name.startswith("tidemark") else name)
        sys.meta_path.insert(0, Hide())
        import __spark_entry__ as E
        names = E.queries()
        assert names and not any(n.startswith("op") for n in names) and "pipeline" not in names and set(E.oracle_sql()) <= set(names)
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=ROOT, timeout=120)


def test_flagship(spark):
    got = E.entry(spark)
    assert got.columns[:3] == ["query_id", "score", "mode"] and got.count() > 0


def test_nothing_else_imports_the_corpus_half():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm import" not in p.read_text() and "tidemark.llm" not in p.read_text(), p
