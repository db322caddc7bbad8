import math

import duckdb
import pytest

from tidemark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    one = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = plans.queries()[name](spark, DIR)
    want = duck.sql(plans.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    at = [want.columns.index(c) for c in cols]
    assert plain(rows) == plain([tuple(r[i] for i in at) for r in want.fetchall()])


def test_html_references_without_semicolon(spark, tmp_path):
    """Pages cut in the midst of a reference, as one of 64,102 is."""
    some = ["a &quot", "&quot;b&quot", "x &lt y &lt;", "&gt", "q=1&copy=2&middot", "&amp &ampquot; &amplt; &amp;quot &amp;&quot;", "& &a &; &nosuch; &ltx; &#", "\ue000 &quot", "&copy;&middot;"]
    rows = [(i, f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p title='{t}'>{t} z</p></body></html>") for i, t in enumerate(some)] + [(len(some), None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = {r["page_id"]: r["text"] for r in plans.queries()["html_text"](spark, str(tmp_path)).collect()}
    assert got == dict(con.sql(plans.oracle_sql()["html_text"]).fetchall())
    assert got[0] == "a &quot\na &quot z"


SIZE, OVERLAP = 1600, 200


def pieces(text, cuts=("\n\n", "\n", ". ", " ")):
    """Parts of a text that no further cut makes smaller, or that fit."""
    if len(text) <= SIZE or not cuts:
        return [text]
    out = []
    while text:
        head, cut, text = text.partition(cuts[0])
        out += pieces(head + cut, cuts[1:]) if len(head + cut) > SIZE else [head + cut]
    return out


def cut(text):
    chunks, at = [], ""
    for p in pieces(text):
        if not p.strip():
            continue
        if at and len(at + p) > SIZE:
            chunks.append(at)
            at = at[-OVERLAP:]
        at += p
    return [c for c in [*chunks, at] if c.strip()]


def sections(text):
    """(heading path, body) of a Markdown text, line by line."""
    path, out, body = {}, [], ""
    name = ""
    for line in text.split("\n"):
        hashes = len(line) - len(line.lstrip("#"))
        if 1 <= hashes <= 6 and line[hashes : hashes + 1].isspace():
            out.append((name, body))
            path = {k: v for k, v in path.items() if k < hashes} | {hashes: line[hashes:].strip()}
            name, body = " > ".join(path[k] for k in sorted(path)), ""
        body += line + "\n"
    return [(n, b) for n, b in [*out, (name, body)] if b.strip()]


def blocks(text):
    """A source text cut before each line that begins a definition."""
    words = "def class function fn func impl interface struct enum type pub".split()
    out = [""]
    for line in text.split("\n"):
        rest = line.removeprefix("export ").lstrip().removeprefix("async ").lstrip()
        if rest.split(" ")[0].split("(")[0].rstrip(":") in words and out[-1]:
            out.append("")
        out[-1] += line + "\n"
    return out


@pytest.mark.parametrize("name", ["chunk_recursive", "chunk_markdown", "chunk_dispatch"])
def test_chunks_are_brute_force(spark, duck, name):
    """Every chunk with its place and heading, against a restatement."""
    want = []
    for doc_id, text, lang, source in duck.sql("select doc_id, text, lang, source from documents").fetchall():
        how = {"chunk_recursive": "r", "chunk_markdown": "m"}.get(name) or {"en": "m", "de": "c"}.get(lang, "r")
        if name == "chunk_markdown":
            text = f"# {source}\n## {lang}\n{text}"
        if how == "m":
            got = [(c, h) for h, b in sections(text) for c in (cut(b) if len(b.rstrip("\n")) > SIZE else [b])]
        elif how == "c":
            got = [(c, "") for b in blocks(text) for c in (cut(b) if len(b) > SIZE else [b])]
        else:
            got = [(c, "") for c in cut(text)]
        got = [(c.strip(), h) for c, h in got if c.strip()]
        want += [(doc_id, i, c, h or None) for i, (c, h) in enumerate(got)]
    got = [(r["doc_id"], r["seq"], r["text"], r["heading"]) for r in plans.queries()[name](spark, DIR).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_query_is_held_against_something():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"chunk_recursive", "chunk_markdown", "chunk_dispatch"}
