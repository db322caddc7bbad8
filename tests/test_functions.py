import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    def run(expr, **cols):
        df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()))
        return df.select(expr).first()[0]

    return run


def test_tokens(one):
    assert one(T.tokens(F.col("t")), t="Café_au lait, ЯК 漢字! x1") == ["café", "au", "lait", "як", "漢字", "x1"]
    assert one(T.tokens(F.col("t"), True), t="ﬁne Ⅷ") == ["fine", "viii"]
    assert one(T.tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("t,n", [("", 1), ("abc", 1), ("abcde", 2), ("x" * 400, 100)])
def test_token_estimate(one, t, n):
    assert one(T.token_estimate(F.col("t")), t=t) == n


def test_jaccard(one):
    a = F.array(F.lit("a"), F.lit("b"))
    assert one(T.jaccard(a, F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(T.jaccard(a, F.array().cast("array<string>"))) == 0


@pytest.mark.parametrize("d,label", [(0.5, "today"), (1.0, "1d"), (59.9, "59d"), (60.0, "2mo"), (400.0, "13mo")])
def test_age_label(one, d, label):
    assert one(T.age_label(F.col("d")), d=d) == label


def test_two_places_is_half_even(one):
    assert one(T.two_places(F.lit(0.125))) == "0.12" and one(T.two_places(F.lit(1234.5))) == "1234.50"


def test_normalise_and_hash(one):
    assert one(T.query_norm(F.col("q")), q="  How\t IS\n it ") == "how is it"
    assert one(T.hash16(F.col("t")), t="é") == hashlib.sha256("é".encode()).hexdigest()[:16]
    assert one(T.bash_subject(F.col("c")), c=" ls -la\nmore") == "bash:" + hashlib.sha1(b"ls -la").hexdigest()[:8]


SECRET = {
    "key sk-" + "a1B2" * 5: "key [REDACTED]", "AKIA" + "ABCD1234" * 2 + " x": "[REDACTED] x", "ghp_" + "a" * 24: "[REDACTED]", "github_pat_" + "b" * 22: "[REDACTED]", "glpat-" + "c" * 18: "[REDACTED]",
    "xoxb-" + "1" * 12: "[REDACTED]", "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9: "[REDACTED JWT]", "bearer " + "t" * 20: "Bearer [REDACTED]", "see db://me:hunter22@host/x": "see db://me:[REDACTED]@host/x",
    "password = 'longenough1'": "password = '[REDACTED]", "API-KEY: 123456789": "API-KEY: [REDACTED]", "\n".join(["-----".join(["", "BEGIN RSA PRIVATE KEY", ""]), "abc", "-----".join(["", "END RSA PRIVATE KEY", ""])]): "[REDACTED PRIVATE KEY]",
}


def test_redaction(spark):
    df = spark.createDataFrame([(k,) for k in SECRET], "t string")
    got = df.select("t", T.redact(F.col("t")).alias("r"), T.contains_secret(F.col("t")).alias("s")).collect()
    for r in got:
        assert r["r"] == SECRET[r["t"]] and r["s"]
    clean = ["a token of thanks", "password: short", "sk-short", "http://host/path"]
    got = spark.createDataFrame([(k,) for k in clean], "t string").select("t", T.redact(F.col("t")), T.contains_secret(F.col("t"))).collect()
    assert all(r[0] == r[1] and not r[2] for r in got)


def test_patterns_do_in_python_what_they_do_in_java(spark):
    texts = list(SECRET) + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.redact(F.col("t"))).collect()
    for t, r in zip(texts, got):
        for p, by in T.SECRETS:
            t = re.sub(p, re.sub(r"\$(\d)", r"\\\1", by), t)
        assert t == r[0]


def test_paths(spark):
    bad = ["a/.env.local", "id_rsa", "x/server.pem", "deep/credentials.json", ".netrc", "my_cookies.txt", "ssh/config", "A/SECRETS"]
    good = ["a/env.py", "src/key.py", "readme.md", "pem/x.txt"]
    df = spark.createDataFrame([(p,) for p in bad + good], "p string")
    assert [r[0] for r in df.select(T.sensitive_path(F.col("p"))).collect()] == [True] * len(bad) + [False] * len(good)
    globs = ["private", "*.secret.md", "notes", "b?r/*"]
    paths = ["private/x/y.md", "a/k.secret.md", "notes", "bar/x", "publicprivate/x", "note/s"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(T.ignored_path(F.col("p"), globs)).collect()
    assert [r[0] for r in got] == [True, True, True, True, False, False]
    tests = spark.createDataFrame([(p,) for p in ["test_a.py", "x/b_test.py", "a.spec.ts", "b.test.js", "contest.py"]], "p string").select(T.test_file(F.col("p"))).collect()
    assert [r[0] for r in tests] == [True, True, True, True, False]


def test_learning_from_commands(one):
    say = lambda c, o: one(T.learned_from_bash(F.col("c"), F.col("o")), c=c, o=o)
    assert say("pytest -q", "..\n3 passed in 1s\n") == "Test run `pytest -q`: 3 passed in 1s"
    assert say("pytest -q", "nothing") is None
    assert say("python x.py", "Traceback (most recent call last):\n  File\nValueError: bad\n") == "Command failed `python x.py`: ValueError: bad"
    assert say("ls", "a b c") is None


def test_other_texts(one):
    assert one(T.search_query(F.col("t")), t="def\\s+foo(bar)") == "def s foo bar" and one(T.search_query(F.col("t")), t="()") is None
    assert one(T.readme_brief(F.col("t")), t="# T\n\n[![b]\n![i]\nhello\nworld") == "# T hello world"
    assert one(T.response_text(F.col("j")), j='{"stdout":"a","stderr":"","output":"b"}') == "a\nb" and one(T.response_text(F.col("j")), j="plain") == "plain"
    assert one(T.index_text(F.lit(" c "), F.lit("t"))) == "c\n\nt" and one(T.index_text(F.lit(""), F.lit("t"))) == "t"
    assert one(T.collapse_newlines(F.col("t")), t="a\n\n\n\n\nb") == "a\n\n\nb"
