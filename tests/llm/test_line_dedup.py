import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs, policy="all", min_chars=1):
    seen = defaultdict(set)
    first = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        for p, line in enumerate((rows[i][1] or "").split("\n")):
            seen[key(line)].add(rows[i][0])
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [len(key(x)) >= min_chars and len(seen[key(x)]) >= min_docs for x in lines]
        out.append((i, len(lines), sum(drop), "\n".join(x for x, d in zip(lines, drop) if not d)))
    return out, seen, first


@pytest.mark.parametrize("min_docs", [1, 2, 3, 10])
def test_all_policy_is_brute_force(docs, rows, min_docs):
    got = sorted(map(tuple, L.dedup(docs, min_docs=min_docs).collect()), key=repr)
    assert got == sorted(brute(rows, min_docs)[0], key=repr)


def test_small_batches_and_split_keys(spark, rows):
    many = [(i, "hot line\n" + f"own {i}") for i in range(400)] + [(1000 + i, f"pair {i // 2}\npair {i // 2}") for i in range(60)]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(7)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for min_docs in (2, 10):
            got = sorted(map(tuple, L.dedup(df, min_docs=min_docs).collect()))
            assert got == sorted(brute(many, min_docs)[0])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_first_occurrence_stays(spark):
    many = [(i, "hot line\n" + f"own {i}\nhot line") for i in range(300)] + [(900, "solo")]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r for r in L.dedup(df, min_docs=5, policy="after_first").collect()}
    assert got[0]["kept"] == "hot line\nown 0" and got[0]["n_dropped"] == 1
    assert all(got[i]["kept"] == f"own {i}" and got[i]["n_dropped"] == 2 for i in range(1, 300))
    assert got[900]["kept"] == "solo"


def test_empty_table_and_options(nothing, docs):
    assert L.dedup(nothing).collect() == []
    with pytest.raises(ValueError):
        L.drops(docs, policy="none")
    assert L.dedup(docs, min_chars=1_000_000, min_docs=1).agg(F.sum("n_dropped")).first()[0] == 0


def test_query(spark, rows, tmp_path):
    from tidemark.llm import registry

    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, registry.op1_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows, 10)[0]], key=repr)


def test_parts_of_a_long_text():
    """Lines taken in parts have the keys and places that they have whole."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["ab\n\n" + "\n".join(f"Line {i} " * (i % 5) for i in range(60)) + "\n", None, "x" * 300 + "\ny", "\n"])
    join = lambda parts: [np.concatenate(x).tolist() for x in zip(*(p[2:] for p in parts))]
    whole = join(L._keys(texts, 1))
    assert len(whole[0]) > 40
    for piece in (1, 7, 50, 299, 300):
        assert join(L._keys(texts, 1, piece)) == whole


def test_extra_columns_with_the_names_of_results(spark):
    df = spark.createDataFrame([(1, "a\nb", "mine", 7)], "doc_id long, text string, kept string, n_lines long")
    got = L.dedup(df, min_docs=5, extra=("kept", "n_lines", "doc_id"))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"] and tuple(got.first()) == (1, 2, 0, "a\nb")


def test_many_rows_of_one_id_before_the_bound(spark, monkeypatch):
    """Runs with more rows than are held before they have enough documents are decided from summaries."""
    monkeypatch.setattr(L, "HELD", 5)
    rows = [(None, f"hot\nown {i}") for i in range(60)] + [(i, "hot") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n in (4, 5):
        got = sorted(map(tuple, L.dedup(df, min_docs=n).collect()), key=repr)
        assert got == sorted(brute(rows, n)[0], key=repr)
