import duckdb
import pytest

from tidemark.operators import dense
from tidemark.plans import sql as S


def test_hashed_terms_of_single_ids_need_no_shuffle(spark):
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} ÀÉ") for i in range(20)], "doc_id long, text string")
    assert "Exchange" not in dense.hashed_terms(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [[], [(1, "a b a"), (2, None), (3, ""), (4, "Élan 中文 z" * 50)], [(1, "a b"), (1, "b c"), (None, "x"), (None, "x y"), (2, "q"), (3, "b"), (3, None)]])
def test_hashed_terms_equal_sql(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.sql(f"with {S.hashed('h', 'documents', 'doc_id', 'text')} select id, dim, val from h").fetchall()
    assert sorted(map(tuple, dense.hashed_terms(docs, "doc_id", "text").collect()), key=repr) == sorted(want, key=repr)
