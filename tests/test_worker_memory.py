import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import chunking, common, dense, lexical

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    old = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY) if old is None else spark.conf.set(KEY, old)


def largest(spark):
    """Bytes of the largest batch of 300 texts of 100 kB in one partition."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    return rows.mapInArrow(run, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("step", ["chunk", "forward", "dense"])
def test_batches_to_python_are_bounded(spark, unset, step):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert largest(spark) > 20 << 20
    if step == "chunk":
        chunking.chunk(docs)
    elif step == "forward":
        lexical.forward(docs, "doc_id", "text")
    else:
        dense.search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>"), spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), 3)
    assert largest(spark) < common.BATCH_BYTES + (1 << 20)


def test_a_session_keeps_its_own_batch_size(spark, unset):
    spark.conf.set(KEY, "123456")
    common.small_batches(spark)
    assert spark.conf.get(KEY) == "123456"


def test_tokens_of_many_texts_take_bounded_memory():
    texts = pa.array([" ".join(f"{i % 97}w{j % 911}" for j in range(2000)) for i in range(1000)])
    signs = kernels.Signs()
    tracemalloc.start()
    try:
        for lo, hi, buf, offs in kernels.slices(texts):
            h, s, e, d = kernels.tokens(buf, offs)
            signs(h, h, buf, s, e)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("most", [0, 50, 500_000])
def test_signs_are_md5(most):
    signs = kernels.Signs(most)
    rng = np.random.default_rng(1)
    for _ in range(20):
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        h, s, e, _ = kernels.tokens(raw, np.array([0, len(raw)]))
        dim, sign = signs(h, h, raw, s, e)
        digests = [hashlib.md5(w.encode()).digest() for w in words]
        assert dim.tolist() == [d[0] for d in digests] and sign.tolist() == [-1.0 if (d[1] >> 4) % 2 else 1.0 for d in digests]
        assert (np.diff(signs.keys.astype(object)) > 0).all()
