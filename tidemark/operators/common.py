"""Top-k, filters and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a query-side table that is broadcast at most; more go by shuffle or in blocks.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch that goes to a Python worker, unless the session sets them.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Python workers hold several batches and what is made of them, so a batch of Spark's default, 64 MB, takes hundreds of MB in each. The session keeps the setting, as it is read when a job runs; one of its own stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has ``rows`` rows at most; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its size, checked, allows it."""
    return F.broadcast(df) if bounded(df, rows) else df


def top_k(df: DataFrame, k: int, by: str = "query_id", item: str = "chunk_id", score: str = "score", digits: int = 6) -> DataFrame:
    """The k best rows of each query, ranked from 1: by score rounded to ``digits``, then by id. Catalyst prunes with a window group limit before the shuffle."""
    ranked = df.withColumn(score, F.round(score, digits))
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(item))
    return ranked.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def matches(filters: dict[str, object]) -> Column:
    """AND over keys: a scalar is null-safe equality, a sequence is membership; null in it matches missing."""
    out = F.lit(True)
    for key, want in filters.items():
        if isinstance(want, Sequence) and not isinstance(want, str):
            some = [w for w in want if w is not None]
            one = F.col(key).isin(some) if some else F.lit(False)
            out = out & (F.coalesce(one, F.lit(False)) | (F.col(key).isNull() if None in want else F.lit(False)))
        else:
            out = out & F.col(key).eqNullSafe(F.lit(want))
    return out


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return all(_orderable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


def last(columns: Sequence[str], order: Sequence[str], of: DataFrame) -> Column:
    """An aggregate: the columns (and those of ``order``) of the row that comes last by ``order``, then by the others; ones without an order, as maps have none, compare as JSON."""
    rows = F.struct(*order, *columns)
    odd = [c for c in columns if not _orderable(of.schema[c].dataType)]
    if not odd:
        return F.max(rows)
    return F.max_by(rows, F.struct(*order, *(F.to_json(F.struct(c)).alias(c) if c in odd else F.col(c) for c in columns)))
