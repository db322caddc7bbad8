"""Typed memory records: writing, listing, superseding, statistics."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from . import common


def default_authority(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in config.AUTHORITY.items())), kind), F.lit(0.7))


def remember(rows: DataFrame, now: str = config.NOW) -> DataFrame:
    """New records from (text, kind, subject?, tags?, source?, authority?, supersedes?): stripped, defaulted, with ids made from their content."""
    have = set(rows.columns)

    def given(name: str, kind: str, default: Column | None = None) -> Column:
        c = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return (F.coalesce(c, default) if default is not None else c).alias(name)

    text = T.strip(F.col("text"))
    kind = F.coalesce(F.col("kind"), F.lit("fact"))
    made = F.xxhash64(kind, T.text_or_empty(F.col("subject")) if "subject" in have else F.lit(""), text)
    return rows.where(T.strip(T.text_or_empty(F.col("text"))) != "").select(
        made.alias("record_id"), kind.alias("kind"), text.alias("text"), given("subject", "string"), given("tags", "array<string>", F.array().cast("array<string>")), given("source", "string"),
        given("authority", "double", default_authority(kind)), F.lit("active").alias("status"), given("supersedes", "bigint"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"),
    )


def supersede(records: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` is added, and what it supersedes loses its active status; an id that isn't there is tolerated."""
    old = new.where("supersedes is not null").select(F.col("supersedes").alias("record_id")).distinct().withColumn("hit", F.lit(True))
    marked = records.join(old, "record_id", "left").withColumn("status", F.when(F.col("hit"), "superseded").otherwise(F.col("status"))).drop("hit")
    return marked.unionByName(new, allowMissingColumns=True)


def forget(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("record_id"), "record_id", "left_anti")


def listed(records: DataFrame, kind: str | None = None, *, status: str | None = "active") -> DataFrame:
    """Records of a kind and a status; None takes all."""
    want = {k: v for k, v in (("kind", kind), ("status", status)) if v is not None}
    return records.where(common.matches(want))


def get(records: DataFrame, record_id: int) -> DataFrame:
    """The record of an id: no row or one; the filter is pushed into the scan."""
    return records.where(F.col("record_id") == F.lit(record_id))


def stats(records: DataFrame) -> DataFrame:
    """(kind, n_active, n_total); kinds without records are there with zeros."""
    kinds = F.broadcast(records.sparkSession.createDataFrame([(k,) for k in config.KINDS], "kind string"))
    got = records.groupBy("kind").agg(F.sum((F.col("status") == "active").cast("long")).alias("n_active"), F.count("*").alias("n_total"))
    return kinds.join(got, "kind", "left").select("kind", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("n_total", F.lit(0)).cast("long").alias("n_total"))


def keep_latest(rows: DataFrame, subject: str, order: list[str]) -> DataFrame:
    """The last row of each subject: a partial aggregate, so no subject is gathered."""
    last = common.last([c for c in rows.columns if c not in (*order, subject)], order, rows)
    return rows.groupBy(subject).agg(last.alias("x")).select(subject, "x.*")


def replace_inferred(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds (text, kind, subject, source) replace the active records of their subjects that are tagged as inferred; authority 0.5."""
    mine = remember(seeds.withColumn("authority", F.lit(0.5)).withColumn("tags", F.array(F.lit("inferred"))))
    old = records.where((F.col("status") == "active") & F.array_contains("tags", "inferred")).join(mine.select("subject"), "subject", "left_semi").select("record_id")
    return forget(records, old).unionByName(mine, allowMissingColumns=True)


def recent_decisions(records: DataFrame, n: int = 8, chars: int = 220) -> DataFrame:
    """The latest active decisions, cut to ``chars``: a briefing's list."""
    use = listed(records, "decision").orderBy(F.col("updated_at").desc(), "record_id").limit(n)
    return use.select("record_id", "subject", F.substring("text", 1, chars).alias("text"), "updated_at")


def briefing(records: DataFrame, budget: int = 1000) -> str:
    """A session's opening text: counts and recent decisions; lines before the last go until the budget holds."""
    counts = {r["kind"]: r["n_active"] for r in stats(records).collect()}
    lines = ["memory: " + ", ".join(f"{counts[k]} {k}" for k in config.KINDS)]
    lines += [f"- {r['subject'] or 'decision'}: {r['text']}" for r in recent_decisions(records).collect()]
    lines.append("recall before answering")
    while len(lines) > 3 and (len("\n".join(lines)) + 3) // 4 > budget:
        lines.pop(-2)
    return "\n".join(lines)


def from_documents(docs: DataFrame, labels: DataFrame, now: str = config.NOW) -> DataFrame:
    """Memory records out of a corpus: kind by language, authority by labelled quality, superseded if an equal text has a lesser id, updated doc_id % 400 days before ``now``."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    rows = docs.select(F.col("doc_id").alias("record_id"), "text", "source", "lang", digest.alias("digest"))
    least = rows.groupBy("digest").agg(F.min("record_id").alias("least"))
    quality = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumnRenamed("doc_id", "record_id")
    kind = F.when(F.col("lang") == "en", "fact").when(F.col("lang") == "de", "decision").when(F.col("lang") == "fr", "episode").otherwise("code")
    r = rows.join(least, "digest").join(quality, "record_id", "left").withColumn("kind", kind)
    authority = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.5).otherwise(default_authority(F.col("kind")))
    at = F.lit(now).cast("timestamp") - F.make_dt_interval((F.col("record_id") % 400).cast("int"))
    return r.select(
        "record_id", "kind", "text", F.concat("source", F.lit("-"), (F.col("record_id") % 25).cast("string")).alias("subject"), "source", authority.alias("authority"),
        F.when(F.col("record_id") == F.col("least"), "active").otherwise("superseded").alias("status"), F.lit(None).cast("bigint").alias("supersedes"), at.alias("updated_at"),
    )


def window(turns: DataFrame, max_turns: int = 3) -> DataFrame:
    """The last ``2 * max_turns`` messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("back", F.row_number().over(w).cast("long")).where(F.col("back") <= 2 * max_turns)
