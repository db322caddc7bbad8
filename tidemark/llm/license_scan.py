"""License scans by diagonal voting.

Rolling word k-gram hashes of every whole text are hash-joined with the positions of the
templates' k-grams. A hit lies on the diagonal text position - template position; hits are
counted by diagonal, diagonals within ``slack`` of each other are merged (words put in or left
out move the diagonal), and a merged span is verified by the share of the template's words
that its hits cover and by its length. Phrases with fixed labels are found beside that.

Up to ``MAX_GRAMS`` template k-grams are broadcast, more are joined by a shuffle; a text sends only the
grams that pass a bit table of those hashes. Any number of phrases and templates will do. One row of
the text table stays one row of the result: rows are told apart by a row number, so repeated ids
don't mix, and columns besides id and text aren't read, so names may be any.
Null and empty texts: no words, no labels, score 0. An empty table gives no rows. Words that two
templates claim go to the one with more votes, then to the one that they cover more of; on a tie both stay.
A text is held whole in one task, at some 30 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .license_texts import BODIES

K = 3
#: Template grams that are broadcast at most (20 bytes each).
MAX_GRAMS = 200_000
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: By label: short grants and notices as authors write them, then the standard bodies and file headers.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "free software under the terms of the gnu general public license version 3 or later"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit-release", "released under the mit license"),
    ("mit-release", "licensed under the mit license"),
    ("bsd-3-clause", "licensed under the bsd 3 clause license"),
    ("bsd-2-clause", "licensed under the bsd 2 clause license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    *BODIES,
)


def template_grams(templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K) -> list[tuple[int, int, int]]:
    """(hash as signed long, template, position) of each template's k-grams."""
    out = []
    for t, (_, text) in enumerate(templates):
        h = tk.word_hashes(text, tk.LETTER_DIGIT)
        g, _ = tk.grams(h, np.zeros(len(h), np.int64), k)
        out += [(int(x), t, i) for i, x in enumerate(g.view(np.int64))]
    return out


def _scanner(phrases: Sequence[tuple[str, str]], grams: list[tuple[int, int, int]], k: int):
    wanted: dict[int, list[tuple[int, int]]] = {}
    for i, (p, _) in enumerate(phrases):
        h = tk.word_hashes(p, tk.LETTER_DIGIT)
        wanted.setdefault(len(h), []).append((tk.gram_of(list(h)), i))
    bits = tk.bloom_of(np.array([g[0] for g in grams], np.int64).view(np.uint64)) if grams else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column(1)):
                n = hi - lo
                s, e, d = tk.spans(buf, offs, tk.LETTER_DIGIT)
                h = tk.span_hash(tk.eights(buf, tk.LOWER), s, e)
                zero = tk.first_of(d, n)
                at, which = [], []
                for size, found in wanted.items():
                    g, one = tk.grams(h, d, size)
                    for x, i in found:
                        hit = np.flatnonzero((g == tk.U64(x)) & one)
                        at.append(hit)
                        which.append(np.full(len(hit), i))
                at, which = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, which))
                da = d[at]
                rel = at - zero[da]
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(first, da, rel)
                np.maximum.at(last, da, rel)
                base = np.bincount(da, minlength=n)
                pair = np.unique(da * max(1, len(phrases)) + which)  # phrases by text
                named = tk.list_array(pa.array((pair % max(1, len(phrases))).astype(np.int32)), np.bincount(pair // max(1, len(phrases)), minlength=n))
                hits = np.zeros(0, np.int64)
                if bits is not None:
                    g, one = tk.grams(h, d, k)
                    hits = np.flatnonzero(tk.in_bloom(bits, g) & one)
                    g = g[hits]
                dh = d[hits]
                counts = np.bincount(dh, minlength=n)
                value = pa.StructArray.from_arrays([pa.array(hits - zero[dh], pa.int64()), pa.array(g.view(np.int64) if len(hits) else np.zeros(0, np.int64), pa.int64())], ["pos", "gram"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], pa.array(np.diff(zero), pa.int64()), pa.array(base, pa.int64()), pa.array(first, pa.int64(), mask=base == 0), pa.array(last, pa.int64(), mask=base == 0), named, tk.list_array(value, counts)],
                    ["__id", "n_words", "n_base", "first_word", "last_word", "named", "hits"],
                )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K, slack: int = 2, min_cover: float = 0.75) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first and last word, cover)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    grams = template_grams(templates, k)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(
        _scanner(phrases, grams, k),
        f"__id {kind}, n_words long, n_base long, first_word long, last_word long, named array<int>, hits array<struct<pos:long,gram:long>>",
    )
    head = ["__id", "n_words", "n_base", "first_word", "last_word", "named"]
    few = F.broadcast if len(grams) <= MAX_GRAMS else lambda df: df
    info = few(spark.createDataFrame([(t, x[0], len(x[1].split())) for t, x in enumerate(templates)], "tid int, label string, size int"))
    where = few(spark.createDataFrame(grams, "gram long, tid int, tpos int"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    votes = rows.select("row", *head, F.explode_outer("hits").alias("h")).select("row", *head, "h.pos", "h.gram").join(where, "gram", "left")
    votes = votes.select("row", *head, "tid", "tpos", "pos", (F.col("pos") - F.col("tpos")).alias("diagonal")).repartition("row")
    by = votes.groupBy("row", *head, "tid", "diagonal").agg(F.collect_set("tpos").alias("tposes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    w = Window.partitionBy("row", "tid").orderBy("diagonal")
    by = by.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > slack).cast("int"), F.lit(0))).withColumn("band", F.sum("new").over(w))
    band = by.groupBy("row", *head, "tid", "band").agg(F.array_distinct(F.flatten(F.collect_list("tposes"))).alias("tposes"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("tposes", lambda p: F.sequence(p, p + k - 1)))))
    band = band.join(info, "tid", "left").withColumn("votes", covered).withColumn("cover", F.col("votes") / F.col("size"))
    good = (F.col("cover") >= min_cover) & (F.col("last") - F.col("first") + k <= 2 * F.col("size"))
    band = band.withColumn("span", F.when(good, F.struct("label", "first", (F.col("last") + (k - 1)).alias("last"), "cover", "votes")))
    voted = band.groupBy("row", *head).agg(F.array_sort(F.collect_list("span")).alias("spans")).drop("row")
    # words that two templates claim go to the one with more votes, or at as many to the one that they cover more of
    less = lambda s, o: ((o["votes"] > s["votes"]) | ((o["votes"] == s["votes"]) & (o["cover"] > s["cover"]))) & (o["first"] <= s["last"]) & (s["first"] <= o["last"])
    voted = voted.withColumn("spans", F.filter("spans", lambda s: ~F.exists("spans", lambda o: less(s, o))))
    names = F.array(*(F.lit(label) for _, label in phrases)).cast("array<string>")
    own = F.array_sort(F.array_distinct(F.transform("named", lambda i: F.get(names, i))))
    return voted.select(
        F.col("__id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.transform("spans", lambda s: s["label"])))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))).alias("score"), "spans",
    )
