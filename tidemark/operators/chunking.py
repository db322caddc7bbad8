"""Chunkers as table-generating functions: recursive, Markdown, code, and the dispatch by suffix.

Splitting is stateful (recursion, overlap, heading paths), so it runs in an Arrow function that
turns a text into an array of chunks; everything around it is a projection and posexplode.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from . import common
from .code_index import LANGUAGES

_CUTS = tuple("\n\n|\n|. | ".split("|"))
_KEYWORDS = ["def", "class", "function", "fn", "func", "impl", "interface", "struct", "enum", "type", "pub fn"]
_TOP = re.compile(r"(?m)^(?=(?:export\s+)?" + r"(?:async\s+)?" + rf"(?:{'|'.join(_KEYWORDS)})\b)")
_HEAD = re.compile("(?m)^(" + "#{1,6}" + r")\s+" + "(.*)$")
MARKDOWN = {".md", ".markdown", ".mdx", ".rst"}
CODE = {"." + end for name, ends in LANGUAGES.items() if name != "sql" for end in ends}


def _fragments(text: str, size: int, level: int = 0) -> Iterator[str]:
    if len(text) <= size or level == len(_CUTS):
        if text.strip():
            yield text
        return
    cut = _CUTS[level]
    parts = text.split(cut)
    for i, part in enumerate(parts):
        whole = part + cut if i + 1 < len(parts) else part
        if len(whole) > size:
            yield from _fragments(whole, size, level + 1)
        elif whole.strip():
            yield whole


def recursive(text: str, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> list[str]:
    """Pieces of about ``size`` characters, each begun with the last ``overlap`` of the one before."""
    if overlap >= size:
        raise ValueError("the overlap must be less than the chunk size")
    out, at = [], ""
    for f in _fragments(text, size):
        if at and len(at) + len(f) > size:
            out.append(at)
            at = at[len(at) - overlap :] if 0 < overlap < len(at) else (at if overlap else "")
        at += f
    return [*out, at] if at.strip() else out


def markdown(text: str, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> list[tuple[str, str]]:
    """(chunk, heading path) by sections."""
    heads = list(_HEAD.finditer(text))
    sections = [("", text[: heads[0].start()] if heads else text)]
    path: list[tuple[int, str]] = []
    for h, end in zip(heads, [*(x.start() for x in heads[1:]), len(text)], strict=False):  # no heading: no round
        depth = len(h[1])
        path = [p for p in path if p[0] < depth] + [(depth, h[2].strip())]
        sections.append((" > ".join(t for _, t in path), text[h.start() : end]))
    out = []
    for name, body in sections:
        if body.strip():
            out += [(c, name) for c in (recursive(body, size, overlap) if len(body) > size else [body])]
    return out


def code(text: str, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> list[str]:
    out: list[str] = []
    for block in _TOP.split(text):
        out += recursive(block, size, overlap) if len(block) > size else [block] * bool(block.strip())
    return out


def kind_of(suffix: Column) -> Column:
    return F.when(suffix.isin(sorted(MARKDOWN)), "markdown").when(suffix.isin(sorted(CODE)), "code").otherwise("recursive")


def _arrays(size: int, overlap: int) -> Callable:
    def cut(text: str | None, how: str) -> list[dict]:
        text = text or ""
        if how == "markdown":
            got = markdown(text, size, overlap)
        else:
            got = [(c, "") for c in (code if how == "code" else recursive)(text, size, overlap)]
        return [{"text": c.strip(), "heading": h or None} for c, h in got if c.strip()]

    @F.pandas_udf("array<struct<text:string,heading:string>>")
    def run(texts: pd.Series, how: pd.Series) -> pd.Series:
        return pd.Series([cut(t, h) for t, h in zip(texts, how, strict=True)])

    return run


def chunk(docs: DataFrame, how: Column | str = "recursive", size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seq from 0, text, heading) of stripped, non-empty chunks. ``how``: a strategy, or a column of strategies."""
    if overlap >= size:
        raise ValueError("the overlap must be less than the chunk size")
    common.small_batches(docs.sparkSession)
    strategy = F.lit(how) if isinstance(how, str) else how
    got = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_arrays(size, overlap)(F.col(text_col), strategy)))
    return got.select("doc_id", F.col("pos").cast("long").alias("seq"), "col.text", "col.heading")


def with_context(chunks: DataFrame, docs: DataFrame, context: Callable[[str, str], str | None] | None = None, doc_chars: int = 80_000) -> DataFrame:
    """Contextual enrichment: documents of two chunks and more get a context for each chunk from ``context`` (document, chunk); none offline or on failure."""
    if context is None:
        return chunks.withColumn("context", F.lit(None).cast("string"))
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(doc: pd.Series, text: pd.Series) -> pd.Series:
        def one(d: str, t: str) -> str | None:
            try:
                return context(d, t)
            except Exception:
                return None

        return pd.Series([one(d, t) for d, t in zip(doc, text, strict=True)])

    many = chunks.groupBy("doc_id").agg((F.count("*") > 1).alias("many"))
    whole = docs.select("doc_id", F.substring("text", 1, doc_chars).alias("__doc"))
    both = chunks.join(many, "doc_id").join(whole, "doc_id")
    return both.withColumn("context", F.when(F.col("many"), run(F.when(F.col("many"), F.col("__doc")), "text"))).drop("many", "__doc")
