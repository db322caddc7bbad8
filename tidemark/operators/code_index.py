"""Code memory: symbols of source files, incremental diff by hash, import graph."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import common

LANGUAGES = {
    "python": ["py"], "javascript": ["js", "jsx"], "typescript": ["ts", "tsx"], "go": ["go"], "rust": ["rs"], "java": ["java"], "kotlin": ["kt"], "ruby": ["rb"], "php": ["php"],
    "csharp": ["cs"], "c": ["c", "h"], "cpp": ["cpp", "hpp"], "swift": ["swift"], "scala": ["scala"], "lua": ["lua"], "sql": ["sql"],
}
MAX_BYTES = 512_000
_ID = r"([A-Za-z_]\w*)"
_MODIFIERS = "".join(rf"(?:{m}\s+)?" for m in ("export", "public|private|protected", "static", "async"))
_NOUNS = "|".join(sorted(["function", "fn", "func", "class", "interface", "struct", "enum", "trait", "impl", "type", "module"], key=len, reverse=True))
_SYMBOL = re.compile(rf"(?m)^\s*{_MODIFIERS}(?:{_NOUNS})\s+{_ID}")
_ARROW = re.compile(r"(?m)^\s*(?:" + r"export\s+)?const\s+" + _ID + r"\s*=\s*" + r"(?:async\s*)?\(")
_ROUTE = re.compile(r"\w+\.(" + "|".join(["get", "post", "put", "delete", "patch", "websocket"]) + r")\(\s*" + "['\"]" + "([^'\"]+)")
_QUOTED = "['\"]" + "([^'\"]+)"
_IMPORT = re.compile(r"(?m)^\s*(?:" + "|".join([r"import\s+.*?from\s+" + _QUOTED, r"import\s+" + _QUOTED, r"require\(\s*" + _QUOTED, r"use\s+([\w:]+)"]) + ")")
SHAPE = "struct<imports:array<string>,symbols:array<struct<name:string,type:string,line:long,snippet:string,route:string>>>"


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(T.basename(path), r"\.([^.]+)$", 1))
    out = F.lit(None).cast("string")
    for name, ends in LANGUAGES.items():
        out = F.when(suffix.isin(ends), name).otherwise(out)
    return out


def _python(source: str) -> dict:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return {"imports": [], "symbols": []}
    lines = source.split("\n")
    found: set[str] = set()
    for part in ast.walk(tree):
        match part:
            case ast.Import(names=names):
                found |= {a.name for a in names}
            case ast.ImportFrom(module=str(module)):
                found.add(module)
    functions = ast.FunctionDef | ast.AsyncFunctionDef

    def symbol(node: ast.AST, name: str, kind: str) -> dict:
        head = lines[node.lineno - 1][node.col_offset :][:200]
        doc = (ast.get_docstring(node) or "")[:300]
        routes = [m for d in node.decorator_list if kind != "class" and (m := _ROUTE.search(ast.get_source_segment(source, d) or ""))]
        return {"name": name, "type": kind, "line": node.lineno, "snippet": f"{head}\n{doc}".strip(), "route": f"{routes[0][1].upper()} {routes[0][2]}" if routes else None}

    out = []
    for node in tree.body:
        if isinstance(node, functions):
            out.append(symbol(node, node.name, "function"))
        elif isinstance(node, ast.ClassDef):
            out.append(symbol(node, node.name, "class"))
            out += [symbol(m, f"{node.name}.{m.name}", "method") for m in node.body if isinstance(m, functions)]
    return {"imports": sorted(found), "symbols": out}


def _other(source: str) -> dict:
    out = []
    for pattern, kind in ((_SYMBOL, "symbol"), (_ARROW, "function")):
        for m in pattern.finditer(source):
            at = m.start()
            out.append({"name": m[1], "type": kind, "line": source.count("\n", 0, at) + 1, "snippet": source[at : at + 200].split("\n")[0], "route": None})
    return {"imports": sorted({g for m in _IMPORT.finditer(source) for g in m.groups() if g}), "symbols": out}


def parsed(source: Column, lang: Column) -> Column:
    """Imports and symbols of a file: by the syntax tree for Python, by patterns otherwise."""

    @F.pandas_udf(SHAPE)
    def run(source: pd.Series, lang: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(_python if x == "python" else _other)(s or "") for s, x in zip(source, lang, strict=True)], columns=["imports", "symbols"])

    return run(source, lang)


def files(sources: DataFrame) -> DataFrame:
    """(file, language, file_hash, test, imports, symbols) of (file, text) rows in a known language and of at most ``MAX_BYTES``."""
    common.small_batches(sources.sparkSession)
    rows = sources.withColumn("language", language(F.col("file"))).where(F.col("language").isNotNull() & (F.octet_length("text") <= MAX_BYTES))
    got = rows.withColumn("p", parsed(F.col("text"), F.col("language")))
    return got.select("file", "language", T.hash16(F.col("text")).alias("file_hash"), T.test_file(F.col("file")).alias("test"), "p.imports", "p.symbols")


def symbols(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.select("file", "language", F.explode("symbols").alias("s")).select("file", "language", F.col("s.name").alias("symbol"), F.col("s.type").alias("symbol_type"), F.col("s.line").alias("line"), F.col("s.route").alias("route"), F.col("s.snippet").alias("snippet"))


def records(parsed_files: DataFrame) -> DataFrame:
    """Memory rows (kind code): one for each file and one for each symbol, redacted."""
    none = lambda c, text: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(text)
    names = F.transform(F.slice("symbols", 1, 60), lambda s: s["name"])
    about = F.concat(F.lit("file "), "file", F.lit(" ("), "language", F.lit(", "), F.size("symbols").cast("string"), F.lit(" symbols"), F.when(F.col("test"), ", test file").otherwise(""), F.lit(")\nimports: "), none(F.slice("imports", 1, 40), "(none)"), F.lit("\nsymbols: "), none(names, "(none)"))
    tags = lambda *t: F.array_compact(F.array(*t, F.when(F.col("test"), F.lit("test"))))
    same = ["file", "file_hash", "language"]
    whole = parsed_files.select(*same, F.lit("file").alias("symbol_type"), F.col("file").alias("subject"), T.redact(about).alias("text"), F.col("file").alias("source"), tags(F.lit("file")).alias("tags"))
    s = parsed_files.select(*same, "test", F.explode("symbols").alias("s"))
    at = F.concat("file", F.lit(":"), F.col("s.line").cast("string"))
    line = F.concat("s.type", F.lit(" "), "s.name", F.when(F.col("s.route").isNotNull(), F.concat(F.lit(" ["), "s.route", F.lit("]"))).otherwise(""), F.lit(" — "), at, F.lit("\n"), "s.snippet")
    each = s.select(*same, F.col("s.type").alias("symbol_type"), F.concat("file", F.lit("::"), "s.name").alias("subject"), T.redact(line).alias("text"), at.alias("source"), F.array_compact(F.concat(tags(F.col("s.type")), F.array(F.when(F.col("s.route").isNotNull(), F.lit("endpoint"))))).alias("tags"))
    return whole.unionByName(each).withColumn("kind", F.lit("code")).withColumn("authority", F.lit(0.7))


def diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(file, state) by comparing (file, file_hash): new, changed, unchanged, removed; ``stored`` is limited to the scanned folder by the caller."""
    a, b = current.select("file", F.col("file_hash").alias("now")), stored.select("file", F.col("file_hash").alias("was")).distinct()
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return a.join(b, "file", "full_outer").select("file", state.alias("state"))


def existing(code_records: DataFrame) -> DataFrame:
    return code_records.groupBy("file").agg(F.first("file_hash").alias("file_hash"), F.collect_set("subject").alias("subjects"))


def reindex(sources: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records after, stats): unchanged files keep their records, the others are parsed anew or evicted; only changed texts reach the parser."""
    hashed = sources.withColumn("language", language(F.col("file"))).where(F.col("language").isNotNull() & (F.octet_length("text") <= MAX_BYTES)).withColumn("file_hash", T.hash16(F.col("text")))
    d = diff(hashed, stored)
    todo = hashed.join(d.where(F.col("state").isin("new", "changed")), "file", "left_semi").select("file", "text")
    made = records(files(todo))
    kept = stored.join(d.where("state = 'unchanged'"), "file", "left_semi")
    count = lambda s: F.sum(F.col("state").isin(s).cast("long"))
    stats = d.agg(count(["new", "changed"]).alias("files_indexed"), count(["unchanged"]).alias("files_skipped"), count(["removed"]).alias("files_removed"))
    return kept.select(*made.columns).unionByName(made), stats


def graph(parsed_files: DataFrame) -> DataFrame:
    """(file, imported) edges."""
    return parsed_files.select("file", F.explode("imports").alias("imported"))


def language_mix(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.groupBy("language").agg(F.count("*").alias("n_files")).orderBy(F.col("n_files").desc(), "language")
