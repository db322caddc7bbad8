"""A table of source files made of documents: one small file for each, in the language that the document's stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIX = {"en": "py", "de": "js", "fr": "rs"}
TEXT = {
    "en": 'import {source}\n\n\n@app.get("/doc/{id}")\ndef read_{id}():\n    return {n}\n\n\nclass Doc{id}:\n    """{lang}"""\n\n    def size(self):\n        return {n}\n',
    "de": "import {{ a }} from '{source}'\nexport const size_{id} = (x) => x\nfunction read_{id}(x) {{\n  return {n}\n}}\n",
    "fr": "use std::{lang}\nfn read_{id}(p: i32) -> i32 {{ p }}\n",
    "": "package main\nfunc Read{id}() int {{\n\treturn {n}\n}}\n",
}


def code(docs: DataFrame) -> DataFrame:
    """(file, text, doc_id, lang, source, n_chars)"""
    suffix, text = F.lit("go"), _filled(TEXT[""])
    for lang, end in SUFFIX.items():
        suffix = F.when(F.col("lang") == lang, end).otherwise(suffix)
        text = F.when(F.col("lang") == lang, _filled(TEXT[lang])).otherwise(text)
    return docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit("."), suffix).alias("file"), text.alias("text"), "doc_id", "lang", "source", "n_chars")


def _filled(template: str):
    names = {"source": "source", "id": "doc_id", "n": "n_chars", "lang": "lang"}
    return F.format_string(template.replace("{{", "\0").replace("}}", "\1").replace("%", "%%").format(**{k: f"%{i}$s" for i, k in enumerate(names, 1)}).replace("\0", "{").replace("\1", "}"), *(F.col(c).cast("string") for c in names.values()))
