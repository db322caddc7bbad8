"""Driver-side session helpers: project root, settings, counters, context blocks and project seeding."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import code_index, memory
from .sources import files

FOLDER = ".tidemark"
FRAMEWORKS = {"pytest": "pytest", "vitest": "vitest", "jest": "jest", "mocha": "mocha", "unittest": "unittest"}


def project_root(start: str | Path) -> Path:
    """The nearest folder upwards with this library's data, else with a repository, else ``start``."""
    here = Path(start).resolve()
    for mark in (FOLDER, ".git"):
        for p in (here, *here.parents):
            if (p / mark).exists():
                return p
    return here


@dataclass(frozen=True)
class Settings:
    budget_tokens: int = 1200
    min_confidence: float = 0.25
    strict: bool = False


def settings(root: Path) -> Settings:
    """From the ``[recall]`` section of the settings file; what is missing, unknown or unreadable falls back to defaults."""
    try:
        got = tomllib.loads((root / FOLDER / "config.toml").read_text("utf-8")).get("recall", {})
    except (OSError, ValueError):
        return Settings()
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    return Settings(**{k: kinds[k](v) for k, v in got.items() if k in kinds})


class Counters:
    """Session statistics in a JSON file; a corrupt file counts as empty."""

    def __init__(self, root: Path) -> None:
        self.path = root / FOLDER / "session.json"

    def read(self) -> dict[str, int]:
        try:
            got = json.loads(self.path.read_text("utf-8"))
        except (OSError, ValueError):
            return {}
        return got if isinstance(got, dict) else {}

    def bump(self, name: str, by: int = 1) -> int:
        now = self.read()
        now[name] = int(now.get(name, 0)) + by
        folder = self.path.parent
        folder.mkdir(exist_ok=True, parents=True)
        self.path.write_text(json.dumps(now), "utf-8")
        return now[name]


def context_block(answer: DataFrame, evidence: DataFrame, first: int = 8, most: int = 5) -> DataFrame:
    """(query_id, block): mode, confidence, suggestion, context and the first distinct sources of the first evidence rows."""
    src = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.col("subject"))
    rows = evidence.where(F.col("rank") < first).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", src.alias("s")))).alias("r"))
    names = F.slice(F.array_distinct(F.array_compact(F.transform("r", lambda x: x["s"]))), 1, most)
    tail: Column = F.when(F.size(names) > 0, F.concat(F.lit("\nsources: "), F.array_join(names, ", "))).otherwise("")
    head = F.concat(F.lit('<memory mode="'), "mode", F.lit('" confidence="'), T.two_places(F.col("score")), F.lit('">\n'), "suggestion", F.lit("\n"))
    return answer.join(rows, "query_id", "left").select("query_id", F.concat(head, "context", F.coalesce(tail, F.lit("")), F.lit("\n</memory>")).alias("block"))


def entry_points(root: Path, most: int = 8) -> list[str]:
    """Scripts that the project declares."""
    out: list[str] = []
    try:
        project = tomllib.loads((root / "pyproject.toml").read_text("utf-8")).get("project") or {}
        out += [f"{k} = {v}" for k, v in (project.get("scripts") or {}).items()]
    except (OSError, ValueError):
        pass
    try:
        out += [f"npm run {k}: {v}" for k, v in json.loads((root / "package.json").read_text("utf-8")).get("scripts", {}).items()]
    except (OSError, ValueError, AttributeError):
        pass
    return out[:most]


def test_framework(root: Path) -> str | None:
    for name in ("pyproject.toml", "package.json", "setup.cfg", "tox.ini"):
        try:
            text = (root / name).read_text("utf-8")
        except OSError:
            continue
        for word, framework in FRAMEWORKS.items():
            if word in text:
                return framework
    return None


def index_file(stored: DataFrame, sources: DataFrame) -> tuple[DataFrame, bool]:
    """One edited file (file, text) against the stored records: the records after, and whether it changed; other files keep theirs."""
    name = sources.first()["file"]
    mine = stored.where(F.col("file") == name)
    after, stats = code_index.reindex(sources, mine)
    return stored.where(F.col("file") != name).unionByName(after), stats.first()["files_indexed"] > 0


def facts(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """(text, subject, source) of up to four facts inferred from a project: what it is, languages, entry points, tests."""
    here = Path(root)
    out: list[tuple[str, str, str]] = []
    readme = next((p for p in sorted(here.glob("README*")) if p.is_file()), None)
    if readme is not None:
        brief = spark.createDataFrame([(readme.read_text("utf-8-sig", errors="replace"),)], "t string").select(T.redact(T.readme_brief(F.col("t")))).first()[0]
        if brief:
            out.append((f"The project: {brief}", "project-brief", readme.name))
    code = code_index.files(files.code_files(spark, f"file://{here.resolve()}"))
    mix = [f"{r['language']} ({r['n_files']})" for r in code_index.language_mix(code).collect()]
    if mix:
        out.append(("Languages: " + ", ".join(mix), "project-languages", ""))
    if points := entry_points(here):
        out.append(("Entry points: " + "; ".join(points), "project-entry-points", ""))
    if framework := test_framework(here):
        out.append((f"Tests run with {framework}", "project-tests", ""))
    return out


def fact_rows(spark: SparkSession, found: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(t, "fact", s, f) for t, s, f in found], "text string, kind string, subject string, source string")


def episode(spark: SparkSession, found: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(f"Looked at the project: {len(found)} facts inferred", "episode", "project-seed")], "text string, kind string, subject string")


def seed(spark: SparkSession, root: str, records: DataFrame) -> DataFrame:
    """Memory after a look at a project: its inferred facts, in place of those inferred before, and an episode."""
    found = facts(spark, root)
    after = memory.replace_inferred(records, fact_rows(spark, found)) if found else records
    return after.unionByName(memory.remember(episode(spark, found)), allowMissingColumns=True)
