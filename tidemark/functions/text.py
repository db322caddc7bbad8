"""Text functions as column expressions.

``Column`` in, ``Column`` out; a null text counts as empty unless it says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[" + "a-z0-9" + "À-ɏ" + "Ѐ-ӿ" + "一-鿿" + "]+"
_SPACE = r"(?U)\s+"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, for texts that need it; the one Arrow function here."""
    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)

    return composed(c)


def tokens(c: Column, compose: bool = False) -> Column:
    """Lower-cased word tokens in order; ``compose`` applies NFKC first."""
    return F.regexp_extract_all(F.lower(text_or_empty(nfkc(c) if compose else c)), F.lit(TOKEN), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def token_estimate(c: Column) -> Column:
    """Four characters to a token, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4)).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if either is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def age_days(updated: Column, now: str) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now).cast("timestamp").cast("double") - updated.cast("double")) / 86400)


def age_label(days: Column) -> Column:
    d = F.floor(days)
    return F.when(days < 1, "today").when(days < 60, F.concat(d.cast("string"), F.lit("d"))).otherwise(F.concat(F.floor(d / 30).cast("string"), F.lit("mo")))


def two_places(c: Column) -> Column:
    """Half-even at two decimals, without thousands separators."""
    return F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))


def squash(score: Column, at: float) -> Column:
    return score / (score + at)


def query_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), _SPACE, " "))


def hash16(c: Column) -> Column:
    return F.substring(F.sha2(text_or_empty(c).cast("binary"), 256), 1, 16)


def bash_subject(command: Column) -> Column:
    head = F.substring(F.element_at(F.split(strip(command), "\n"), 1), 1, 80)
    return F.concat(F.lit("bash:"), F.substring(F.sha1(head.cast("binary")), 1, 8))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{4,}", "\n" * 3)


_W = "A-Za-z0-9"
_SECRET_NAMES = "|".join(["api[_-]?key", "secret[_-]?key", "secret", "access[_-]?token", "auth[_-]?token", "token", "password", "passwd", "client[_-]?secret"])


def _keyed(prefix: str, extra: str, least: int, end: bool = True) -> str:
    """A word that begins with ``prefix`` and goes on with ``least`` letters, digits or ``extra``."""
    return rf"\b{prefix}[{_W}{extra}]{{{least},}}" + (r"\b" if end else "")


#: (pattern, replacement) in the order in which they apply; the patterns are alike in Java, RE2 and Python.
SECRETS: tuple[tuple[str, str], ...] = (
    ("-{5}BEGIN [A-Z ]*PRIVATE KEY-{5}" + r"[\s\S]*?" + "-{5}END [A-Z ]*PRIVATE KEY-{5}", "[REDACTED PRIVATE KEY]"),
    (_keyed("sk-", "_-", 16), "[REDACTED]"),
    (r"\bAKIA" + "[0-9A-Z]{16}" + r"\b", "[REDACTED]"),
    (_keyed("gh[opusr]_", "", 20), "[REDACTED]"),
    (_keyed("github_pat_", "_", 20), "[REDACTED]"),
    (_keyed("glpat-", "_-", 16), "[REDACTED]"),
    (_keyed("xox[abprs]-", "-", 10), "[REDACTED]"),
    (r"\beyJ" + r"\.".join([f"[{_W}_-]{{8,}}"] * 3) + r"\b", "[REDACTED JWT]"),
    ("(?i)" + r"\bbearer\s+" + f"[{_W}._~+/=-]{{16,}}", "Bearer [REDACTED]"),
    (r"\b(" + "[A-Za-z]" + r"[\w+.-]*" + "://" + r"[^:/\s@]+):" + r"[^@\s]{3,}@", "$1:[REDACTED]@"),
    (r"(?i)\b(" + _SECRET_NAMES + r")\b(\s*[:=]\s*)" + "(['\"]?)" + r"\S{8,}", "$1$2$3[REDACTED]"),
)


def redact(c: Column) -> Column:
    for pattern, by in SECRETS:
        c = F.regexp_replace(c, pattern, by)
    return c


def contains_secret(c: Column) -> Column:
    out = F.lit(False)
    for pattern, _ in SECRETS:
        out = out | text_or_empty(c).rlike(pattern)
    return out


_BASENAMES = [*(a + b for a in ("secrets", "credentials") for b in ("", ".json")), *(f".{x}rc" for x in ("net", "npm", "pypi"))]
_SUFFIXES = ["pem", "key", "p12", "pfx", "der", "jks", "keystore", "kdbx"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sensitive_path(path: Column) -> Column:
    """Files that must never be read into memory."""
    name = F.lower(basename(path))
    by_name = name.isin(_BASENAMES) | name.rlike(r"^(id_(rsa|ed25519|ecdsa|dsa)|\.env)") | name.rlike(r"[^.]\.(" + "|".join(_SUFFIXES) + ")$")
    return by_name | name.contains("cookie") | F.array_contains(F.split(path, "/"), "ssh")


def glob_regex(glob: str) -> str:
    """A shell glob (* and ? cross slashes, [..] sets) as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        j = glob.find("]", i + 2) if c == "[" else -1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif j > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        else:
            out += c if c.isalnum() or c in "_/" else "\\" + c
        i += 1
    return "(?s)^" + out + "$"


def _fits(pattern: str):
    return lambda t: t.rlike(pattern)


def ignored_path(path: Column, globs: list[str]) -> Column:
    """Whether a glob fits the whole path, its basename or a parent folder."""
    parts = F.split(path, "/")
    tries = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(basename(path)))
    out = F.lit(False)
    for pattern in map(glob_regex, globs):
        out = out | F.exists(tries, _fits(pattern))
    return out


def test_file(path: Column) -> Column:
    return basename(path).rlike(r"^test_|_test\.py$|\.(test|spec)\.")


def search_query(pattern: Column) -> Column:
    """Words of a search pattern, twelve at most; null if there is none."""
    words = F.filter(F.split(F.regexp_replace(text_or_empty(pattern), r"(?U)[^\w\s]", " "), _SPACE), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 12), " "))


def readme_brief(c: Column) -> Column:
    lines = F.filter(F.split(text_or_empty(c), r"\r?\n"), lambda x: (strip(x) != "") & ~x.startswith("![") & ~x.startswith("[!"))
    return F.substring(F.array_join(F.slice(F.transform(lines, strip), 1, 8), " "), 1, 500)


def response_text(json: Column) -> Column:
    """Output of a tool: its stdout, stderr, output and content that aren't empty, else its JSON's first 4000 characters, else itself."""
    parts = [F.get_json_object(json, f"$.{k}") for k in "stdout stderr output content".split()]
    joined = F.concat_ws("\n", *(F.when(p != "", p) for p in parts))
    return F.when(json.startswith("{"), F.when(joined != "", joined).otherwise(F.substring(json, 1, 4000))).otherwise(text_or_empty(json))


_TEST_RUN = r"\b(pytest|unittest|jest|vitest|tox|(npm|yarn|go|cargo) +test)\b"
_OUTCOMES = [r"\d+ (?:passed|failed|errors?)", "FAILED", "PASSED", "OK", "✓", "✗"]
_RESULT = r"(?m)^(.*\b(?:" + "|".join(_OUTCOMES) + ").*)$"
_FAILURES = [r"Traceback \(most recent call last\)", "[A-Za-z_.]*" + "(?:Error|Exception):", r"error\[", "fatal:", "panic:"]
_FAILURE = r"(?m)^(.*(?:" + "|".join(_FAILURES) + ").*)$"


def learned_from_bash(command: Column, output: Column) -> Column:
    """What a command's output teaches: its test result, or its first error line, exception lines first; else null."""
    short = F.substring(F.element_at(F.split(strip(command), "\n"), 1), 1, 80)
    result = F.regexp_extract(output, _RESULT, 1)
    errors = F.regexp_extract_all(output, F.lit(_FAILURE), F.lit(1))
    best = F.coalesce(F.get(F.filter(errors, lambda x: x.rlike(r"(Error|Exception)\b")), F.lit(0)), F.get(errors, F.lit(0)))
    told = lambda head, line: F.concat(F.lit(head + " `"), short, F.lit("`: "), F.substring(strip(line), 1, 300))
    return F.when(command.rlike(_TEST_RUN), F.when(result != "", told("Test run", result))).when(best.isNotNull(), told("Command failed", best))


def index_text(context: Column, text: Column) -> Column:
    """What is indexed of a chunk: its context, a blank line and its text."""
    return F.when(F.length(text_or_empty(context)) > 0, F.concat(strip(context), F.lit("\n\n"), text)).otherwise(text)


def evidence_line(kind: Column, similarity: Column, age: Column, source: Column, subject: Column, text: Column) -> Column:
    """One line of packed context."""
    tag = F.concat_ws("|", kind, F.concat(F.lit("sim "), two_places(similarity)), age_label(age), F.when(source != "", source))
    named = F.when(text_or_empty(subject) != "", F.concat(subject, F.lit(": "))).otherwise("")
    return F.concat(F.lit("- ["), tag, F.lit("] "), named, text)
